"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of formatted text. Prefix sums of turn tokens choose
turn-aligned spans: a window's new turns are those that fit into what the budget leaves beside the
system turn and the history; each later window repeats the system turn and the last turns before
its span, as many as ``history`` tokens hold. Only assistant turns that are new in a window carry
loss; repeated ones are masked, so each target is trained on once. A turn that does not fit into
the budget beside the system turn gets a window with that alone, whole.

A turn's tokens are those of its marked, escaped form, marks and role included, as the model encodes
it after a line end (all marked turns end in one, and no piece goes across). Where a turn opens a
window its head may come out longer; the greatest such difference of its role is counted in. So a
window's ``tokens`` is what encoding its formatted text gives, or a few more, never fewer.

The template marks turns as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and
texts (these marks and those of other common templates) are escaped by one backslash after their
first character, one more for each that stands there already; ``unescape`` takes exactly one away.

Long conversations. The running sum is taken in two steps (within blocks of turns, then over block
totals), and a conversation is dealt out by stretches of ``STRETCH`` budgets of its running sum;
each stretch also gets the earlier turns it may repeat. So no task holds more than a stretch,
however long one conversation is, and windows break at stretch ends besides.

Defined cases: a null text or role is empty; rows that repeat a turn number are turns of their own,
in order of role and text; rows without a turn number come with turn 0 and all lie in its block, in one task;
rows without a conversation id form one conversation; a further system
turn is an ordinary turn, only the first turn can be the one retained; an empty table gives an empty
result; further columns are not read, whatever their names. A very long text is one turn and stays
whole: a task holds a stretch of turns and one window. ``digests`` reads a conversation's windows in
one task, as a hash of a whole conversation must, but one window at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

# The marks of the template and, after "<" or "[", how control strings go on.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"\||/?s>|</?SYS>>"
CONTROL_SQUARE = r"/?INST\]"

_ESCAPE = re.compile(rf"(<)(\\*)(?={CONTROL})|(\[)(\\*)(?={CONTROL_SQUARE})")
_UNESCAPE = re.compile(rf"(<)\\(\\*)(?={CONTROL})|(\[)\\(\\*)(?={CONTROL_SQUARE})")
_MARKED = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

TURN_BLOCK, STRETCH = 1024, 64

SCHEMA = "conv_id long, stretch long, window int, formatted string, new_from int, loss array<struct<start:int,end:int>>, tokens int"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4] or "") + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4] or ""), text)


def mark(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and where its text begins and ends. A newline in a role is escaped too."""
    head = f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    def role(x: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(x))

    return [(role(m[1]), unescape(m[2])) for m in _MARKED.finditer(formatted)]


def windows(turns: list[tuple[int, str, str, int, bool]], budget: int, history: int) -> Iterator[tuple]:
    """turns: (tokens, role, text, place, new in this stretch) in order, a retained system turn
    first if there is one (place 0). Yields (formatted, new_from, loss, tokens)."""
    system = turns[0] if turns and turns[0][3] == 0 and turns[0][1] == "system" else None
    at = next((i for i, t in enumerate(turns) if t[4]), len(turns))
    sums = np.r_[0, np.cumsum([t[0] for t in turns])]
    while at < len(turns):
        keep = system if system is not None and at > 0 else None
        lead = keep[0] if keep else 0
        low = 1 if keep else 0
        # The history: the longest run of turns before ``at`` of at most ``history`` tokens.
        back = max(low, int(np.searchsorted(sums, sums[at] - history, side="left")))
        back = min(back, at)
        room = budget - lead - int(sums[at] - sums[back])
        end = int(np.searchsorted(sums, sums[at] + room, side="right")) - 1
        if end <= at:  # the history goes first, then the budget yields to a whole turn
            back = at
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + budget - lead, side="right")) - 1)
        out, size, loss, new_from = [], 0, [], 0
        for i in ([0] if keep else []) + list(range(back, end)):
            tokens, role, text, _, _ = turns[i]
            marked, a, b = mark(role, text)
            if i == at:
                new_from = size
            if i >= at and role == "assistant":
                loss.append({"start": size + a, "end": size + b})
            out.append(marked)
            size += len(marked)
        yield "".join(out), new_from, loss, lead + int(sums[end] - sums[back])
        at = end


def _windows_of(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made():
            rows = [(*key, i, *w) for i, w in enumerate(windows(held, budget, history))]
            conv, stretch, number, text, new_from, loss, tokens = zip(*rows) if rows else ((),) * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(stretch, pa.int64()), pa.array(number, pa.int32()), pa.array(text, pa.string()),
                 pa.array(new_from, pa.int32()), pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(tokens, pa.int32())],
                names=["conv_id", "stretch", "window", "formatted", "new_from", "loss", "tokens"],
            )

        ready, waiting = [], 0
        for batch in batches:
            for conv, stretch, place, new, tokens, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, stretch) != key:
                    if held:
                        ready.append(made())
                        waiting += ready[-1].num_rows
                        if waiting >= 1000:
                            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                            ready, waiting = [], 0
                    key, held = (conv, stretch), []
                held.append((tokens, role, text, place, new))
        if held:
            ready.append(made())
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return run


def with_tokens(df: DataFrame, model: str | None = None) -> DataFrame:
    """``df`` plus tokens: pieces of the marked turn under the SentencePiece model at path ``model`` (by
    default that of the installed public tokenizers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        path = model
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        line_end = len(processor.encode("\n"))
        opening: dict[str, int] = {}  # role -> how many tokens more its head has where it opens a window

        def more(role: str) -> int:
            if role not in opening:
                if len(opening) > 10_000:
                    opening.clear()
                head = mark(role, "")[0]
                opening[role] = max(0, len(processor.encode(head)) + line_end - len(processor.encode("\n" + head)))
            return opening[role]

        for batch in batches:
            roles, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("role", "text"))
            marked = ["\n" + mark(r, t)[0] for r, t in zip(roles, texts)]
            encoded = processor.encode(marked, num_threads=1) if marked else []
            counts = [len(x) - line_end + more(r) for x, r in zip(encoded, roles)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32())], names=[*batch.schema.names, "tokens"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, tokens int")


def placed(df: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their place in the conversation, their running sum, and the stretch that has them;
    history turns and the system turn are repeated for stretches that need them (new = false)."""
    order = ["turn", "role", "text"]
    turns = cut(
        with_tokens(df.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )).withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / TURN_BLOCK)),
        "turn-tokens",
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = (
        turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
        .select("conv_id", "block", F.coalesce(F.sum("t").over(before), zero).alias("t0"), F.coalesce(F.sum("c").over(before), zero).alias("c0"))
    )
    within = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        turns.withColumn("end", F.sum("tokens").over(within)).withColumn("nth", F.row_number().over(within))
        .alias("t").join(blocks.alias("b"), F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("t.block") == F.col("b.block")))
        .select("t.conv_id", *order, "tokens", (F.col("end") + F.col("t0")).alias("end"), (F.col("nth") - 1 + F.col("c0")).alias("place"))
    )
    size = budget * STRETCH
    own = F.floor((F.col("end") - F.col("tokens")) / size)
    # A turn serves as history up to ``history`` tokens after its end.
    last = F.floor((F.col("end") + history) / size)
    summed = summed.withColumn("own", own)
    # Where a long turn goes on no other turn starts, so no stretch there has a use for it: only the
    # one in which it starts and those from its end on.
    behind = F.sequence(F.greatest(F.col("own") + 1, F.floor(F.col("end") / size)), last)
    uses = F.when(last > F.col("own"), F.concat(F.array("own"), behind)).otherwise(F.array("own"))
    spread = summed.withColumn("stretch", F.explode(uses)).withColumn("new", F.col("stretch") == F.col("own"))
    system = summed.filter((F.col("place") == 0) & (F.col("role") == "system"))
    stretches = summed.select("conv_id", F.col("own").alias("stretch")).distinct()
    again = (
        system.alias("s").join(stretches.alias("x"), F.col("s.conv_id").eqNullSafe(F.col("x.conv_id")))
        .filter((F.col("x.stretch") > F.floor((F.col("end") + history) / size)) & (F.col("x.stretch") > F.col("own")))
        .select("s.conv_id", *order, "tokens", "end", "place", "own", "x.stretch", F.lit(False).alias("new"))
    )
    return spread.select(again.columns).unionByName(again)


def format_windows(df: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """conv_id, stretch, window, formatted, new_from (where its new turns begin), loss (spans of
    ``formatted``), tokens; a conversation's windows in order of stretch and window."""
    return (
        placed(df, budget, history)
        .repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")
        .select("conv_id", "stretch", "place", "new", "tokens", "role", "text")
        .mapInArrow(_windows_of(budget, history), SCHEMA)
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows in order of conv_id, stretch and window: what was formatted, read back."""
    started, key, state, rows = False, None, None, []

    def done():
        turns, n, loss, chars, size, count = state
        rows.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size, count))

    def out():
        cols = list(zip(*rows)) or [()] * 7
        rows.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for batch in batches:
        for conv, formatted, new_from, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or conv != key:
                if started:
                    done()
                started, key, state = True, conv, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in read_turns(formatted[new_from:]):
                state[0].update(f"{role}\n{text}\n".encode())
                state[1] += 1
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                state[2].update(text.encode())
                state[3] += len(text)
            state[4] += len(formatted)
            state[5] += 1
        if len(rows) >= 1000:
            yield out()
    if started:
        done()
    yield out()


def digests(windows_: DataFrame) -> DataFrame:
    return (
        windows_.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")
        .select("conv_id", "formatted", "new_from", "loss")
        .mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
    )


def op7_budgeted_windows(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digests(format_windows(turns))
