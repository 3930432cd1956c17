"""Personal data: fixed patterns, and identifiers that bootstrapped context patterns find.

Base spans come from four patterns (email, ip, card, phone). They are the seeds. A seed induces context
patterns, in words: the word before it; the two before it; the one before and the one behind. Words are
lower-cased, digits become 0, and punctuation at their outer ends goes. What stands in a pattern's slot
elsewhere is a filler: a seed, a candidate, or any other word. A candidate is a run of words with a digit or
an @ that has ``LEAST_SIGNS`` letters and digits and meets no base span.

Patterns and instances (seeds and candidates, by their text) form a graph that is scored in ``ROUNDS`` rounds:

* a pattern's confidence is (sum of its distinct instances' scores) / (its distinct instances + its other
  fillers' occurrences + ``PRIOR``), so that "the _" is worth nothing, however many seeds it holds;
* a seed's score is 1; a candidate's is 1 - product of (1 - confidence) over its patterns of ``FLOOR`` or more.

Candidates in the slot of a pattern that ends at ``CONFIDENT`` or more are found, as the kind that most of the
pattern's seeds are of (email_like, ip_like, ...).

What bounds it. Only contexts with ``LEAST_SEEDS`` distinct seeds are patterns. To count their fillers, every
position of every text is looked up in a Bloom filter of the patterns, a bit table of 1 MB whatever the corpus;
its false hits cost rows and are joined away. A document sends one row for each context it holds and has no
candidate in, with a count, and those combine before the shuffle. A pattern that could not reach ``FLOOR``
even if all its candidates were certain takes no part, which keeps frequent contexts out of the graph.

Defined cases: a null text is empty; repeated rows are documents of their own, but an instance counts once for a
pattern; base spans of one kind never overlap, those of two kinds may; found spans overlap no base span and no
found span; an empty table gives an empty result; columns named ``spans`` or ``base_spans`` are replaced, the
text is left out, further columns pass through, and names that begin with ``_pd_`` are reserved. Very long texts
are read whole: a task holds one text and some ten numbers a word."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bit_table, cut, in_table, table, unpacked

# Fixed patterns. Where a pattern begins with a run, it can only match from the run's beginning, and a run
# need not be given back: said so, matching takes linear time on texts of any shape.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = ("email", "ip", "card", "phone")
FOUND = tuple(f"{k}_like" for k in KINDS)

LEAST_SIGNS, LEAST_SEEDS, ROUNDS, PRIOR = 6, 3, 3, 1.0
FLOOR, CONFIDENT = 0.5, 0.8
AT_ONCE = 1 << 22  # characters whose words are numbered together

_WORD = re.compile(r"[^\x20\t-\r]+")
_ENDS = re.compile(r"^\W+|\W+$")
_DIGIT = re.compile(r"[0-9]")
_NO_WORD = 0x9E3779B97F4A7C15


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, in order of start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def normal(word: str) -> str:
    return _DIGIT.sub("0", _ENDS.sub("", word).lower())


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 0)


def text_key(text: str) -> tuple[int, int]:
    """128 bits of the text, so that what is found in it can be joined to every row that has it."""
    import xxhash

    a, b = np.frombuffer(xxhash.xxh3_128_digest(text), np.int64)
    return int(a), int(b)


def _mixed(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two hashes."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + y
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def context_hashes(before2: np.ndarray, before: np.ndarray, behind: np.ndarray) -> list[np.ndarray]:
    """The three patterns around slots with these words (as hashes)."""
    zero = np.zeros_like(before)
    return [_mixed(before, zero, 1), _mixed(before2, before, 2), _mixed(before, behind, 3)]


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words of all texts: the number of each, how many a text has, the distinct words and their hashes."""
    words = [_WORD.findall(t) for t in texts]
    coded = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((_hash(normal(w)) for w in distinct), np.uint64, len(distinct))
    return coded.indices.to_numpy().astype(np.int64), np.array([len(ws) for ws in words], np.int64), distinct, hashes


def neighbours(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word two before, one before and one behind each word of one text."""
    edge = np.array([_NO_WORD, _NO_WORD], np.uint64)
    padded = np.concatenate([edge, hashes, edge])
    n = len(hashes)
    return padded[:n], padded[1 : n + 1], padded[3 : n + 3]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    held, first, size = [], 0, 0
    for at, text in enumerate(batch.column(batch.schema.get_field_index(column))):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= AT_ONCE:
            yield first, held
            held, first, size = [], at + 1, 0
    if held:
        yield first, held


def _slots(spans: list[tuple[int, int, int]], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """First and last word that each span touches."""
    return [(bisect_right(ends, a), bisect_left(starts, b) - 1) for a, _, b in spans]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a text and further columns: these, the text's key, base spans, and of each seed the kind, a hash
    of its text and its three contexts."""
    span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
    seed = pa.struct([("kind", pa.int32()), ("instance", pa.int64()), ("context", pa.int64())])
    for batch in batches:
        spans_out, seeds_out, keys = [], [], []
        for text in batch.column(0):
            text = text.as_py() or ""
            keys.append(text_key(text))
            spans = base_spans(text)
            spans_out.append([{"start": a, "rank": k, "end": b} for a, k, b in spans])
            made = []
            if spans:
                places = [m.span() for m in _WORD.finditer(text)]
                starts, ends = [p[0] for p in places], [p[1] for p in places]
                word = lambda i: _hash(normal(text[starts[i] : ends[i]])) if 0 <= i < len(places) else _NO_WORD
                slots = _slots(spans, starts, ends)
                around = np.array([[word(a - 2), word(a - 1), word(b + 1)] for a, b in slots], np.uint64).reshape(-1, 3)
                found = [c.view(np.int64).tolist() for c in context_hashes(*around.T.copy())]
                for i, (a, kind, b) in enumerate(spans):
                    instance = np.uint64(_hash(text[a:b])).view(np.int64).item()
                    made += [{"kind": kind, "instance": instance, "context": c[i]} for c in found]
            seeds_out.append(made)
        a, b = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], a, b, pa.array(spans_out, pa.list_(span)), pa.array(seeds_out, pa.list_(seed))], names=[*batch.schema.names[1:], "_pd_a", "_pd_b", "_pd_base", "_pd_seeds"])


def candidate_runs(words: list[str], like: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of the maximal runs of identifier-like words."""
    at = np.flatnonzero(like)
    if not len(at):
        return []
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return [(int(r[0]), int(r[-1])) for r in runs if sum(c.isalnum() for i in r for c in words[i]) >= LEAST_SIGNS]


def _fillers(shared):
    """Over texts: per context in the bit table the number of other fillers (kind null), and a row for each
    candidate (kind -1) or seed in it, with the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpacked(shared.value)
        for batch in batches:
            others: list[np.ndarray] = []
            rows: list[tuple] = []
            for first, texts in _texts(batch, "text"):
                number, counts, distinct, hashes = numbered(texts)
                like_word = np.fromiter((bool(_DIGIT.search(w)) or "@" in w for w in distinct), bool, len(distinct))
                upto = np.cumsum(counts)
                for i, text in enumerate(texts):
                    own = number[upto[i] - counts[i] : upto[i]]
                    if not len(own):
                        continue
                    other = np.ones(len(own), bool)
                    around = neighbours(hashes[own])
                    like = like_word[own]
                    if like.any():
                        spans = base_spans(text)
                        places = [m.span() for m in _WORD.finditer(text)]
                        starts, ends = [p[0] for p in places], [p[1] for p in places]
                        slots = _slots(spans, starts, ends)
                        for a, b in slots:
                            like[a : b + 1] = False
                            other[a : b + 1] = False
                        found = [(a, b, *span) for (a, b), span in zip(slots, spans)]
                        for a, b in candidate_runs([text[x:y] for x, y in places] if like.any() else [], like):
                            other[a : b + 1] = False
                            x, y = _trimmed(text, starts[a], ends[b])
                            found += [(a, b, x, -1, y)] if x < y else []
                        key = text_key(text)
                        for a, b, x, kind, y in found:
                            ctx = np.concatenate(context_hashes(around[0][a : a + 1], around[1][a : a + 1], around[2][b : b + 1]))
                            instance = np.uint64(_hash(text[x:y])).view(np.int64).item()
                            rows += [(*key, c, instance, kind, x, y) for c, hit in zip(ctx.view(np.int64).tolist(), in_table(bits, ctx).tolist()) if hit]
                    for ctx in context_hashes(*(x[other] for x in around)):
                        others.append(ctx[in_table(bits, ctx)])
            ctx, n = np.unique(np.concatenate(others), return_counts=True) if others else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            m = len(ctx)
            cols = list(zip(*rows)) or [()] * 7
            whole = lambda at, kind, lead: pa.concat_arrays([lead, pa.array(cols[at], kind)])
            none, no_int = pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())
            yield pa.RecordBatch.from_arrays([
                whole(0, pa.int64(), none), whole(1, pa.int64(), none), whole(2, pa.int64(), pa.array(ctx.view(np.int64))), whole(3, pa.int64(), none),
                whole(4, pa.int32(), no_int), whole(5, pa.int32(), no_int), whole(6, pa.int32(), no_int), pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(rows), pa.int64())]),
            ], names=["a", "b", "context", "instance", "kind", "start", "end", "others"])

    return run


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The run without punctuation at its ends; an opening bracket of a number stays."""
    while a < b and not (text[a].isalnum() or text[a] in "(+"):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def induced(seeds: DataFrame, least: int = LEAST_SEEDS) -> DataFrame:
    """context, kind (most of its distinct seeds' kind; ties: the first), of contexts with enough distinct seeds."""
    of_kind = seeds.distinct().groupBy("context", "kind").agg(F.count(F.lit(1)).alias("n"))
    return of_kind.groupBy("context").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct("n", -F.col("kind"))).alias("like")).filter(F.col("n") >= least).select("context", "like")


def scored_patterns(fillers: DataFrame, patterns: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, floor: float = FLOOR) -> DataFrame:
    """context, like, confidence of the patterns that can reach ``floor``."""
    others = fillers.filter("kind is null").groupBy("context").agg(F.sum("others").alias("others"))
    edges = fillers.filter("kind is not null").groupBy("context", "instance").agg(F.max((F.col("kind") >= 0).cast("int")).alias("seed"))
    totals = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    known = patterns.join(totals, "context").join(others, "context", "left").select("context", "like", "n", F.coalesce("others", F.lit(0)).alias("others"))
    weight = F.col("n") + F.col("others") + prior
    known = cut(known.withColumn("weight", weight).filter(F.col("n") / F.col("weight") >= floor), "patterns-in-play")
    graph = cut(edges.join(known.select("context", "weight"), "context"), "pattern-graph")
    scores = graph.withColumn("score", F.col("seed").cast("double"))
    for turn in range(rounds):
        confidence = scores.groupBy("context").agg((F.sum("score") / F.first("weight")).alias("confidence"))
        confidence = cut(confidence, "pattern-confidence")
        if turn < rounds - 1:
            strong = graph.filter("seed = 0").join(confidence.filter(F.col("confidence") >= floor), "context")
            # 1 - confidence is above 0, as the prior is.
            found = strong.groupBy("instance").agg((1 - F.exp(F.sum(F.ln(1 - F.col("confidence"))))).alias("found"))
            scores = graph.join(found, "instance", "left").withColumn("score", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
    return known.select("context", "like").join(confidence, "context")


def scan(df: DataFrame, text: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """The columns of ``df`` but ``text``, plus ``base_spans`` and ``spans``: array<struct<start,rank,end>> in order
    of start and kind (rank: the place in KINDS + FOUND). Offsets are code points, ends exclusive."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in (text, "spans", "base_spans")]
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in rest])
    fields = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in rest)
    spans = "array<struct<start:int,rank:int,end:int>>"
    first = texts.mapInArrow(_seeds, f"{fields}_pd_a long, _pd_b long, _pd_base {spans}, _pd_seeds array<struct<kind:int,instance:bigint,context:bigint>>")
    first = cut(first, "personal-data")
    seeds = first.select(F.inline("_pd_seeds"))
    patterns = cut(induced(seeds), "context-patterns")
    shared = spark.sparkContext.broadcast(bit_table(patterns, "context"))
    # The texts are read again, not kept in a second copy.
    fillers = texts.select("text").mapInArrow(_fillers(shared), "a long, b long, context long, instance long, kind int, start int, end int, others long")
    # False hits of the bit table go here.
    fillers = cut(fillers.join(patterns.select("context"), "context", "left_semi"), "context-fillers")
    sure = scored_patterns(fillers, patterns).filter(F.col("confidence") >= confident)
    best = F.max_by("like", F.struct("confidence", -F.col("like")))
    found = fillers.filter("kind = -1").join(sure, "context").groupBy("a", "b", "start", "end").agg(best.alias("like"))
    span = F.struct("start", (F.col("like") + len(KINDS)).alias("rank"), "end")
    found = found.groupBy(F.col("a").alias("_pd_a"), F.col("b").alias("_pd_b")).agg(F.collect_list(span).alias("_pd_found"))
    out = first.join(cut(found, "personal-data-found"), ["_pd_a", "_pd_b"], "left")
    every = F.sort_array(F.concat("_pd_base", F.coalesce("_pd_found", F.array().cast(spans))))
    return out.select(*[F.col(f"`{c}`") for c in rest], F.col("_pd_base").alias("base_spans"), every.alias("spans"))


def written(spans: str):
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS + FOUND])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_context_bootstrap(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda r: F.size(F.filter("base_spans", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )
