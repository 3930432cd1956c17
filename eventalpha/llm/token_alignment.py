"""Alignment of two tokenizers' tokens, and how often their ids correspond in a corpus.

Both tokenizers encode the same bytes: a space and the text. Byte offsets at which a token of A and a
token of B both end cut the tokens into groups. The cuts are found by divide and conquer: in an interval
of tokens the common end nearest to the middle is located by bisecting the other side's ends, and both
halves go on; an interval without an inner cut is a leaf, a group. All intervals of a batch take a step
together, so a step is a few array operations.

Units. A byte-level pre-tokenizer and pieces that hold a space only in front never join what comes before
a space with the space, if a visible character stands there. So the text is dealt into units at these
places, which are common ends, and a batch encodes each distinct unit once. ``Tokenizers`` looks at both
models first; where one can join across, the whole text is one unit.

Links are all pairs of an A and a B occurrence in one group. An id pair's count is the number of rows that
hold it linked. Counts are summed from each row's distinct pairs, with partial sums before the shuffle.
To bring them back, the ``SHORT_LIST`` most frequent pairs at most are broadcast (a proven bound, 6 MB); all other
pairs, each of them rare, are joined.

Defined cases: a null or empty text, and a text whose tokens do not join to the same bytes (one that holds
U+2581, for one), has no tokens; repeated rows count as rows of their own; an empty table gives an empty
result; the columns named in ``MADE`` are replaced, further columns pass through, and names that begin with
``_al_`` are reserved. Very long texts are read whole: a task holds one text's tokens, links and distinct
pairs; a group of m and n tokens is held as its distinct ids, not as m x n occurrences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

AT_ONCE = 1 << 22  # characters encoded together; a longer text alone
CHUNK = 1 << 16  # bytes of joined units given to a tokenizer at once
PAIRED = 64  # groups of up to so many links are paired by occurrences, larger ones by distinct ids
SHORT_LIST = 1 << 18
MADE = ("a_ids", "b_ids", "a_sizes", "b_sizes", "pairs", "times")
PAIR_BITS = 24  # an id pair as one long: a << PAIR_BITS | b

_UNIT = re.compile(r"(?<=\S)(?= )")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary -> the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tokenizers:
    """A, a byte-level BPE in a JSON file, and B, a SentencePiece model."""

    a_path: str | None = None
    b_path: str | None = None

    def __post_init__(self):
        import public_tokenizers
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(self.a_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.b_path or public_tokenizers.path("piece_bpe_32k.model"))
        at = byte_characters()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(at[c] for c in name) if all(c in at for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.before = self.b.encode("x")  # what stands in front of a unit that is encoded alone
        splits = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None
        self.in_units = splits and not any("▁" in p.lstrip("▁") for p in pieces)

    def units(self, text: str) -> list[str]:
        """The space and the text, in units."""
        return _UNIT.split(" " + text) if self.in_units else [" " + text]

    def _whole(self, unit: str) -> tuple[list[int], list[int]]:
        a = self.a.encode(unit, add_special_tokens=False).ids
        # A unit begins with a space, so a word in front of it ends in a token of its own.
        b = self.b.encode("x" + unit)[len(self.before) :] if self.in_units else self.b.encode(unit[1:])
        return a, b

    def encode(self, coded: pa.Array, open_ends: set[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all units, the numbers of them up to each unit's end, and which units do not
        come back as they were. ``open_ends`` has the units that end in white space."""
        units, lengths = coded.to_pylist(), pc.binary_length(coded).to_numpy().astype(np.int64)
        bad = np.zeros(len(units), bool)
        a_ids, b_ids, a_upto, b_upto = [], [], [], []
        a_n = b_n = 0

        def keep(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> None:
            nonlocal a_n, b_n
            a_ids.append(a)
            b_ids.append(b)
            a_upto.append(a_at + a_n)
            b_upto.append(b_at + b_n)
            a_n, b_n = a_n + len(a), b_n + len(b)

        def alone(at: int) -> None:
            a, b = self._whole(units[at])
            raw = units[at].encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
                bad[at], a, b = True, [], []
            keep(np.array(a, np.int64), np.array(b, np.int64), np.array([len(a)]), np.array([len(b)]))

        def together(first: int, last: int) -> None:
            text = "".join(units[first:last])
            raw = text.encode()
            a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw:
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                ends = np.cumsum(lengths[first:last])
                a_at = np.searchsorted(np.cumsum(self.a_lengths[a]), ends, side="right")
                b_at = np.searchsorted(np.cumsum(self.b_lengths[b]), ends, side="right")
                keep(a, b, a_at, b_at)
            else:  # some unit is changed by a tokenizer
                for at in range(first, last):
                    alone(at)

        # What ends in white space would meet the next unit's: it is encoded alone.
        lonely = range(len(units)) if not self.in_units else [at for at, u in enumerate(units) if u in open_ends] if open_ends else []
        upto, first = np.r_[0, np.cumsum(lengths)], 0
        for at in [*lonely, len(units)]:
            while first < at:  # about CHUNK bytes at once
                last = min(at, max(first + 1, int(np.searchsorted(upto, upto[first] + CHUNK, side="right")) - 1))
                together(first, last)
                first = last
            if at < len(units):
                alone(at)
                first = at + 1
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return join(a_ids), join(b_ids), join(a_upto), join(b_upto), bad


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of A's ends are cuts, for intervals of A's tokens (from ``low``, up to ``high`` exclusive) whose
    own ends are known to be cuts. Each round splits all open intervals at the common end nearest to
    their middle; the search around it widens twofold until it meets one or has seen the interval."""
    is_cut = np.zeros(len(a_ends), bool)
    is_cut[high[high > low] - 1] = True
    high = high - 1  # the inner ends
    while True:
        keep = high > low
        low, high = low[keep], high[keep]
        if not len(low):
            return is_cut
        middle = (low + high) // 2
        place = np.full(len(low), -1)
        look, reach = np.arange(len(low)), 4
        while len(look):
            a, b = np.maximum(low[look], middle[look] - reach), np.minimum(high[look], middle[look] + reach + 1)
            sizes = b - a
            at = ragged(a, sizes)
            twin = np.minimum(np.searchsorted(b_ends, a_ends[at]), len(b_ends) - 1)
            apart = np.abs(at - np.repeat(middle[look], sizes)) * 2 + (at > np.repeat(middle[look], sizes))
            apart[b_ends[twin] != a_ends[at]] = np.iinfo(np.int64).max
            nearest = np.minimum.reduceat(apart, np.cumsum(sizes) - sizes)
            met = nearest < np.iinfo(np.int64).max
            step = np.where(nearest & 1, nearest >> 1, -(nearest >> 1))
            place[look[met]] = middle[look[met]] + step[met]
            look = look[~met & ((a > low[look]) | (b < high[look]))]
            reach *= 2
        cut_here = place >= 0
        low, high, place = low[cut_here], high[cut_here], place[cut_here]
        is_cut[place] = True
        low, high = np.r_[low, place + 1], np.r_[place, high]


def links(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id pairs linked in groups of so many tokens of A and B each: group, pair and times."""
    a_first, b_first = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    product = a_sizes * b_sizes
    small = np.flatnonzero((product > 0) & (product <= PAIRED))
    of = np.repeat(small, product[small])
    nth = np.arange(len(of)) - np.repeat(np.cumsum(product[small]) - product[small], product[small])
    pair = a[a_first[of] + nth // b_sizes[of]] << PAIR_BITS | b[b_first[of] + nth % b_sizes[of]]
    groups, pairs, times = [of], [pair], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(product > PAIRED).tolist():
        x, nx = np.unique(a[a_first[g] : a_first[g] + a_sizes[g]], return_counts=True)
        y, ny = np.unique(b[b_first[g] : b_first[g] + b_sizes[g]], return_counts=True)
        groups.append(np.full(len(x) * len(y), g))
        pairs.append((x[:, None] << PAIR_BITS | y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


def summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (owner, pair, times), one for each owner and pair."""
    bits = int(pair.max()).bit_length() if len(pair) else 0
    if len(pair) and int(owner.max()).bit_length() + bits < 63:
        order = np.argsort(owner << bits | pair)
    else:
        order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(pair) != 0)]) if len(owner) else np.zeros(0, np.int64)
    return owner[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def align_texts(texts: list[str], tools: Tokenizers) -> list[pa.Array]:
    """The columns of ``MADE`` for texts that are encoded together."""
    split = [tools.units(t) if t else [] for t in texts]
    counts = np.array([len(u) for u in split], np.int64)
    coded = pa.array([u for units in split for u in units], pa.string()).dictionary_encode()
    unit = coded.indices.to_numpy().astype(np.int64)
    a, b, a_upto, b_upto, bad = tools.encode(coded.dictionary, {u[-1] for u in split if u and u[-1][-1].isspace()})
    owner = np.repeat(np.arange(len(texts)), counts)
    spoiled = np.zeros(len(texts), bool)
    spoiled[owner[bad[unit]]] = True
    keep = ~spoiled[owner]
    unit, owner = unit[keep], owner[keep]

    # Groups of the distinct units, and what they link.
    a_low, b_low = np.r_[0, a_upto[:-1]][: len(a_upto)], np.r_[0, b_upto[:-1]][: len(b_upto)]
    a_ends, b_ends = np.cumsum(tools.a_lengths[a]), np.cumsum(tools.b_lengths[b])
    cuts = np.flatnonzero(shared_cuts(a_ends, b_ends, a_low, a_upto)) if len(a) else np.zeros(0, np.int64)
    a_sizes = np.diff(np.r_[0, cuts + 1])
    b_sizes = np.diff(np.r_[0, np.searchsorted(b_ends, a_ends[cuts], side="right")]) if len(a) else cuts
    group_upto = np.searchsorted(cuts, a_upto)
    group_low = np.r_[0, group_upto[:-1]][: len(group_upto)]
    group, pair, times = links(a, b, a_sizes, b_sizes)
    of_unit, pair, times = summed(np.searchsorted(group_upto, group, side="right"), pair, times)
    link_low = np.searchsorted(of_unit, np.arange(len(a_upto)))
    link_n = np.searchsorted(of_unit, np.arange(len(a_upto)), side="right") - link_low

    # Back to the texts: each unit occurrence takes a copy of its unit's rows.
    def spread(values: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return values[ragged(low[unit], n[unit])], np.bincount(owner, n[unit], len(texts)).astype(np.int64)

    once = np.unique(owner * max(1, len(a_upto)) + unit, return_counts=True)
    who, what = np.divmod(once[0], max(1, len(a_upto)))
    at = ragged(link_low[what], link_n[what])
    who, pair, times = summed(np.repeat(who, link_n[what]), pair[at], times[at] * np.repeat(once[1], link_n[what]))
    per_text = np.bincount(who, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return [
        _lists(*spread(a, a_low, a_upto - a_low), pa.int32()), _lists(*spread(b, b_low, b_upto - b_low), pa.int32()),
        _lists(*spread(a_sizes, group_low, group_upto - group_low), pa.int32()), _lists(*spread(b_sizes, group_low, group_upto - group_low), pa.int32()),
        _lists(pair, per_text, pa.int64()), _lists(times, per_text, pa.int64()),
    ]


def _in_portions(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Where a portion of the batch begins, and its texts."""
    held, first, size = [], 0, 0
    for at, text in enumerate(batch.column(batch.schema.get_field_index(column))):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= AT_ONCE:
            yield first, held
            held, first, size = [], at + 1, 0
    if held:
        yield first, held


def aligned_batches(batches: Iterator[pa.RecordBatch], column: str, a_path: str | None = None, b_path: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches, ``column`` (of texts) replaced by the columns of ``MADE``."""
    tools = Tokenizers(a_path, b_path)
    for batch in batches:
        for first, texts in _in_portions(batch, column):
            some = batch.slice(first, len(texts)).drop_columns([column])
            yield pa.RecordBatch.from_arrays([*some.columns, *align_texts(texts, tools)], names=[*some.schema.names, *MADE])


def align(df: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``df`` plus A's and B's ids, the groups' numbers of them, and the distinct linked id pairs
    (a << ``PAIR_BITS`` | b) with the number of their links."""
    kept = [c for c in df.columns if c not in MADE]
    rest = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_al_text"))
    fields = ", ".join(f"`{c}` {rest.schema[c].dataType.simpleString()}" for c in kept)
    kinds = ", ".join(f"{c} array<{k}>" for c, k in zip(MADE, ("int", "int", "int", "int", "long", "long")))
    return rest.mapInArrow(lambda batches: aligned_batches(batches, "_al_text", a_path, b_path), f"{fields}, {kinds}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, rows (how many rows hold it linked), best (is that its A id's highest; ties included)."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("rows")), "pair-counts")
    a = F.shiftright("pair", PAIR_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("rows").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "rows", (F.col("rows") == F.col("most")).alias("best"))


def _looked_up(shared):
    """Rows (key, pairs, times) -> a row of sums over the pairs in the list, and a row for each other pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, best = shared.value
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column(0).to_numpy()
            owner = np.repeat(np.arange(len(key)), sizes)
            pair, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            here = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = np.zeros((2, len(key)), np.int64)
            np.add.at(sums[0], owner[here], times[here] * best[at[here]])
            np.add.at(sums[1], owner[here], times[here] * rows[at[here]])
            n = len(key)
            other = np.flatnonzero(~here)
            empty = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[key, key[owner[other]]]), pa.concat_arrays([empty, pa.array(pair[other])]), pa.array(np.r_[np.zeros(n, np.int64), times[other]]),
                pa.array(np.r_[sums[0], np.zeros(len(other), np.int64)]), pa.array(np.r_[sums[1], np.zeros(len(other), np.int64)]),
            ], names=["key", "pair", "times", "n_best", "count_sum"])

    return run


def link_sums(aligned: DataFrame, key: str, short_list: int = SHORT_LIST) -> DataFrame:
    """``key``, n_best, count_sum of every row of ``aligned`` (a written table whose key tells rows apart):
    links whose pair is the best of its A id, and the sum of the pairs' counts over all links."""
    spark = aligned.sparkSession
    counts = cut(pair_counts(aligned), "pairs-counted")
    # The least count, in steps of an eighth of an octave, from which on at most ``short_list`` pairs have it.
    step = F.floor(F.log2("rows") * 8).cast("int")
    least, held = 1 << 30, 0
    for bin_, n in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):  # at most 512 rows
        held += n
        if held > short_list:
            break
        least = bin_
    top = counts.filter(step >= least).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(top[c].cast(pa.int64()).to_numpy()[order] for c in ("pair", "rows", "best")))
    looked = aligned.select(F.col(key).alias("key"), "pairs", "times").mapInArrow(_looked_up(shared), "key long, pair long, times long, n_best long, count_sum long")
    looked = cut(looked, "pairs-looked-up")
    rare = looked.filter("pair is not null").select("key", "pair", "times").join(counts, "pair").select(
        "key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("rows")).alias("count_sum"))
    known = looked.filter("pair is null").select("key", "n_best", "count_sum")
    return known.unionByName(rare).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).withColumnRenamed("key", key)


def groups_written(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, names: list[bytes]) -> bytes:
    """``a1,a2|b1;a3|b2,b3``. ``names``: for each number its digits followed by a comma, a bar, a semicolon."""
    a_last, b_last = np.cumsum(a_sizes) - 1, np.cumsum(b_sizes) - 1
    a_kind, b_kind = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_kind[a_last], b_kind[b_last] = 1, 2
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)] = a * 3 + a_kind
    out[np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)] = b * 3 + b_kind
    return b"".join(map(names.__getitem__, out.tolist()))[:-1]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over doc_id and the columns of ``MADE``: the query's columns, and the pairs."""
    names: list[bytes] = []
    for batch in batches:
        made = [batch.column(i) for i in range(1, 5)]
        starts = [np.r_[0, np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))] for c in made]
        flat = [c.flatten().to_numpy().astype(np.int64) for c in made]
        top = max([0, *(int(x.max()) + 1 for x in flat[:2] if len(x))])
        names += [b"%d%s" % (i, end) for i in range(len(names) // 3, top) for end in (b",", b"|", b";")]
        hashes, n_links = [], []
        for i in range(batch.num_rows):
            a, b, m, n = (f[s[i] : s[i + 1]] for f, s in zip(flat, starts))
            hashes.append(hashlib.sha256(groups_written(a, b, m, n, names)).hexdigest() if len(a) else "")
            n_links.append(int((m * n).sum()))
        sizes = [pa.array(np.diff(s)) for s in starts[:3]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *sizes, pa.array(n_links, pa.int64()), pa.array(hashes, pa.string()), batch.column(5), batch.column(6)],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def op11_shared_cuts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = docs.mapInArrow(
        lambda batches: _digested(aligned_batches(batches, "text")),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")
    digests = cut(digests.withColumn("_al_row", F.monotonically_increasing_id()), "aligned")
    sums = link_sums(digests, "_al_row")
    return digests.join(sums, "_al_row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
