"""Benchmark decontamination: a BM25 index of test items, block-max WAND, verified overlap.

Test items are cut into units of at most ``UNIT`` words and indexed: term -> (unit, impact), where a
unit's impacts are its BM25 term scores divided by their sum, so that a passage that holds the whole
unit scores 1. Every document is cut into passages of 2 x ``UNIT`` words, ``UNIT`` apart, so each
unit-sized stretch lies whole in some passage, and each passage queries the index for *all* units
that score ``threshold`` or more.

Pruning never loses a unit. The most frequent terms are set aside as long as they hold at most
``common_share`` of any unit's score; what the other terms must then contribute is summed for whole
blocks of units from each term's maximal impact in the block, for all passages of a batch at once.
Passages with a block that can still reach the threshold go through block-max WAND: cursors in unit
order, a pivot from the terms' bounds, a jump over blocks whose maxima do not suffice.

A retrieved item is verified on words: of the 5-word shingles of the item, of its question (all
sentences but the last; the first half of a single one) and of its answer (the rest), the shares
found around the passage. An item is leaked at ``overlap`` of all shingles and at least half of both
parts. Every passage that retrieves an item is verified; the row is the best verified one.

The index is broadcast; its size is bounded: a benchmark of more than ``shard_words`` words is dealt
into several indexes, each with its own pass over the documents.

Defined cases: null and empty texts match nothing; an item of fewer than ``least`` words (by default a
shingle: five) is no evidence of a leak, as any text may hold it by chance, and matches nothing; repeated items are items of their own;
repeated documents give repeated rows; words are lower-cased runs of anything but ASCII white space
and punctuation; ties do not arise, since all units above the threshold are returned; a null doc_id
or item_id is carried along; an empty table of either kind gives an empty result; further columns are
not read, whatever their names. A very long text is matched whole: its words are held (some 12 times
its bytes), but passages are weighed against the index a few thousand at a time."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

UNIT, BLOCK, SHINGLE = 64, 16, 5
AT_ONCE = 1 << 17  # words matched at once; a longer text is matched alone
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SCHEMA = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def words_in(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [w for w in (words_in(s) for s in re.split(r"[.?!\n]+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    only = sentences[0] if sentences else []
    return only[: len(only) // 2], only[len(only) // 2 :]


def shingles(words: list[bytes], width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def share_found(words: list[bytes], within: list[bytes]) -> float:
    """The share of the shingles of ``words`` that ``within`` holds; 1 for no words."""
    wanted = shingles(words)
    if not wanted:
        return 1.0
    width = min(SHINGLE, len(words))
    return len(wanted & {tuple(within[i : i + width]) for i in range(len(within) - width + 1)}) / len(wanted)


@dataclass
class Index:
    """Arrays only, so that a worker reads it at once. Terms, units and blocks are numbers; the entries
    of term t stand at ``at[t]`` to ``at[t + 1]``, units ascending; likewise its blocks' greatest impacts."""

    threshold: float
    items: list[tuple[int, str]]
    owner: np.ndarray  # unit -> place in items
    vocabulary: dict[bytes, int]
    at: np.ndarray
    units: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray  # term -> greatest impact
    block_at: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    essential: np.ndarray  # term -> is it looked at for pruning
    aside_limit: np.ndarray  # block -> the most that set-aside terms give any of its units
    terms_read: dict = field(default_factory=dict)  # of this worker

    def __getstate__(self):
        return self.__dict__ | {"terms_read": {}}

    def term(self, t: int) -> tuple[list[int], list[float], float, dict[int, float]]:
        """Units, impacts, greatest impact and block -> greatest impact of a term."""
        if t not in self.terms_read:
            a, b, c, d = self.at[t], self.at[t + 1], self.block_at[t], self.block_at[t + 1]
            blocks = dict(zip(self.blocks[c:d].tolist(), self.block_most[c:d].tolist()))
            self.terms_read[t] = self.units[a:b].tolist(), self.impacts[a:b].tolist(), float(self.bounds[t]), blocks
        return self.terms_read[t]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (unit, score) of all units that score the threshold or more."""
        goal = self.threshold - 1e-9
        read = {t: self.term(t) for t in terms}
        cursors = [[read[t][0][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += read[t][2]
                if bound >= goal:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            block = unit // BLOCK
            if sum(read[t][3].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) >= goal:
                if cursors[0][0] == unit:
                    score = sum(read[t][1][at] for _, at, t in cursors[: pivot + 1])
                    if score >= goal:
                        found.append((unit, score))
                    target, moved = unit + 1, range(pivot + 1)
                else:
                    target, moved = unit, range(pivot)
            else:  # nothing before the block's end, or before the next cursor, can reach the goal
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target, moved = max(target, unit + 1), range(pivot + 1)
            for i in moved:
                _, at, t = cursors[i]
                at = bisect_left(read[t][0], target, at)
                cursors[i] = [read[t][0][at], at, t] if at < len(read[t][0]) else None
            cursors = [c for c in cursors if c]
        return found

    def survivors(self, ids: np.ndarray, cell: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Passages (two cells each, by the first) with a block that can reach the threshold. ``ids``
        are the terms (-1: none) in cell order, ``last`` marks the cells that end a document."""
        n_blocks = len(self.aside_limit)
        some = max(64, min(4096, (1 << 22) // n_blocks))
        found = []
        for start in range(0, len(last), some):  # so many cells at once, whatever a document's length
            stop = min(start + some + 1, len(last))  # the cell after them ends the last passage
            a, b = np.searchsorted(cell, [start, stop])
            part = ids[a:b]
            hit = np.flatnonzero(part >= 0)
            hit = hit[self.essential[part[hit]]]
            key = np.unique((cell[a:b][hit] - start) * len(self.essential) + part[hit])
            where, term = key // len(self.essential), key % len(self.essential)
            first = self.block_at[term]
            n = self.block_at[term + 1] - first
            offset = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            rows = stop - start
            # A float also where nothing is counted: bincount then returns integers.
            sums = np.bincount(np.repeat(where, n) * n_blocks + self.blocks[offset], self.block_most[offset], rows * n_blocks).astype(np.float64).reshape(rows, n_blocks)
            both = sums[: min(some, rows)].copy()
            after = sums[1 : len(both) + 1]
            both[: len(after)] += np.where(last[start : start + len(after), None], 0.0, after)
            found.append(start + np.flatnonzero((both + self.aside_limit[None, :] >= self.threshold - 1e-9).any(axis=1)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def build_index(items: list[tuple[int, str]], threshold: float, common_share: float = 0.35, k1: float = 1.2, b: float = 0.75) -> Index:
    bags, owner = [], []
    for at, (_, text) in enumerate(items):
        words = words_in(text)
        for start in range(0, len(words), UNIT):
            bags.append(Counter(words[start : start + UNIT]))
            owner.append(at)
    df = Counter(w for bag in bags for w in bag)
    mean = sum(sum(bag.values()) for bag in bags) / max(1, len(bags))
    vocabulary: dict[bytes, int] = {}
    rows: list[tuple[int, int, float]] = []
    for unit, bag in enumerate(bags):
        size = sum(bag.values())
        score = {
            w: np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
            for w, tf in bag.items()
        }
        whole = sum(score.values())
        rows += [(vocabulary.setdefault(w, len(vocabulary)), unit, float(score[w] / whole)) for w in sorted(score)]
    term, units, impacts = (np.array(c, k) for c, k in zip(zip(*rows), (np.int64, np.int64, np.float64)))
    order = np.lexsort((units, term))
    term, units, impacts = term[order], units[order], impacts[order]
    n_terms, n_units = len(vocabulary), len(bags)
    at = np.searchsorted(term, np.arange(n_terms + 1))
    starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(units // BLOCK) != 0)])
    most = np.maximum.reduceat(impacts, starts)
    # The most frequent terms are set aside while they hold at most ``common_share`` of any unit.
    aside, essential = np.zeros(n_units), np.ones(n_terms, bool)
    for t in np.argsort(-np.diff(at), kind="stable").tolist():
        u = units[at[t] : at[t + 1]]
        more = aside[u] + impacts[at[t] : at[t + 1]]
        if len(u) > 1 and more.max() <= common_share:
            aside[u] = more
            essential[t] = False
    return Index(
        threshold, items, np.array(owner), vocabulary, at, units, impacts, np.maximum.reduceat(impacts, at[:-1]),
        np.searchsorted(term[starts], np.arange(n_terms + 1)), units[starts] // BLOCK, most, essential, np.maximum.reduceat(aside, np.arange(0, n_units, BLOCK)),
    )


def _matcher(shared, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        parts = [(words_in(text), *question_and_answer(text)) for _, text in index.items]
        get = index.vocabulary.get

        def matches(docs: list[tuple[int, list[bytes]]]) -> list[tuple]:
            ids = np.concatenate([np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)) for _, w in docs])
            counts = np.array([len(w) for _, w in docs])
            cells = -(-counts // UNIT)
            base = np.r_[0, np.cumsum(cells)[:-1]]
            first = np.r_[0, np.cumsum(counts)[:-1]]
            cell = np.repeat(base, counts) + (np.arange(len(ids)) - np.repeat(first, counts)) // UNIT
            last = np.zeros(int(cells.sum()), bool)
            last[base + cells - 1] = True
            of = np.repeat(np.arange(len(docs)), cells)
            retrieved: dict[tuple[int, int], dict[int, float]] = {}  # (document, item) -> begin -> score
            for c in index.survivors(ids, cell, last).tolist():
                d = int(of[c])
                begin = (c - int(base[d])) * UNIT
                here = ids[first[d] + begin : first[d] + min(begin + 2 * UNIT, int(counts[d]))]
                for unit, score in index.search(np.unique(here[here >= 0]).tolist()):
                    begins = retrieved.setdefault((d, int(index.owner[unit])), {})
                    begins[begin] = max(score, begins.get(begin, 0.0))
            out = []
            for (d, item), begins in retrieved.items():
                best = None
                for begin, score in begins.items():
                    near = docs[d][1][max(0, begin - len(parts[item][0])) : begin + 2 * UNIT + len(parts[item][0])]
                    all_of, q, a = (share_found(part, near) for part in parts[item])
                    if all_of >= overlap and min(q, a) >= 0.5 and (best is None or (score, all_of) > best[:2]):
                        best = (score, all_of, q, a)
                if best:
                    out.append((docs[d][0], index.items[item][0], *best))
            return out

        for batch in batches:
            out, docs, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                words = words_in(text.as_py())
                if words:
                    docs.append((key.as_py(), words))
                    size += len(words)
                if size >= AT_ONCE:
                    out += matches(docs)
                    docs, size = [], 0
            if docs:
                out += matches(docs)
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def leaked_items(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.6,
    overlap: float = 0.8,
    shard_words: int = 2_000_000,
    least: int = SHINGLE,
) -> DataFrame:
    """One row for each document (doc_id, text) and leaked item (item_id, text) of the benchmark."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = -(-total // shard_words)
    out = spark.createDataFrame([], SCHEMA)
    for shard in range(shards):
        part = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text")
        items = [(r[0], r[1]) for r in part.collect() if len(words_in(r[1])) >= least]  # at most about shard_words words
        if items:
            found = docs.mapInArrow(_matcher(spark.sparkContext.broadcast(build_index(items, threshold)), overlap), SCHEMA)
            out = found if shard == 0 else out.unionByName(found)
    return out


def op5_bm25_wand(spark, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")])
