"""Repeated passages across documents, located by sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words. A word goes if a window over it also starts in a document
with a smaller id. No pass compares documents with each other:

1. Anchors. Of the ``GRAM``-word sequences in a window the one with the least hash is its anchor;
   equal windows have equal anchors, and neighbours mostly share one, so a text of n words sends
   about n / 5 short rows (hash, document) instead of n, and a stretch that repeats a few words over
   and over sends one.
2. Sorted by hash, a run with one document is dropped; the rest are recurring anchors.
3. Documents with recurring anchors (by a join on doc_id) send, for each, the passage (the words of
   the windows that it stands for) to the anchor's shard.
4. A shard takes its sorted rows in blocks. It confirms what recurs (the whole passage, where all
   documents have the same one, else the single windows that two documents hold), compiles that into
   an automaton with each phrase's first document, and streams every distinct passage of the block
   through it; a hit is an occurrence to remove in all later documents with that passage. Hashes
   only route: what is removed was matched as text.
5. The places go back to their documents by doc_id (the same exchange of texts as in step 3), and
   the covered words are cut out.

Not every document goes through every automaton: that work would grow with documents times phrases.
Every stretch of every document that holds a recurring anchor goes through the automaton of that
anchor's shard, and no other stretch can hold one of its phrases.

Memory: a task holds a block of rows and its automaton, or for one endless run of a single anchor
the distinct passages of that run (copies of one passage are one); the rows themselves stream.

Defined cases: a null text has no words; rows with a null doc_id are passed over (nothing is removed
from them and they are no source); rows that repeat a doc_id are one document; where their texts
differ, the text of the least hash is the document's, and rows with other texts are passed over like
those without an id; a phrase that repeats only within one document stays; an empty table gives an
empty result; further columns are not read, whatever their names. A very long text is hashed ``PIECE``
words at a time; its words are held as a list (some 10 times its bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, text_of, words_of

WINDOW, GRAM = 13, 5
CHUNK = 1 << 20  # bytes of text hashed at once
PIECE = 1 << 16  # words of one text that are hashed together; pieces overlap by a window less a word
BLOCK = 8192  # rows for one automaton

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = made
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes], list[int], list[int]]]:
    """(row in the batch, id, words joined by one space, number of words, place of the first of them)
    of the pieces of rows with a window. Every window lies in one piece."""
    rows, ids, parts, counts, offsets, size = [], [], [], [], [], 0
    keys = batch.column(0).to_pylist()
    for at, text in enumerate(batch.column(1)):
        text = text.as_py()
        if text is None or keys[at] is None:
            continue
        words = text.encode().split()
        for begin in range(0, len(words) - WINDOW + 1, PIECE):
            piece = words[begin : begin + PIECE + WINDOW - 1]
            rows.append(at)
            ids.append(keys[at])
            parts.append(b" ".join(piece))
            counts.append(len(piece))
            offsets.append(begin)
            size += len(parts[-1])
            if size >= CHUNK:
                yield rows, ids, parts, counts, offsets
                rows, ids, parts, counts, offsets, size = [], [], [], [], [], 0
    if rows:
        yield rows, ids, parts, counts, offsets


def _anchored(parts: list[bytes], counts: list[int]):
    """For all windows of the texts: first word, anchor hash, text; all word starts and ends (bytes in
    the joined texts) and each text's first word."""
    joined = b" ".join(parts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.r_[0, ends[:-1] + 1]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:], dtype=np.uint64)
    hashes = _mixed((sums[ends[GRAM - 1 :]] - sums[starts[: len(starts) - GRAM + 1]]) * down[starts[: len(starts) - GRAM + 1]])
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(owner) - WINDOW + 1
    best = hashes[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(best, hashes[j : j + n], out=best)
    window = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    first = np.r_[0, np.cumsum(counts)[:-1]]
    return window, best[window].view(np.int64), owner[window], joined, starts, ends, first


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, ids, parts, counts, _ in _chunks(batch):
            _, h, owner, _, _, _, _ = _anchored(parts, counts)
            new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
            h, doc = h[new], np.array(ids, np.int64)[owner[new]]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc)], names=["h", "doc_id"])


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id) in that order: those whose h has two documents at least."""
    held: list[np.ndarray] | None = None
    going_on = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc = (c.to_numpy() for c in batch.columns)
        if held is not None:
            h, doc = (np.concatenate(x) for x in zip(held, (h, doc)))
            held = None
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        ends = np.r_[starts[1:], len(h)]
        recurs = doc[starts] != doc[ends - 1]
        if going_on is not None and h[0] == going_on:
            recurs[0] = True
        going_on = h[-1] if recurs[-1] else None
        if not recurs[-1]:
            held = [x[starts[-1] :] for x in (h, doc)]
        keep = np.repeat(recurs, ends - starts)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(doc[keep])], names=["h", "doc_id"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, anchors): for each recurring anchor the words of the windows it stands for."""
    for batch in batches:
        wanted_of = batch.column(2)
        for rows, ids, parts, counts, offsets in _chunks(batch):
            window, h, owner, joined, starts, ends, first = _anchored(parts, counts)
            # An anchor that recurs for another text of the chunk only brings candidates for nothing.
            keep = np.isin(h, np.concatenate([np.asarray(wanted_of[r].values) for r in rows]))
            window, h, owner = window[keep], h[keep], owner[keep]
            if not len(window):
                continue
            # Windows in a row with one anchor hash: mostly around one word, many in a stretch that repeats itself.
            at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (window[1:] != window[:-1] + 1) | (owner[1:] != owner[:-1])])
            n = np.diff(np.r_[at, len(h)])
            w, o = window[at], owner[at]
            texts = [joined[a:b].decode() for a, b in zip(starts[w].tolist(), ends[w + n + WINDOW - 2].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at]), pa.array(np.array(ids, np.int64)[o]), pa.array((w - first[o] + np.array(offsets)[o]).astype(np.int32)), pa.array(texts, pa.string())],
                names=["h", "doc_id", "start", "passage"],
            )


class Run:
    """The rows of one anchor: passages, where each stands, and what is known from earlier rows."""

    def __init__(self) -> None:
        self.places: dict[str, list[tuple[int, int]]] = {}  # of the present block, documents ascending
        self.first: dict[str, int] = {}  # passage -> its first document
        self.windows: dict[str, tuple[int, bool]] = {}  # window -> first document, has it another

    def confirmed(self) -> Iterator[tuple[str, int, int]]:
        """(phrase, windows in it, first document) of what more than one document holds."""
        fresh = [p for p in self.places if p not in self.first]
        whole = not self.windows and len(self.first) + len(fresh) == 1
        known = [] if whole or self.windows else list(self.first)
        for p in fresh:
            self.first[p] = self.places[p][0][0]
        if whole:
            (passage, source), = self.first.items()
            if self.places[passage][-1][0] > source:
                yield passage, passage.count(" ") - WINDOW + 2, source
            return
        for passage in dict.fromkeys([*known, *self.places]):
            source = self.first[passage]
            again = passage in self.places and self.places[passage][-1][0] > source
            words = passage.split(" ")
            for j in range(len(words) - WINDOW + 1):
                phrase = " ".join(words[j : j + WINDOW])
                if phrase in self.windows:
                    before, more = self.windows[phrase]
                    self.windows[phrase] = (min(before, source), more or again or before != source)
                else:
                    self.windows[phrase] = (source, again)
        for passage in self.places:
            words = passage.split(" ")
            for j in range(len(words) - WINDOW + 1):
                phrase = " ".join(words[j : j + WINDOW])
                source, more = self.windows[phrase]
                if more:
                    yield phrase, 1, source


def locate(runs: list[Run]) -> list[tuple[int, int, int]]:
    """Ranges (doc, first window, windows) to remove."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for run in runs:
        for phrase, n, source in run.confirmed():
            automaton.add_word(f" {phrase} ", (len(phrase) + 1, n, source))
    if not len(automaton):
        return []
    automaton.make_automaton()
    out = []
    for run in runs:
        for passage, places in run.places.items():
            text = f" {passage} "
            hits, place, word = [], 0, 0
            for end, (length, n, source) in automaton.iter(text):
                start = end - length
                word = word + text.count(" ", place, start) if start >= place else text.count(" ", 0, start)
                place = start
                hits.append((word, n, source))
            if len(hits) == 1:
                word, n, source = hits[0]
                out += [(doc, start + word, n) for doc, start in places if doc > source]
                continue
            for doc, start in places if hits else ():
                begin, size = -1, 0
                for word, n, source in hits:
                    if source >= doc:
                        continue
                    if size and word == begin + size:
                        size += n
                        continue
                    if size:
                        out.append((doc, start + begin, size))
                    begin, size = word, n
                if size:
                    out.append((doc, start + begin, size))
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id, start, passage) in order of h, doc_id and start."""
    runs: list[Run] = []
    key, held = None, 0

    def flush():
        found = locate(runs)
        cols = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())],
            names=["doc_id", "start", "n"],
        )

    for batch in batches:
        for h, doc, start, passage in zip(*(c.to_pylist() for c in batch.columns)):
            if h != key or not runs:
                if held >= BLOCK:
                    yield flush()
                    runs, held = [], 0
                runs.append(Run())
                key = h
            elif held >= 4 * BLOCK:  # a run of one anchor goes on: its passages stay known
                yield flush()
                runs, held = runs[-1:], 0
                runs[0].places = {}
            places = runs[-1].places
            if passage in places:
                places[passage].append((doc, start))
            else:
                places[passage] = [(doc, start)]
            held += 1
    if runs:
        yield flush()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, ranges): the words that stay."""
    for batch in batches:
        kept_texts, totals, removed = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode().split()
            n_gone = 0
            totals.append(len(words))
            if ranges.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                flat = ranges.values
                at = flat.field("start").to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + flat.field("n").to_numpy() + WINDOW - 1, -1)
                gone = gone.cumsum()[:-1] > 0
                n_gone = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept_texts.append(b" ".join(words).decode())
            removed.append(n_gone)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept_texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
            names=["doc_id", "kept", "n_words", "n_removed"],
        )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed of every row."""
    every = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digest = F.xxhash64(text_of())
    texts = every.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most"))
    clashing = cut(texts.filter("least <> most").select("doc_id", "least"), "clashing-ids")
    is_document = F.col("doc_id").isNotNull()
    if clashing.count():
        every = every.join(clashing, "doc_id", "left")
        is_document = is_document & (F.col("least").isNull() | (F.col("least") == digest))
        every = every.select("doc_id", "text", is_document.alias("is_document"))
        is_document = F.col("is_document")
    # The same filter stands before both joins, so that they share one exchange of the texts.
    docs = every.filter(is_document)
    places = (
        docs.mapInArrow(_anchor_rows, "h long, doc_id long")
        .repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(_recurring, "h long, doc_id long")
        .groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))
    )
    ranges = (
        docs.join(places, "doc_id").select("doc_id", "text", "anchors")
        .mapInArrow(_passages, "h long, doc_id long, start int, passage string")
        .repartition("h").sortWithinPartitions("h", "doc_id", "start")
        .mapInArrow(_occurrences, "doc_id long, start int, n int")
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    )
    cut_down = docs.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(
        _cut_out, "doc_id long, kept string, n_words long, n_removed long"
    )
    words = words_of(text_of())
    passed_over = every.filter(~is_document).select(
        "doc_id", F.array_join(words, " ").alias("kept"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")
    )
    return cut_down.unionByName(passed_over)


def op8_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP8_SQL = """
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)),
own AS (SELECT g, min(doc_id) AS source FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN own USING (g), (SELECT unnest(range(0, 13)) AS k) WHERE source < doc_id),
flat AS (SELECT s.doc_id, s.i, s.word, g.i IS NOT NULL AS cut FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split) s
  LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i),
kept AS (SELECT doc_id, count(*) FILTER (cut) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT cut) AS text FROM flat GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
