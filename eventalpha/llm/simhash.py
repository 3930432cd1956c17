"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, connected components.

Fingerprints. A text is lower-cased (A-Z only) and cut into words; each 4-word shingle is hashed
with XXH64; a bit is set if it is set in over half of the hashes.

Index. Documents with equal fingerprints are one node. Nodes meet in buckets: the 64 bits are cut
into blocks, and for every choice of ``shared`` blocks a node enters the bucket of its masked bit
pattern there. With 6 blocks, 2 of them shared, two fingerprints that differ in at most 4 bits agree
on at least 2 whole blocks, so no link is missed. The masked pattern is the root of the bucket's
tree; below it the fingerprints stand in Gray order (neighbours share long patterns), groups of
them carry the bits that all members share, and two groups are compared only if the differences
already accumulated on bits that both have fixed do not exceed the limit. Groups that are already
one component are skipped. A bucket hands on a spanning forest, not all pairs.

Large buckets. A bucket of over ``bucket_rows`` nodes is dealt out again by blocks of its other bits,
level by level, up to ``levels``; every link survives, because the argument above holds for the
rest of the bits.

Components. Large-star/small-star rounds over the forest edges, each a join and an aggregation
written to the shared folder. Nothing but row counts comes to the driver.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; fewer words than
a shingle hash as one sequence; rows with a null doc_id get no component (null) and link nothing;
rows that repeat a doc_id are one document (each row keeps its own fingerprint, and all link for the
document); an empty table gives an empty result; extra columns are not read, whatever their names. Very
long texts are read whole: a task holds one text's words and 8 bytes a shingle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, table

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint, unsigned."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, n).cumsum() + np.arange(n)
    starts = np.zeros(n, np.int64)
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def block_masks(mask: int, blocks: int) -> list[int]:
    """``mask`` cut into ``blocks`` runs of its bits, of near equal sizes."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Where the fingerprint stands in Gray order (the inverse of x ^ x >> 1)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def bucket_families(mask: int, blocks: int, distance: int) -> list[tuple[int, int]]:
    """(fixed bits, other bits) for every choice of the blocks of ``mask`` that a pair can share."""
    parts = block_masks(mask, blocks)
    fixed = (sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance))
    return [(f, mask & ~f) for f in fixed]


def links_in(fp: np.ndarray, distance: int, leaf: int = 16, fan: int = 8, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of "at most ``distance`` bits apart" among fingerprints in
    Gray order."""
    n = len(fp)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots() -> np.ndarray:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent[:] = up

    out: list[tuple[int, int]] = []

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        top = roots()
        fresh = top[a] != top[b]
        for i, j in zip(a[fresh].tolist(), b[fresh].tolist()):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))

    for step in range(1, min(leaf, n)):
        near = np.flatnonzero(np.bitwise_count(fp[:-step] ^ fp[step:]) <= distance)
        unite(near, near + step)
    if n <= leaf:
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    levels = []  # from the leaves up: bits set in all, bits set in any, first row of each group
    starts = np.arange(0, n, leaf)
    every, some = np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts)
    levels.append((every, some, starts))
    while len(levels[-1][0]) > 1:
        every, some, starts = levels[-1]
        at = np.arange(0, len(every), fan)
        levels.append((np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at), starts[at]))

    def open_pairs(level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every, some, starts = levels[level]
        fixed = ~(every ^ some)
        apart = np.bitwise_count((every[a] ^ every[b]) & fixed[a] & fixed[b])
        top = roots()
        low, high = np.minimum.reduceat(top, starts), np.maximum.reduceat(top, starts)
        done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        keep = (apart <= distance) & ~done
        return a[keep], b[keep]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        i = (a[:, None] * leaf + np.arange(leaf)[None, :])
        j = (b[:, None] * leaf + np.arange(leaf)[None, :])
        x, y = fp[np.minimum(i, n - 1)], fp[np.minimum(j, n - 1)]
        near = (np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= distance) & (i < n)[:, :, None] & (j < n)[:, None, :]
        p, q, r = np.nonzero(near)
        unite(i[p, q], j[p, r])

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), chunk // (fan * fan) if level else chunk // (leaf * leaf) * 8):
            step = chunk // (fan * fan) if level else chunk // (leaf * leaf) * 8
            x, y = open_pairs(level, a[at : at + step], b[at : at + step])
            if not len(x):
                continue
            if not level:
                compare(x, y)
                continue
            size = len(levels[level - 1][0])
            i = (x[:, None, None] * fan + np.arange(fan)[None, :, None])
            j = (y[:, None, None] * fan + np.arange(fan)[None, None, :])
            i, j = np.broadcast_to(i, (len(x), fan, fan)).ravel(), np.broadcast_to(j, (len(x), fan, fan)).ravel()
            keep = (i < size) & (j < size) & (i <= j)
            descend(level - 1, i[keep], j[keep])

    top = len(levels) - 1
    descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _forest(distance: int):
    """Over rows (family, pattern, fp, node) sorted by bucket and Gray rank: edges (a, b), a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def edges(family, pattern, fp, node):
            new = np.flatnonzero((family[1:] != family[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            starts = np.r_[0, new]
            sizes = np.diff(np.r_[starts, len(fp)])
            a_out, b_out = [], []
            group = np.repeat(np.arange(len(starts)), sizes)
            small = np.repeat(sizes <= 16, sizes)
            for step in range(1, 16):
                if len(fp) <= step:
                    break
                near = (group[:-step] == group[step:]) & small[:-step]
                if not near.any():
                    break
                i = np.flatnonzero(near)
                i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
                a_out.append(node[i])
                b_out.append(node[i + step])
            for at, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
                i, j = links_in(fp[at : at + size], distance)
                a_out.append(node[at + i])
                b_out.append(node[at + j])
            a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
            b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((
                batch.column(0).to_numpy(), batch.column(1).to_numpy(),
                batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(),
            ))
            family, pattern = held[-1][0], held[-1][1]
            # Hold back the last bucket, which may go on in the next batch.
            last = np.flatnonzero((family != family[-1]) | (pattern != pattern[-1]))
            if len(last):
                to = int(last[-1]) + 1
                tail = tuple(x[to:] for x in held[-1])
                held[-1] = tuple(x[:to] for x in held[-1])
                yield edges(*(np.concatenate(x) for x in zip(*held)))
                held = [tail]
            elif len(held) > 1 and (held[-2][0][-1] != family[0] or held[-2][1][-1] != pattern[0]):
                yield edges(*(np.concatenate(x) for x in zip(*held[:-1])))
                held = held[-1:]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_edges(nodes: DataFrame, distance: int = 4, blocks: int = 6, bucket_rows: int = 50_000, levels: int = 3) -> DataFrame:
    """Edges (a, b) that connect all nodes (fp, node) whose fingerprints differ in ``distance`` bits
    at most, directly or through others."""
    found: list[DataFrame] = []
    rows = nodes.select("fp", "node", F.lit(0).alias("family"), F.lit(0).cast("long").alias("pattern"))
    rest, used = {0: (1 << 64) - 1}, 0  # family -> bits not yet fixed
    for level in range(levels):
        names, entries = {}, []
        for parent, mask in rest.items():
            for fixed, other in bucket_families(mask, blocks, distance):
                used += 1
                names[used] = other
                entries.append((parent, used, _signed(fixed)))
        # A row for each way to choose blocks: 15, then at most 225 and 3,375, whatever the table.
        table_ = nodes.sparkSession.createDataFrame(entries, "family int, child int, mask long")
        # The pattern of all levels so far. Two patterns of one hash would only share a bucket.
        dealt = rows.join(F.broadcast(table_), "family").select(
            "fp", "node", F.col("child").alias("family"), F.xxhash64("pattern", F.col("fp").bitwiseAND(F.col("mask"))).alias("pattern"))
        if level == levels - 1:
            found.append(dealt)
            break
        counts = dealt.groupBy("family", "pattern").count().filter(F.col("count") > bucket_rows)
        large = cut(counts.drop("count"), "large-buckets")
        again = [r[0] for r in large.select("family").distinct().collect()]  # as many as families at most
        if not again:
            found.append(dealt)
            break
        found.append(dealt.join(large, ["family", "pattern"], "left_anti"))
        rows = cut(dealt.join(large, ["family", "pattern"], "left_semi"), "large-bucket-rows")
        rest = {f: names[f] for f in again}
    edges = None
    for rows in found:
        part = (
            rows.withColumn("gray", gray_rank(F.col("fp")))
            .repartition("family", "pattern")
            .sortWithinPartitions("family", "pattern", "gray")
            .select("family", "pattern", "fp", "node")
            .mapInArrow(_forest(distance), "a long, b long")
        )
        edges = part if edges is None else edges.unionByName(part)
    return edges.distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of every node with an edge; edges: (a, b), a < b."""
    def state_of(stars: DataFrame):
        return stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()

    stars = cut(edges.select(F.col("b").alias("v"), F.col("a").alias("m")), "star-edges")
    state = state_of(stars)
    for _ in range(rounds):
        both = stars.select("v", "m").union(stars.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("l")).withColumn("l", F.least("v", "l"))
        large = both.join(least, "v").filter(F.col("m") > F.col("v")).select(F.col("m").alias("v"), F.col("l").alias("m")).distinct()
        # small star: every neighbour below v, and v itself, gets v's least neighbour
        small = large.join(large.groupBy("v").agg(F.min("m").alias("l")), "v")
        before, stars = stars, cut(
            small.select(F.col("m").alias("v"), F.col("l").alias("m")).filter("v <> m")
            .union(small.select("v", F.col("l").alias("m"))).distinct(),
            "star-edges",
        )
        now = state_of(stars)
        forget(before)
        if now == state:
            return stars.select(F.col("v").alias("node"), F.col("m").alias("component"))
        state = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def components(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable) of every row."""
    prints = cut(fingerprints(df, key, text), "fingerprints")
    nodes = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    found = connected(near_edges(nodes, distance))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def op3_simhash_gray(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
