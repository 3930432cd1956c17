"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are hashed into blocks. How many rows of block i go to shard j is drawn from the distribution
that a uniform permutation of all rows would give (multivariate hypergeometric, margins fixed to
the block counts and to shard sizes that differ by one at most). Each block then orders its rows by
a keyed hash and hands out its cells of the matrix in that order; each shard orders what it got by
a second hash. Only block counts (one number a block) meet on the driver.

Defined cases: null keys hash like any value; repeated rows take slots of their own; rows equal in all
order columns are interchangeable, and lie in one block whatever its bound, as nothing tells them
apart; an empty table gives an empty result; fewer rows than shards leave some shards empty; columns
named ``shard`` or ``slot`` are replaced, others are carried along, and names that begin with ``_hg_``
are reserved. Very long texts are moved as they are if they are carried; a digest of them will do as
an order column."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table, text_of


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts[i, j]: rows of block i for shard j; column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = int(sum(counts))
    left = np.full(n_shards, total // n_shards, dtype=np.int64)
    left[rng.permutation(n_shards)[: total % n_shards]] += 1
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, int(n), method="marginals") if n else 0
        left -= out[i]
    return out


def exact_shards(
    df: DataFrame,
    order: list[str],
    n_shards: int,
    seed: int = 42,
    rows_per_block: int = 1_000_000,
    min_blocks: int = 64,
) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, 0..n-1 in each shard).

    ``order``: the columns that tell rows apart. ``rows_per_block`` bounds what a task sorts: the
    number of blocks, and of the ranges into which a shard is dealt for its second permutation,
    grows with the table. The draw costs blocks x shards numbers on the driver."""
    keyed = cut(df.withColumn("_hg_key", F.xxhash64(F.lit(seed), *order)), "shard-rows")
    total = keyed.count()
    blocks = max(min_blocks, -(-total // rows_per_block))
    keyed = keyed.withColumn("_hg_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_hg_key"), F.lit(blocks)).cast("int"))
    per_block = {r[0]: r[1] for r in keyed.groupBy("_hg_block").count().collect()}
    matrix = communication_matrix([per_block.get(i, 0) for i in range(blocks)], n_shards, seed)
    cells = [{"_hg_block": i, "_hg_ends": row} for i, row in enumerate(matrix.cumsum(axis=1).tolist())]
    ends = df.sparkSession.range(1, numPartitions=1).select(
        F.inline(F.from_json(F.lit(json.dumps(cells)), "array<struct<_hg_block:int,_hg_ends:array<bigint>>>"))
    )
    ties = [F.col(c) for c in order]
    local = Window.partitionBy("_hg_block").orderBy("_hg_key", *ties)
    dealt = (
        keyed.withColumn("_hg_at", F.row_number().over(local) - 1)
        .join(F.broadcast(ends), "_hg_block")  # blocks x shards numbers
        .withColumn("shard", F.size(F.filter("_hg_ends", lambda e: e <= F.col("_hg_at"))))
        .drop("_hg_at", "_hg_ends", "_hg_block")
        .withColumn("_hg_key", F.xxhash64(F.lit(seed + 2), "_hg_key"))
    )
    ranges = max(1, -(-total // (n_shards * rows_per_block)))
    if ranges == 1:
        again = Window.partitionBy("shard").orderBy("_hg_key", *ties)
        return dealt.withColumn("slot", F.row_number().over(again).cast("long") - 1).drop("_hg_key")
    dealt = cut(dealt.withColumn("_hg_range", F.pmod(F.xxhash64(F.lit(seed + 3), "_hg_key"), F.lit(ranges)).cast("int")), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("_hg_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "_hg_range").count()
        .withColumn("_hg_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    again = Window.partitionBy("shard", "_hg_range").orderBy("_hg_key", *ties)
    return (
        dealt.withColumn("_hg_at", F.row_number().over(again) - 1)
        .join(starts, ["shard", "_hg_range"])
        .withColumn("slot", (F.col("_hg_start") + F.col("_hg_at")).cast("long"))
        .drop("_hg_key", "_hg_range", "_hg_start", "_hg_at")
    )


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder a shard, its rows in the order of their slots."""
    sharded.repartition(F.col(shard)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def stored_size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + 16


def op9_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    text = text_of()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", stored_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return exact_shards(docs, ["doc_id", "size", "text_crc32"], 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
