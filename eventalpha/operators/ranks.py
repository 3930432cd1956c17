"""Order statistics and row numbers of whole tables without one task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.sources.tables import scratch


def with_rank(df: DataFrame, order: list[str], out: str = "_rank") -> DataFrame:
    """``df`` plus ``out``: the row's number from 0 in the order of the columns, which must tell all rows
    apart. Rows are sorted by range; only the partitions' sizes meet on the driver."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranked")
    # The upper bits of the number are the partition, the lower ones the place in it.
    at = F.monotonically_increasing_id()
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).write.parquet(path)
    ranked = spark.read.parquet(path)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(ranked.groupBy(part.alias("p")).count().collect())
    starts, before = [], 0
    for p in sorted(sizes):
        starts.append((int(p), before))
        before += sizes[p]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    return ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + place).drop("_part", "_before", "_at")


def tile(rank: Column, n: Column | int, tiles: int) -> Column:
    """Which of ``tiles`` near equal runs of n rows (1, 2, ...) the row with this number is in, the longer
    runs first, as ``ntile`` has it."""
    n = F.lit(n) if isinstance(n, int) else n
    size, longer = F.floor(n / tiles), n % tiles
    head = longer * (size + 1)
    return F.when(rank < head, F.floor(rank / (size + 1))).otherwise(longer + F.floor((rank - head) / F.greatest(size, F.lit(1)))).cast("int") + 1


def percentiles(df: DataFrame, value: str, shares: list[float]) -> tuple[int, list[float]]:
    """Number of values, and their exact percentiles, interpolated as ``percentile`` does. Approximate ones
    bracket each; only the distinct values within the brackets, some 8 in 10,000 of the rows, are sorted, each
    bracket's in one task."""
    v = F.col(value).cast("double")
    n = df.agg(F.count(v)).first()[0]
    if not n:
        return 0, []
    width = 4 / 10_000 + 2 / n
    sides = [max(0.0, s - width) for s in shares] + [min(1.0, s + width) for s in shares]
    ends = df.agg(F.percentile_approx(v, F.array(*[F.lit(s) for s in sides]), 10_000)).first()[0]
    brackets = list(zip(ends[: len(shares)], ends[len(shares) :]))
    below = df.agg(*[F.count_if(v < low).alias(f"b{i}") for i, (low, _) in enumerate(brackets)]).first()
    inside = F.array(*[F.when(v.between(low, high), F.lit(i)) for i, (low, high) in enumerate(brackets)])
    near = df.filter(v.isNotNull()).select(v.alias("v"), F.explode(F.filter(inside, lambda i: i.isNotNull())).alias("i")).groupBy("i", "v").count()
    ahead = F.sum("count").over(Window.partitionBy("i").orderBy("v"))
    wanted = [(i, int(at)) for i, s in enumerate(shares) for at in {s * (n - 1) // 1, -(-s * (n - 1) // 1)}]
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k - below[i]).cast("long").alias("k"), F.lit(k).cast("long").alias("at")) for i, k in wanted])
    rows = near.withColumn("end", ahead).withColumn("w", F.explode(at)).filter(
        (F.col("w.i") == F.col("i")) & (F.col("w.k") < F.col("end")) & (F.col("w.k") >= F.col("end") - F.col("count"))
    )
    found = {(r[0], r[1]): r[2] for r in rows.select("i", "w.at", "v").collect()}  # two values a share
    out = []
    for i, s in enumerate(shares):
        low = int(s * (n - 1) // 1)
        high = int(-(-s * (n - 1) // 1))
        part = s * (n - 1) - low
        out.append(found[i, low] if low == high else found[i, low] * (1 - part) + found[i, high] * part)
    return n, out


def grouped_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], whole: int = 10_000) -> DataFrame:
    """``by``, _n (number of values) and _p (their exact percentiles, interpolated as ``percentile`` does, in
    order of ``shares``) of each group that has a value, without a state that grows with the group's values.

    Mergeable sketches bracket each percentile (groups of up to ``whole`` values are one bracket); then one pass
    counts, for all groups at once, what lies below each bracket, as one number, and the distinct values within,
    some 8 in 10,000 of a large group's rows. Only these are sorted, each bracket's in one task."""
    k, width = len(shares), 4 / 10_000
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    sides = [max(0.0, s - width) for s in shares] + [min(1.0, s + width) for s in shares]
    ends = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(s) for s in sides]), 10_000).alias("_e"))
    side = lambda i, far: F.when(F.col("_n") > whole, F.get("_e", F.lit(i))).otherwise(F.lit(far))
    ends = ends.select(*by, "_n", F.array(*[F.struct(side(i, -math.inf).alias("low"), side(k + i, math.inf).alias("high")) for i in range(k)]).alias("_b"))
    # NaN sorts last, above the infinite end, as ``percentile`` has it.
    met = F.transform("_b", lambda b, i: F.when(F.col("_v") < b["low"], F.struct(i.alias("i"), F.lit(None).cast("double").alias("v")))
                      .when((F.col("_v") <= b["high"]) | F.isnan("_v"), F.struct(i.alias("i"), F.col("_v").alias("v"))))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    joined = rows.alias("r").join(ends.alias("e"), same).select(*[f"r.{c}" for c in by], "_n", F.explode(F.filter(met, lambda m: m.isNotNull())).alias("_m"))
    counted = joined.groupBy(*by, "_n", F.col("_m.i").alias("_i"), F.col("_m.v").alias("_v")).count()
    upto = F.sum("count").over(Window.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_v")))  # what lies below comes first
    at = F.get(F.array(*[F.lit(s) for s in shares]), F.col("_i")) * (F.col("_n") - 1)
    placed = counted.withColumn("_to", upto).withColumn("_at", at)
    holds = lambda rank: F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("count")), F.col("_v")))
    low, high = F.floor("_at"), F.ceil("_at")
    found = placed.groupBy(*by, "_n", "_i").agg(F.first("_at").alias("_at"), holds(low).alias("_x"), holds(high).alias("_y"))
    between = F.when((low == high) | (F.col("_x") == F.col("_y")), F.col("_x")).otherwise((high - F.col("_at")) * F.col("_x") + (F.col("_at") - low) * F.col("_y"))
    return found.withColumn("_p", between).groupBy(*by, "_n").agg(F.array(*[F.max(F.when(F.col("_i") == i, F.col("_p"))) for i in range(k)]).alias("_p"))
