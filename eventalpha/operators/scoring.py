"""Scores of events, ranks within a date, weights of score components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.operators.ranks import percentiles

WEIGHTS = {"event_severity": 0.20, "intensity": 0.40, "volume": 0.25, "duration": 0.15}


def components() -> dict[str, Column]:
    """The parts of a score, each in 0..1, from columns event_confidence, intensity, volume_ratio, duration_days."""
    return {
        "event_severity": F.col("event_confidence"), "intensity": F.abs("intensity"),
        "volume": F.least(F.log1p(F.col("volume_ratio").cast("double")) / F.log(F.lit(10.0)), F.lit(1.0)), "duration": F.least(F.col("duration_days") / 7, F.lit(1.0)),
    }


def raw_score(weights: dict[str, float] = WEIGHTS, dead_band: float = 0.01, boost: float = 1.10) -> Column:
    """Direction of the reaction times weighted conviction; mood before the event that agrees lifts it."""
    direction = F.when(F.abs("intensity") > dead_band, F.signum("intensity")).otherwise(F.lit(0.0))
    conviction = sum((weights[k] * c for k, c in components().items()), F.lit(0.0))
    agrees = (direction != 0) & (F.signum(F.coalesce("pre_event_sentiment", F.lit(0.0))) == direction)
    return direction * conviction * F.when(agrees, F.lit(boost)).otherwise(F.lit(1.0))


def confidence() -> Column:
    n, a = F.col("n_sources"), F.col("source_agreement")
    base = 0.25 * F.col("event_confidence") + 0.30 * F.abs("intensity") + 0.20 * F.least(F.col("volume_ratio") / 2, F.lit(1.0)) + 0.25 * F.least(F.col("n_posts") / 30, F.lit(1.0))
    bonus = F.when((n >= 3) & (a >= 0.8), F.lit(0.20)).when((n >= 2) & (a >= 0.5), F.lit(0.10)).otherwise(F.lit(0.0))
    return F.least(base + bonus, F.lit(1.0))


def filter_signals(df: DataFrame, require_posts: bool = True, min_posts: int = 1, min_volume: float = 0.0, min_intensity: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """Signals good enough; with ``require_posts`` false, events without posts stay."""
    good = (F.col("n_posts") >= min_posts) & (F.col("volume_ratio") >= min_volume) & (F.abs("intensity") >= min_intensity) & (F.col("event_confidence") >= min_confidence)
    return df.filter(good if require_posts else good | (F.col("n_posts") == 0))


def quintiles(df: DataFrame, by: list[str], score: str = "raw_score", tie: str = "event_id") -> DataFrame:
    """``df`` plus quintile, by a rule that depends on a date's number of signals n.

    n >= 5: equal to linearly interpolated quantile bins closed on the right, in integers: with a the
    rows below a score, the bin is ceil(5 a / (n - 1)), 1 at least; if two edges fall on one score,
    the whole date is 3. n = 3, 4: thirds to 1, 3, 5. n = 2: 1 and 5. n = 1: by sign. Then 5 needs a
    score >= 0 and 1 a score <= 0, else 3. One exchange by date; no collecting."""
    whole = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(whole)
    s = F.col(score)
    df = df.withColumn("_n", n).withColumn("_a", F.rank().over(whole.orderBy(score)) - 1)
    df = df.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*by, score)))
    b, m = F.col("_a") + F.col("_t") - 1, F.col("_n") - 1
    repeated = F.lit(False)
    for k in range(5):
        repeated = repeated | ((F.col("_a") * 5 <= k * m) & ((k + 1) * m <= b * 5))
    clash = F.max(repeated.cast("int")).over(whole) == 1
    low, high = (F.percentile(s, F.lit(p)).over(whole) for p in (0.3333, 0.6667))
    q = (
        F.when(F.col("_n") >= 5, F.when(clash, F.lit(3)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_a") * 5 / m))))
        .when(F.col("_n") >= 3, F.when(s <= low, F.lit(1)).when(s >= high, F.lit(5)).otherwise(F.lit(3)))
        .when(F.col("_n") == 2, F.when(F.row_number().over(whole.orderBy(score, tie)) == 1, F.lit(1)).otherwise(F.lit(5)))
        .otherwise(F.when(s > 0, F.lit(5)).when(s < 0, F.lit(1)).otherwise(F.lit(3)))
    ).cast("int")
    checked = F.when(((F.col("quintile") == 5) & (s < 0)) | ((F.col("quintile") == 1) & (s > 0)), F.lit(3)).otherwise(F.col("quintile"))
    return df.withColumn("quintile", q).withColumn("quintile", checked).drop("_n", "_a", "_t")


def zscores(df: DataFrame, by: list[str], score: str = "raw_score") -> DataFrame:
    """``df`` plus z_score within the date (twice the score for a single one) and signal = tanh(z)."""
    w = Window.partitionBy(*by)
    s = F.col(score)
    z = F.when(F.count(F.lit(1)).over(w) > 1, (s - F.avg(s).over(w)) / (F.stddev_samp(s).over(w) + 1e-6)).otherwise(s * 2)
    return df.withColumn("z_score", z).withColumn("signal", F.tanh("z_score"))


def global_quintile(df: DataFrame, score: str = "raw_score") -> DataFrame:
    """By the 20, 40, 60 and 80 % points of all rows; 3 for under five rows."""
    n, edges = percentiles(df, score, [0.2, 0.4, 0.6, 0.8])
    s = F.col(score)
    if n < 5:
        return df.withColumn("quintile", F.lit(3))
    q = F.lit(5)
    for i, e in reversed(list(enumerate(edges))):
        q = F.when(s <= e, F.lit(i + 1)).otherwise(q)
    return df.withColumn("quintile", q)


def rolling_zscore(df: DataFrame, by: list[str], order: list[str], score: str = "raw_score", lookback: int = 252, least: int = 20) -> DataFrame:
    """Against the ``lookback`` rows before; null until ``least`` of them have a score.

    A group's rows are dealt into blocks of ``lookback``. What a row looks back on is the end of the block before, from
    the row ``lookback`` places earlier on, and the start of its own; both have running sums, so a row costs the same
    however long the lookback. Sums of the two are joined about their means, so nothing cancels."""
    w = Window.partitionBy(*by).orderBy(*order)
    block = Window.partitionBy(*by, "_block")
    tail = block.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    s = F.col(score)
    sums = lambda over: F.struct(F.count(s).over(over).alias("n"), F.avg(s).over(over).alias("mean"), F.var_pop(s).over(over).alias("var"))
    at = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_block", F.floor(F.col("_at") / lookback))
    head = block.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = at.withColumn("_tail", sums(tail)).withColumn("_head", sums(head)).withColumn("_tail", F.lag("_tail", lookback).over(Window.partitionBy(*by).orderBy("_at")))
    part = lambda side, name: F.coalesce(F.col(side)[name], F.lit(0))
    (n1, m1, v1), (n2, m2, v2) = ([part(side, x) for x in ("n", "mean", "var")] for side in ("_tail", "_head"))
    n = n1 + n2
    mean = F.when(n1 == 0, m2).when(n2 == 0, m1).otherwise(m1 + (m2 - m1) * n2 / n)
    square = n1 * v1 + n2 * v2 + F.when((n1 > 0) & (n2 > 0), (m2 - m1) * (m2 - m1) * n1 * n2 / n).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(square / (n - 1)))
    return both.withColumn("rolling_z", F.when(n >= least, (s - mean) / (std + 1e-6))).drop("_at", "_block", "_tail", "_head")


def recent(df: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def _as_rows(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(by, names, "component", "x") if by else df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.col(k).alias("x")) for k in names])))


def normalize(df: DataFrame, by: list[str], value: str = "weight") -> DataFrame:
    """``value`` divided by its sum in the group; equal shares if the sum is 0. Without ``by`` the whole frame's sum and
    count are taken first, so that no task sees all rows."""
    if not by:
        total, n = df.agg(F.coalesce(F.sum(value), F.lit(0)).cast("double"), F.count(F.lit(1))).first()
        return df.withColumn(value, F.col(value) / F.lit(total) if total > 0 else F.lit(1 / max(n, 1)))
    w = Window.partitionBy(*by)
    total = F.sum(value).over(w)
    return df.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(1 / F.count(F.lit(1)).over(w)))


def inverse_variance_weights(features: DataFrame, names: list[str], by: list[str], least: int = 20, floor: float = 1e-6) -> DataFrame:
    """(by..., component, weight): stable components weigh more; equal weights for few rows."""
    rows = features.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[(1 / F.greatest(F.coalesce(F.var_samp(c), F.lit(1.0)), F.lit(floor))).alias(c) for c in names])
    rows = rows.select(*by, *[F.when(F.col("_n") >= least, F.col(c)).otherwise(F.lit(1.0)).alias(c) for c in names])
    return normalize(_as_rows(rows, by, names).withColumnRenamed("x", "weight"), by)


def correlation_weights(features: DataFrame, names: list[str], ret: str, by: list[str]) -> DataFrame:
    """(by..., component, weight) by absolute correlation with the return; .01 where undefined."""
    rows = features.groupBy(*by).agg(*[F.coalesce(F.nanvl(F.abs(F.corr(c, ret)), F.lit(0.01)), F.lit(0.01)).alias(c) for c in names])
    total = sum((F.col(c) for c in names), F.lit(0.0))
    rows = rows.withColumn("_t", total)
    rows = rows.select(*by, *[F.when(F.col("_t") < 0.001, F.lit(1.0)).otherwise(F.col(c)).alias(c) for c in names])
    return normalize(_as_rows(rows, by, names).withColumnRenamed("x", "weight"), by)
