"""Many thresholds, folds or runs in one job: the run is a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_thresholds(df: DataFrame, thresholds: list[float], column: str = "confidence", name: str = "threshold") -> DataFrame:
    """Each row once for every threshold that it meets."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return df.withColumn(name, F.explode(F.filter(levels, lambda t: F.col(column) >= t)))


def compare_thresholds(events: DataFrame, thresholds: list[float]) -> DataFrame:
    c = F.col("confidence")
    return with_thresholds(events, thresholds).groupBy("threshold").agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        F.percentile(c, F.lit(0.5)).alias("median_confidence"), (F.count_if(F.col("category") == "E") / F.count("*")).alias("e_share"),
    )


def pick_threshold(metrics: DataFrame, least_signals: int) -> DataFrame:
    """The threshold of the best Sharpe ratio among those with enough signals, else of the best
    .6 Sharpe + .4 signal share; ties to the lower threshold."""
    feasible = F.col("n_signals") >= least_signals
    best = metrics.agg(
        F.max_by(F.when(feasible, F.col("threshold")), F.when(feasible, F.struct("sharpe", -F.col("threshold")))).alias("feasible_best"),
        F.max_by("threshold", F.struct((0.6 * F.col("sharpe") + 0.4 * F.least(F.col("n_signals") / least_signals, F.lit(1.0))).alias("s"), (-F.col("threshold")).alias("t"))).alias("any_best"),
    )
    return best.select(F.coalesce("feasible_best", "any_best").alias("threshold"), F.col("feasible_best").isNotNull().alias("feasible"))


def compare_runs(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """metrics: (run_id, metric, value) -> both values, difference and relative change."""
    a, b = (metrics.filter(F.col("run_id") == r).select("metric", F.col("value").alias(n)) for r, n in ((first, "a"), (second, "b")))
    return a.join(b, "metric", "full").withColumn("delta", F.col("b") - F.col("a")).withColumn("change", F.try_divide(F.col("b") - F.col("a"), F.abs("a")))
