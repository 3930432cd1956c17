"""Data quality: date ranges, look-ahead, schemas, coverage, alerts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.operators.ranks import percentiles


def validate_dates(df: DataFrame, date: str, start: str, end: str, alert: float = 0.10) -> DataFrame:
    """One row: total, valid, out of range, unreadable, whether too many are lost."""
    d = F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd")
    inside = d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"), F.count_if(inside).alias("valid"), F.count_if(~inside).alias("out_of_range"), F.count_if(d.isNull()).alias("invalid"),
        ((n - F.count_if(inside)) / n > alert).alias("alert"),
    )


def in_range(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    return df.filter(F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def lookahead(df: DataFrame, data_date: str, reference_date: str) -> DataFrame:
    """Rows whose data is from after their reference date."""
    return df.filter(F.col(data_date) > F.col(reference_date))


#: Column -> (type, least, greatest) of a signal.
SIGNAL_BOUNDS: dict[str, tuple[str, float | None, float | None]] = {
    "raw_score": ("double", -1.0, 1.0), "quintile": ("int", 1, 5), "event_confidence": ("double", 0.0, 1.0), "n_posts": ("int", 0, None), "volume_ratio": ("double", 0.0, None),
}


def signal_violations(df: DataFrame, bounds: dict = SIGNAL_BOUNDS) -> DataFrame:
    """(column, problem, n) of every violated rule, in one pass."""
    checks, names = [], []
    for c, (_, low, high) in bounds.items():
        if c not in df.columns:
            names.append((c, "missing"))
            checks.append(F.count(F.lit(1)))
            continue
        for problem, test in (("null", F.col(c).isNull()), ("below", F.col(c) < low if low is not None else None), ("above", F.col(c) > high if high is not None else None)):
            if test is not None:
                names.append((c, problem))
                checks.append(F.count_if(test))
    row = df.agg(*[x.alias(f"c{i}") for i, x in enumerate(checks)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), F.col(f"c{i}").alias("n")) for i, (c, p) in enumerate(names)]))
    return row.select(rows.alias("r")).select("r.*").filter("n > 0")


def enforce_signals(df: DataFrame, bounds: dict = SIGNAL_BOUNDS, defaults: dict | None = None) -> DataFrame:
    """Columns cast, missing values filled, values clipped to their bounds."""
    defaults = defaults or {"quintile": 3}
    for c, (kind, low, high) in bounds.items():
        value = F.coalesce(F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind), F.lit(defaults.get(c, 0)).cast(kind))
        value = F.greatest(value, F.lit(low).cast(kind)) if low is not None else value
        df = df.withColumn(c, F.least(value, F.lit(high).cast(kind)) if high is not None else value)
    return df


def quality_class(share) :
    return F.when(share >= 0.8, "FULL").when(share >= 0.5, "PARTIAL").when(share >= 0.2, "SPARSE").otherwise("DROPOUT")


def coverage(expected: DataFrame, posts: DataFrame, now: str) -> DataFrame:
    """One row: expected and covered tickers, posts a ticker, staleness in hours, class, halt flag."""
    found = posts.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    j = expected.select("ticker").distinct().join(found, "ticker", "left")
    n, have = F.count(F.lit(1)), F.count("_n")
    share = have / n
    return j.agg(
        n.alias("expected"), have.alias("covered"), share.alias("coverage"), (F.coalesce(F.sum("_n"), F.lit(0)) / n).alias("posts_per_ticker"),
        (F.timestamp_diff("SECOND", F.max("_last"), F.lit(now).cast("timestamp_ntz")) / 3600).alias("stale_hours"),
        quality_class(share).alias("quality"), (share < 0.2).alias("halt"),
    )


def covered(posts: DataFrame, least: int) -> DataFrame:
    return posts.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


#: Quality class -> (multiplier of position size, of the weights of post features).
BY_QUALITY = {"FULL": (1.0, 1.0), "PARTIAL": (0.7, 0.8), "SPARSE": (0.4, 0.5), "DROPOUT": (0.0, 0.0)}


def reweight(df: DataFrame, event_weight: str, post_weights: list[str], quality: str = "quality") -> DataFrame:
    """Weights of post features shrink with quality, then all add up to 1; plus size_multiplier."""
    def of(i: int):
        out = F.lit(0.0)
        for name, values in BY_QUALITY.items():
            out = F.when(F.col(quality) == name, F.lit(values[i])).otherwise(out)
        return out

    df = df.withColumn("size_multiplier", of(0)).withColumn("_m", of(1))
    for c in post_weights:
        df = df.withColumn(c, F.col(c) * F.col("_m"))
    total = sum((F.col(c) for c in post_weights), F.col(event_weight))
    df = df.withColumn("_total", total)
    for c in [event_weight, *post_weights]:
        df = df.withColumn(c, F.try_divide(F.col(c), F.col("_total")))
    return df.drop("_m", "_total")


def quality_alerts(history: DataFrame, hours: int = 6, by: list[str] | None = None) -> DataFrame:
    """history: (ts, quality) -> level of sustained degradation over the trailing hours. Without ``by``
    one task has the whole history: a row an hour, whatever the posts."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-hours * 3600, 0)
    share = lambda q: F.count_if(F.col("quality") == q).over(w) / F.count(F.lit(1)).over(w)
    enough = F.count(F.lit(1)).over(w) >= 2
    return history.withColumn("alert", F.when(enough & (share("DROPOUT") >= 0.5), "HIGH").when(enough & (share("SPARSE") >= 0.7), "MEDIUM").otherwise("NONE"))


def signal_quality(signals: DataFrame, low: int = 10) -> DataFrame:
    """By month, and in total (month null): counts, posts coverage, correlation, quintile counts."""
    m = signals.withColumn("month", F.to_date(F.date_trunc("month", "date")))
    return m.rollup("month").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("n_posts") > 0) / F.count(F.lit(1))).alias("covered"), F.corr("quintile", "raw_score").alias("corr"),
        F.count_if(F.col("quintile") == 1).alias("q1"), F.count_if(F.col("quintile") == 3).alias("q3"), F.count_if(F.col("quintile") == 5).alias("q5"),
    ).withColumn("low", F.col("n") < low)


def signal_stats(signals: DataFrame, score: str = "raw_score") -> DataFrame:
    c = F.col(score)
    _, middle = percentiles(signals, score, [0.5])
    return signals.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).withColumn("median", F.lit(middle[0] if middle else None).cast("double"))


def check_results(metrics: DataFrame, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """metrics: (run_id, metric, value); rules: (metric, 'min' or 'max', pass bound, warn bound)."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), F.lit(float(p)).alias("ok"), F.lit(float(w)).alias("warn")) for m, k, p, w in rules])
    r = metrics.withColumn("r", F.explode(F.filter(entries, lambda e: e["metric"] == F.col("metric")))).select("run_id", "metric", "value", "r.kind", "r.ok", "r.warn")
    v, sign = F.col("value"), F.when(F.col("kind") == "min", F.lit(1)).otherwise(F.lit(-1))
    return r.withColumn("status", F.when(v * sign >= F.col("ok") * sign, "PASS").when(v * sign >= F.col("warn") * sign, "WARN").otherwise("FAIL")).drop("kind", "ok", "warn")
