"""Risk limits, drawdown control, scandal detection and regimes, as windows over date or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .portfolio import _over, _sides
from .ranks import grouped_percentiles


def risk_controls(df: DataFrame, by: list[str], most: float = 0.1, min_positions: int = 10, leverage: float = 1.0) -> DataFrame:
    """Cap positions, shrink thin books by a fifth, cap gross exposure, then scale the larger side to
    the smaller; a one-sided book has no positions."""
    w, o = F.col("weight"), _over(by)
    df = df.withColumn("weight", F.greatest(F.least(w, F.lit(most)), F.lit(-most)))
    df = df.withColumn("weight", F.when(F.count(F.lit(1)).over(o) < min_positions, w * 0.8).otherwise(w))
    gross = F.sum(F.abs(w)).over(o)
    df = df.withColumn("weight", F.when(gross > leverage, w * leverage / gross).otherwise(w))
    long, short = _sides(by, w)
    df = df.withColumn("_l", long).withColumn("_s", short).filter((F.col("_l") > 0) & (F.col("_s") > 0))
    t = F.least("_l", "_s")
    return df.withColumn("weight", F.when(w > 0, w * t / F.col("_l")).otherwise(w * t / F.col("_s"))).drop("_l", "_s")


def _series(run: str = "run_id"):
    return Window.partitionBy(run).orderBy("date")


def vol_target(returns: DataFrame, target: float = 0.10, days: int = 20, floor: float = 0.5) -> DataFrame:
    """``returns`` (run_id, date, ret) plus scaler: target over realised volatility, weighted by how
    well the run has just done, in [0.3, 3]; 1 until there are returns enough."""
    w = _series().rowsBetween(-(days - 1), 0)
    vol = F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0))
    sharpe = F.avg("ret").over(w) * 252 / vol
    conviction = F.greatest(F.lit(floor), (1 + F.tanh(sharpe)) / 2)
    s = F.greatest(F.least(target / vol * conviction, F.lit(3.0)), F.lit(0.3))
    return returns.withColumn("scaler", F.when((F.count("ret").over(w) >= days) & (vol > 0), s).otherwise(F.lit(1.0)))


def equity(returns: DataFrame) -> DataFrame:
    w = _series().rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w)))


def drawdowns(returns: DataFrame, lookback: int | None = None) -> DataFrame:
    """Plus equity and drawdown against the running (or trailing) peak; the start counts as a peak."""
    start = Window.unboundedPreceding if lookback is None else -(lookback - 1)
    peak = F.max("equity").over(_series().rowsBetween(start, 0))
    peak = F.greatest(peak, F.lit(1.0)) if lookback is None else peak
    return equity(returns).withColumn("drawdown", F.col("equity") / peak - 1)


def drawdown_scale(dd: DataFrame, threshold: float = 0.1) -> DataFrame:
    over = F.abs("drawdown") - threshold
    return dd.withColumn("scale", F.when(F.col("drawdown") < -threshold, F.greatest(1 - over / threshold, F.lit(0.5))).otherwise(F.lit(1.0)))


# Days that losses of at most this depth took to recover.
# Days to recover by depth of drawdown.
RECOVERY_DAYS = {-0.05: 15, -0.10: 45, -0.15: 90, -0.20: 180, -0.30: 365}


def recovery_days(drawdown: Column, legacy: bool = False) -> Column:
    """Days to recover from a drawdown (<= 0), 730 beyond the deepest level, 0 for none. ``legacy`` looks the
    levels up from the deepest, so that every loss within it counts as that one."""
    out = F.lit(730)
    for level in sorted(RECOVERY_DAYS, reverse=legacy):
        out = F.when(drawdown >= level, F.lit(RECOVERY_DAYS[level])).otherwise(out)
    return F.when(drawdown >= 0, F.lit(0)).otherwise(out)


def optimal_leverage(sharpe: Column, most: float = 2.0, least: float = 0.5) -> Column:
    """Half the Sharpe ratio (volatility near 10 %), within bounds."""
    return F.greatest(F.least(sharpe / 2, F.lit(most)), F.lit(least))


# Depths of drawdown and the exposure below each.
DEFAULT_THRESHOLDS, EXPOSURES = (-0.10, -0.15, -0.20, -0.25), (0.95, 0.85, 0.70, 0.50)


def adaptive_thresholds(dd: DataFrame, least: int = 60, least_negative: int = 10) -> DataFrame:
    """run_id, thresholds (from mild to deep): the 25, 50, 75 and 95 % points of the depth of the
    negative drawdowns, the defaults for short histories."""
    points = grouped_percentiles(dd.filter("drawdown < 0"), ["run_id"], "drawdown", [0.75, 0.50, 0.25, 0.05])
    runs = dd.groupBy("run_id").agg(F.count(F.lit(1)).alias("_rows")).join(points, "run_id", "left")
    enough = (F.col("_rows") >= least) & (F.col("_n") >= least_negative)
    return runs.select("run_id", F.when(enough, F.col("_p")).otherwise(F.array(*[F.lit(x) for x in DEFAULT_THRESHOLDS])).alias("thresholds"))


def exposure(dd: Column, thresholds: Column, legacy: bool = False) -> Column:
    """1 above the mildest threshold, then the exposures step by step. ``legacy`` compares with the
    thresholds from the deepest on, so that any drawdown above it gets the first exposure."""
    if legacy:
        return F.when(dd >= 0, F.lit(1.0)).when(dd >= F.array_min(thresholds), F.lit(EXPOSURES[0])).otherwise(F.lit(EXPOSURES[-1]))
    out = F.lit(1.0)
    for i, e in enumerate(EXPOSURES):
        out = F.when(dd < F.get(thresholds, F.lit(i)), F.lit(e)).otherwise(out)
    return out


def halt_flag(returns: DataFrame, depth: float = -0.25, vol: float = 0.5) -> DataFrame:
    """Stop trading: 25 % under the peak of the last 252 values, or wild over the last 20 values."""
    dd = drawdowns(returns, 252)
    recent = F.stddev_samp("ret").over(_series().rowsBetween(-18, 0)) * F.sqrt(F.lit(252.0))
    return dd.withColumn("halt", (F.col("drawdown") <= depth) | F.coalesce(recent > vol, F.lit(False)))


def stop_loss(positions: DataFrame, limit: float = -0.10) -> DataFrame:
    """positions: (weight, entry_price, price): those that lost more than the limit get weight 0."""
    r = (F.col("price") / F.col("entry_price") - 1) * F.signum("weight")
    return positions.withColumn("weight", F.when(r < limit, F.lit(0.0)).otherwise(F.col("weight")))


def var_es(returns: DataFrame, level: float = 0.05, horizon: int = 1, least: int = 30) -> DataFrame:
    """run_id, var (scaled by the root of the horizon), es: mean of the returns at or below it."""
    v = grouped_percentiles(returns, ["run_id"], "ret", [level]).select("run_id", F.col("_n").alias("n"), F.get("_p", F.lit(0)).alias("_v"))
    j = returns.join(v, "run_id").groupBy("run_id").agg(F.first("n").alias("n"), F.first("_v").alias("_v"), F.avg(F.when(F.col("ret") <= F.col("_v"), F.col("ret"))).alias("_e"))
    ok = F.col("n") >= least
    return j.select("run_id", F.when(ok, F.col("_v") * F.sqrt(F.lit(float(horizon)))).otherwise(F.lit(0.0)).alias("var"), F.when(ok, F.col("_e")).otherwise(F.lit(0.0)).alias("es"))


# --- scandals ---


def scandal_baselines(posts: DataFrame, least: int = 20) -> DataFrame:
    """ticker, base_volume (posts a day), base_sentiment, for tickers with posts enough."""
    days = F.greatest(F.datediff(F.max("ts"), F.min("ts")), F.lit(1))
    g = posts.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), (F.count(F.lit(1)) / days).alias("base_volume"), F.avg("sentiment").alias("base_sentiment"))
    return g.filter(F.col("_n") >= least).drop("_n")


def severity(spike: Column, crash: Column, hits: Column) -> Column:
    """LOW to CRITICAL from points for volume, mood and distinct keywords (in twentieths). Volume and mood are
    rounded to nine places, so that a mean on an edge falls the same way in whatever order it was added up."""
    spike, crash = F.round(spike, 9), F.round(crash, 9)
    ladder = lambda c, steps: F.coalesce(*[F.when(test(c), F.lit(p)) for test, p in steps], F.lit(0))
    points = (
        ladder(spike, [(lambda x: x > 10, 8), (lambda x: x > 5, 5), (lambda x: x > 2.5, 2)])
        + ladder(crash, [(lambda x: x < -0.8, 8), (lambda x: x < -0.5, 5), (lambda x: x < -0.3, 2)])
        + ladder(hits, [(lambda x: x >= 5, 4), (lambda x: x >= 2, 2)])
    )
    return F.when(points >= 16, "CRITICAL").when(points >= 10, "HIGH").when(points >= 6, "MEDIUM").otherwise("LOW")


def scandals(posts: DataFrame, baselines: DataFrame, keywords: list[tuple[str, str]], now: str, hours: int = 24, least: int = 10) -> DataFrame:
    """keywords: (term, category). The trailing window against each ticker's baseline; a post counts
    for its first keyword."""
    listed = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("category")) for t, c in keywords])
    recent = posts.filter(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours)))
    first = F.get(F.filter(listed, lambda k: F.contains(F.lower("text"), k["term"])), F.lit(0))
    g = recent.withColumn("_k", first).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_posts"), F.avg("sentiment").alias("_s"), F.sort_array(F.collect_set("_k")).alias("_hits"),
    ).filter(F.col("n_posts") >= least)
    j = g.join(baselines, "ticker", "left").withColumn(
        "volume_spike", F.col("n_posts") / (min(hours, 24) / 24) / F.greatest(F.coalesce("base_volume", F.lit(10.0)), F.lit(1.0))
    ).withColumn("sentiment_crash", F.col("_s") - F.coalesce("base_sentiment", F.lit(0.0))).withColumn("n_keywords", F.size("_hits"))
    of = lambda c: F.size(F.filter("_hits", lambda k: k["category"] == c))
    e, s, v = of("E"), of("S"), of("G")
    category = F.when((e >= s) & (e >= v), "E").when(s >= v, "S").otherwise("G")
    out = j.withColumn("severity", severity(F.col("volume_spike"), F.col("sentiment_crash"), F.col("n_keywords"))).withColumn("category", category)
    return out.filter((F.col("severity") != "LOW") | (F.col("n_keywords") > 0)).select("ticker", "n_posts", "volume_spike", "sentiment_crash", "n_keywords", "severity", "category")


# Hours of a halt and confidence kept, by severity.
HALT_HOURS = {"CRITICAL": (48, 0.5), "HIGH": (24, 0.25), "MEDIUM": (12, 0.0)}


def halts(scandals_: DataFrame, now: str, ts: str = "ts") -> DataFrame:
    """ticker, until, exposure_cut of the halts still active: the longest of a ticker's scandals."""
    hours, cut = F.lit(None).cast("int"), F.lit(0.0)
    for name, (h, c) in HALT_HOURS.items():
        hours = F.when(F.col("severity") == name, F.lit(h)).otherwise(hours)
        cut = F.when(F.col("severity") == name, F.lit(c)).otherwise(cut)
    s = scandals_.withColumn("_h", hours).filter(F.col("_h").isNotNull()).withColumn("until", F.col(ts) + F.make_dt_interval(hours=F.col("_h"))).withColumn("_c", cut)
    return s.groupBy("ticker").agg(F.max("until").alias("until"), F.max("_c").alias("exposure_cut")).filter(F.col("until") > F.lit(now).cast("timestamp_ntz"))


# --- regimes ---


def regimes(returns: DataFrame, short: int = 63, long: int = 252) -> DataFrame:
    """``returns`` plus regime, from the short window's return and volatility and the long one's."""
    s, l = _series().rowsBetween(-(short - 1), 0), _series().rowsBetween(-(long - 1), 0)
    n = F.row_number().over(_series())
    year = F.sqrt(F.lit(252.0))
    df = returns.withColumn("_n", n).withColumn("_r", F.sum("ret").over(s)).withColumn("_v", F.stddev_samp("ret").over(s) * year).withColumn("_l", F.stddev_samp("ret").over(l) * year)
    ratio = F.when(F.col("_l") > 0, F.col("_v") / F.col("_l")).otherwise(F.lit(1.0))
    by_vol = F.when(F.col("_n") < long, "NORMAL").when(ratio > 1.5, "HIGH_VOLATILITY").when(ratio < 0.6, "LOW_VOLATILITY").otherwise("NORMAL")
    regime = (
        F.when(F.col("_n") < short, "NORMAL").when((F.col("_r") < -0.15) & (F.col("_v") > 0.30), "CRISIS").when(F.col("_r") > 0.10, "TREND_UP")
        .when(F.col("_r") < -0.10, "TREND_DOWN").otherwise(by_vol)
    )
    return df.withColumn("regime", regime).drop("_n", "_r", "_v", "_l")


def sharpe_degradation(returns: DataFrame, short: int = 63, long: int = 252, least: int = 10) -> DataFrame:
    """Plus sharpe (rolling) and sharpe_z against its own trailing history."""
    s = _series().rowsBetween(-(short - 1), 0)
    full = F.count("ret").over(s) >= short
    sharpe = F.when(full, F.coalesce(F.try_divide(F.avg("ret").over(s), F.stddev_samp("ret").over(s)), F.lit(0.0)) * F.sqrt(F.lit(252.0)))
    h = _series().rowsBetween(-(long - 1), 0)
    df = returns.withColumn("sharpe", sharpe)
    spread = F.stddev_pop("sharpe").over(h)
    return df.withColumn("sharpe_z", F.when((F.count("sharpe").over(h) >= least) & (spread >= 0.001), (F.col("sharpe") - F.avg("sharpe").over(h)) / spread).otherwise(F.lit(0.0)))


def correlation_breakdown(pairs: DataFrame, historical: float, short: int = 63) -> DataFrame:
    """pairs: (run_id, date, x, ret): Fisher z of the fall of the rolling correlation."""
    s = _series().rowsBetween(-(short - 1), 0)
    clip = lambda c: F.greatest(F.least(c, F.lit(0.99)), F.lit(-0.99))
    c = F.when(F.count("ret").over(s) >= short, F.corr("x", "ret").over(s))
    z = (F.atanh(clip(F.lit(historical))) - F.atanh(clip(F.col("corr")))) / F.sqrt(F.lit(2 / (short - 3)))
    return pairs.withColumn("corr", c).withColumn("corr_z", F.when(F.col("corr").isNotNull() & ~F.isnan("corr"), z).otherwise(F.lit(0.0)))


def regime_changes(df: DataFrame, threshold: float = 2.0, corr_threshold: float = 2.0) -> DataFrame:
    """Rows where the regime changes or a score breaks: (run_id, date, previous, regime, affected,
    confidence). ``df`` has regime, sharpe_z and corr_z."""
    before = F.coalesce(F.lag("regime").over(_series()), F.lit("NORMAL"))
    affected = F.array_compact(F.array(
        F.when(F.col("sharpe_z") < -threshold, "sharpe"), F.when(F.col("corr_z") > corr_threshold, "correlation"), F.when(F.col("regime") != F.col("previous"), "regime")))
    out = df.withColumn("previous", before).withColumn("affected", affected).filter(F.size("affected") > 0)
    part = lambda c: F.least(F.abs(c) / 4, F.lit(0.3))
    confidence = F.least(part("sharpe_z") + part("corr_z") + F.least(F.size("affected") / 6, F.lit(0.3)) + 0.1, F.lit(1.0))
    return out.select("run_id", "date", "previous", "regime", F.array_join("affected", ",").alias("affected"), confidence.alias("confidence"))
