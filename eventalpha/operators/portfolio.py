"""Weights by date under side targets, position, sector, turnover and liquidity limits.

All limits work within ``by`` (a date, or run and date); with by = [] over the whole frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _over(by: list[str]):
    return Window.partitionBy(*(by or [F.lit(1)]))


def _sides(by: list[str], w: Column) -> tuple[Column, Column]:
    o = _over(by)
    return F.sum(F.when(w > 0, w).otherwise(0.0)).over(o), F.sum(F.when(w < 0, -w).otherwise(0.0)).over(o)


def scale_sides(df: DataFrame, by: list[str], target: Column | float, weight: str = "weight") -> DataFrame:
    """Longs add up to ``target`` and shorts to minus it, on each side that has any."""
    w = F.col(weight)
    long, short = _sides(by, w)
    t = F.lit(target) if isinstance(target, float) else target
    return df.withColumn(weight, F.when((w > 0) & (long > 0), w * t / long).when((w < 0) & (short > 0), w * t / short).otherwise(w))


def quintile_portfolio(
    signals: DataFrame, by: list[str], gross: float = 1.0, equal_count: bool = True, neutral: bool = True, kind: str = "long_short",
    best: str = "confidence", tie: str = "event_id",
) -> DataFrame:
    """Long the fifth quintile, short the first. With ``equal_count`` both sides keep as many names as
    the smaller has, the most confident first; a date with an empty side has no positions."""
    sided = signals.filter(F.col("quintile").isin(1, 5)).withColumn("_side", F.when(F.col("quintile") == 5, 1).otherwise(-1))
    o = _over(by)
    n_long, n_short = F.count_if(F.col("_side") == 1).over(o), F.count_if(F.col("_side") == -1).over(o)
    if equal_count and kind == "long_short":
        rank = F.row_number().over(Window.partitionBy(*by, "_side").orderBy(F.desc(best), tie))
        sided = sided.withColumn("_m", F.least(n_long, n_short)).withColumn("_r", rank).filter(F.col("_r") <= F.col("_m")).drop("_m", "_r")
    elif kind != "long_short":
        sided = sided.filter(F.col("_side") == (1 if kind == "long_only" else -1))
    side_n = F.count(F.lit(1)).over(Window.partitionBy(*by, "_side"))
    target = gross / 2 if neutral and kind == "long_short" else 1.0
    return sided.withColumn("weight", F.col("_side") * target / side_n).drop("_side")


def zscore_portfolio(df: DataFrame, by: list[str], target: float = 0.5, z: str = "z_score") -> DataFrame:
    return scale_sides(df.withColumn("weight", F.col(z)), by, target)


def position_limits(df: DataFrame, by: list[str], most: float = 0.1, target: float = 0.5) -> DataFrame:
    clipped = df.withColumn("weight", F.greatest(F.least("weight", F.lit(most)), F.lit(-most)))
    return scale_sides(clipped, by, target)


def sector_neutral(df: DataFrame, by: list[str], cap: float = 0.1, target: float | None = 0.5, sector: str = "sector") -> DataFrame:
    """Where a sector's net weight exceeds cap x gross, its larger side shrinks to the cap."""
    w = F.col("weight")
    limit = cap * F.sum(F.abs(w)).over(_over(by))
    own = Window.partitionBy(*by, sector)
    net = F.sum(w).over(own)
    side = F.signum(net)
    offending = F.sum(F.when(F.signum(w) == side, w).otherwise(0.0)).over(own)
    df = df.withColumn("_limit", limit).withColumn("_net", net).withColumn("_off", offending)
    shrink = F.greatest(F.lit(0.0), 1 - (F.col("_net") - F.signum("_net") * F.col("_limit")) / F.col("_off"))
    hit = (F.abs("_net") > F.col("_limit")) & (F.signum(w) == F.signum("_net")) & (F.col("_off") != 0)
    out = df.withColumn("weight", F.when(hit, w * shrink).otherwise(w)).drop("_limit", "_net", "_off")
    return scale_sides(out, by, target) if target else out


def turnover_shrink(pairs: DataFrame, by: list[str], budget: float = 0.5) -> DataFrame:
    """pairs: target and current weight -> weight, moved towards the target as far as the one-sided
    turnover budget allows; zero weights go."""
    delta = F.col("target") - F.col("current")
    turnover = F.sum(F.abs(delta)).over(_over(by)) / 2
    out = pairs.withColumn("_t", turnover).withColumn(
        "weight", F.when((F.col("_t") <= budget) | (F.col("_t") == 0), F.col("target")).otherwise(F.col("current") + budget / F.col("_t") * delta)
    )
    return out.filter(F.col("weight") != 0).drop("_t")


def portfolio_stats(df: DataFrame, by: str = "date") -> DataFrame:
    """By date and in total (date null)."""
    w = F.col("weight")
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(w > 0).alias("n_long"), F.count_if(w < 0).alias("n_short"), F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0.0)).alias("long"),
        F.coalesce(F.sum(F.when(w < 0, w)), F.lit(0.0)).alias("short"), F.sum(w).alias("net"), F.sum(F.abs(w)).alias("gross"), F.avg(F.abs(w)).alias("mean_abs"),
    )


def kelly_sizes(df: DataFrame, by: list[str], least: float = 0.3, fraction: float = 0.25, expected: str | None = None, vol: str | None = None) -> DataFrame:
    """Weights by signal strength, or by mean / variance clipped at 2, times confidence; sides of 1."""
    edge = F.col("raw_score") if expected is None else F.coalesce(F.greatest(F.least(F.try_divide(F.col(expected), F.col(vol) * F.col(vol)), F.lit(2.0)), F.lit(-2.0)), F.lit(0.0))
    sized = df.filter(F.abs("raw_score") >= least).withColumn("weight", edge * F.col("event_confidence") * fraction)
    return scale_sides(sized, by, 1.0)


def liquidity_cap(df: DataFrame, adv: DataFrame, capital: float, share: float = 0.05, on: str = "ticker") -> DataFrame:
    """|weight| x capital at most ``share`` of the daily value traded; names without volume stay."""
    j = df.join(adv.select(on, "adv_value"), on, "left")
    room = F.col("adv_value") * share / (F.abs("weight") * capital)
    return j.withColumn("weight", F.when(F.col("adv_value").isNotNull() & (F.col("weight") != 0), F.col("weight") * F.least(F.lit(1.0), room)).otherwise(F.col("weight"))).drop("adv_value")


def halt_adjust(df: DataFrame, halted: DataFrame, correlations: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Halted names get 0; others are halved for every halted name that they move with."""
    pairs = correlations.filter(F.abs("corr") > threshold)
    both = pairs.select("ticker", F.col("other").alias("halted")).union(pairs.select(F.col("other"), F.col("ticker")))
    near = both.join(halted.select(F.col("ticker").alias("halted")), "halted").groupBy("ticker").agg(F.count(F.lit(1)).alias("_near"))
    flag = halted.select("ticker", F.lit(True).alias("_halted")).distinct()
    j = df.join(flag, "ticker", "left").join(near, "ticker", "left")
    factor = F.pow(F.lit(0.5), F.coalesce("_near", F.lit(0)))
    return j.withColumn("weight", F.when(F.col("_halted"), F.lit(0.0)).otherwise(F.col("weight") * factor)).drop("_halted", "_near")
