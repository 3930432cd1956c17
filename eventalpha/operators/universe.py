"""Sets of tickers: tiers, filters, cleaning, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("VERY HIGH", "HIGH", "MEDIUM", "LOW")


def tier(universe: DataFrame, constituents: DataFrame, level: str, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Members of the categories at or above ``level`` that are constituents, once each."""
    wanted = tiers[: tiers.index(level) + 1]
    return universe.filter(F.col("tier").isin(*wanted)).select("ticker").intersect(constituents.select("ticker")).orderBy("ticker")


def by_criteria(df: DataFrame, low: float | None = None, high: float | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Within the range of market cap (unknown caps stay), outside the excluded sectors."""
    cap = F.col("cap")
    keep = F.lit(True)
    if low is not None:
        keep = keep & (cap.isNull() | (cap >= low))
    if high is not None:
        keep = keep & (cap.isNull() | (cap <= high))
    return df.filter(keep & ~F.coalesce("sector", F.lit("")).isin(*(excluded or ("\0",))))


def clean_ticker(raw: Column) -> Column:
    """Trimmed, upper case, dots as dashes; null unless 1 to 5 letters (dashes aside)."""
    t = F.replace(F.upper(F.trim(raw)), F.lit("."), F.lit("-"))
    bare = F.replace(t, F.lit("-"), F.lit(""))
    return F.when(bare.rlike("^[A-Z]{1,5}$") & (F.length(t) <= 6), t)


def breakdown(df: DataFrame, by: str = "sector") -> DataFrame:
    """Members of each sector and in total (sector null)."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("n_tickers"), F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ticker").subtract(b.select("ticker"))
