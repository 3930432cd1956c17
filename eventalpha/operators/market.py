"""Price panels: shape, returns, as-of lookup, realised volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.operators.ranks import with_rank


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def wide_to_long(wide: DataFrame, keys: list[str], tickers: list[str]) -> DataFrame:
    """One row for each key and ticker column; rows without a price go."""
    return wide.unpivot(keys, tickers, "ticker", "close").dropna(subset=["close"])


def simple_returns(prices: DataFrame) -> DataFrame:
    """``prices`` plus ret, log_ret (against the ticker's row before)."""
    before = F.lag("close").over(by_ticker())
    return prices.withColumn("ret", F.col("close") / before - 1).withColumn("log_ret", F.ln(F.col("close") / before))


def forward_return(prices: DataFrame, horizon: int, name: str = "forward_ret") -> DataFrame:
    """``prices`` plus the return over the next ``horizon`` rows of the ticker."""
    return prices.withColumn(name, F.lead("close", horizon).over(by_ticker()) / F.col("close") - 1)


def price_asof(requests: DataFrame, prices: DataFrame, value: str = "close") -> DataFrame:
    """Each request (ticker, date, ...) with the latest known ``value`` on or before its date.

    Union and one window: one shuffle on the ticker, no range join. A ticker whose rows do not fit
    a task's time can be cut by date and seeded with its last earlier price."""
    extra = [c for c in requests.columns if c not in ("ticker", "date")]
    asked = requests.withColumn(value, F.lit(None).cast(prices.schema[value].dataType)).withColumn("_asked", F.lit(1))
    known = prices.select("ticker", "date", *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra], value, F.lit(0).alias("_asked"))
    w = Window.partitionBy("ticker").orderBy("date", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    both = known.unionByName(asked.select(known.columns))
    return both.withColumn(f"{value}_asof", F.last(value, ignorenulls=True).over(w)).filter("_asked = 1").drop("_asked", value)


def realized_vol(prices: DataFrame, lookback: int = 20, least: int = 5, default: float = 0.02) -> DataFrame:
    """``prices`` plus vol: deviation of the log returns among the last ``lookback`` rows before."""
    w = by_ticker().rowsBetween(-(lookback - 1), -1)
    r = simple_returns(prices)
    vol = F.stddev_samp("log_ret").over(w)
    enough = (F.count("log_ret").over(w) >= least) & (vol > 0)
    return r.withColumn("vol", F.when(enough, vol).otherwise(F.lit(default))).drop("ret", "log_ret")


def slippage(costs: DataFrame, base: float = 0.0005, impact: float = 0.1, cap: float = 0.02) -> DataFrame:
    """``costs`` (with notional, adv_value, vol) plus rate: base + impact * vol * sqrt(participation)."""
    share = F.least(F.greatest(F.coalesce(F.try_divide(F.col("notional"), F.col("adv_value")), F.lit(1.0)), F.lit(1e-6)), F.lit(1.0))
    return costs.withColumn("rate", F.least(F.greatest(base + impact * F.col("vol") * F.sqrt(share), F.lit(0.0)), F.lit(cap)))


def with_adv(prices: DataFrame, window: int = 20) -> DataFrame:
    """``prices`` plus adv_value: mean of close x volume over the last ``window`` rows."""
    return prices.withColumn("adv_value", F.avg(F.col("close") * F.col("volume")).over(by_ticker().rowsBetween(-(window - 1), 0)))


def return_correlations(returns: DataFrame, least: int = 20, block: int = 256, days: int = 512) -> DataFrame:
    """Pairwise correlation of tickers on common dates, long form (ticker < other; null without variance); a
    ticker has one return a date.

    Tickers are dealt into blocks and dates into stretches. A row goes to each pair of blocks that its own is in,
    so rows sent grow with blocks times data, not with pairs of tickers times dates; a task turns one pair of
    blocks over one stretch (at most days x 2 block numbers) into matrices, whose products give the sums and
    counts of all its pairs at once, missing dates left out by a matrix of ones and zeros. Returns are taken less
    their ticker's mean, so that the sums lose nothing."""
    given = returns.filter("ret is not null").select("ticker", "date", F.col("ret").cast("double").alias("ret"))
    names = with_rank(given.groupBy("ticker").agg(F.avg("ret").alias("_mean")), ["ticker"])
    blocks = -(-names.count() // block)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    rows = given.join(names, "ticker").select(
        "ticker", F.floor(F.col("_rank") / block).cast("int").alias("k"), (F.col("_rank") % block).cast("int").alias("place"),
        F.floor(day / days).cast("int").alias("stretch"), F.pmod(day, F.lit(days)).cast("int").alias("day"), (F.col("ret") - F.col("_mean")).alias("x"))
    met = F.transform(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))), lambda j: F.struct(F.least("k", j).alias("a"), F.greatest("k", j).alias("b")))
    sent = rows.withColumn("_m", F.explode(met)).select("_m.a", "_m.b", "stretch", "k", "place", "day", "ticker", "x")

    def products(key: tuple, frame):
        import numpy as np
        import pandas as pd

        def filled(k: int):
            own = frame[frame["k"] == k]
            x, one = np.zeros((days, block)), np.zeros((days, block))
            x[own["day"], own["place"]] = own["x"]
            one[own["day"], own["place"]] = 1.0
            names_ = np.full(block, None, object)
            names_[own["place"]] = own["ticker"]
            return x, one, names_

        x, of_x, left = filled(key[0])
        y, of_y, right = (x, of_x, left) if key[0] == key[1] else filled(key[1])
        n = of_x.T @ of_y
        i, j = np.nonzero(n)
        if key[0] == key[1]:
            i, j = i[i < j], j[i < j]
        sums = {"n": n, "sx": x.T @ of_y, "sy": of_x.T @ y, "sxx": (x * x).T @ of_y, "syy": of_x.T @ (y * y), "sxy": x.T @ y}
        return pd.DataFrame({"ticker": left[i], "other": right[j], **{k: v[i, j] for k, v in sums.items()}})

    parts = sent.groupBy("a", "b", "stretch").applyInPandas(products, "ticker string, other string, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = parts.groupBy("ticker", "other").agg(*[F.sum(c).alias(c) for c in parts.columns[2:]]).filter(F.col("n") >= least)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    corr = F.when(spread > 0, (n * F.col("sxy") - sx * sy) / F.sqrt(spread))
    return total.select("ticker", "other", corr.alias("corr"), n.cast("long").alias("n"))
