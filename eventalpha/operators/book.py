"""From weights and prices to positions, trades, costs and daily returns; the run is a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rebalance_calendar(signals: DataFrame, prices: DataFrame, freq: str = "week", tail_days: int = 28) -> DataFrame:
    """The last trading day of every week or month from the first signal to ``tail_days`` after the
    last (or the last price)."""
    first, last = signals.agg(F.min("date"), F.max("date")).first()
    days = prices.select("date").filter((F.col("date") >= first) & (F.col("date") <= F.date_add(F.lit(last), tail_days)))
    return days.groupBy(F.date_trunc(freq, "date").alias("_p")).agg(F.max("date").alias("date")).select("date")


def signals_in_range(signals: DataFrame, prices: DataFrame) -> DataFrame:
    low, high = prices.agg(F.min("date"), F.max("date")).first()
    return signals.filter(F.col("date").between(F.lit(low), F.lit(high)))


def position_intervals(entries: DataFrame, holding: int, by: list[str] = ["ticker"]) -> DataFrame:  # noqa: B006
    """Entries (by..., date) that open a position: one on a name that is still open is passed over.
    A position stays open for ``holding`` days. Greedy within a name, so a fold over its sorted
    dates (a name has as many dates as there are rebalances); (by..., entry, exit)."""
    dates = entries.groupBy(*by).agg(F.sort_array(F.collect_set("date")).alias("_d"))
    kept = F.aggregate(
        "_d", F.array().cast("array<date>"),
        lambda a, x: F.when((F.size(a) == 0) | (x >= F.date_add(F.try_element_at(a, F.lit(-1)), holding)), F.concat(a, F.array(x))).otherwise(a),
    )
    return dates.select(*by, F.explode(kept).alias("entry")).withColumn("exit", F.date_add("entry", holding))


def exit_on_calendar(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """``exit`` moved to the first calendar date on or after it; null if there is none."""
    days = calendar.agg(F.sort_array(F.collect_set("date")).alias("_days"))  # one row of rebalance dates
    return intervals.withColumn("_1", F.lit(1)).join(F.broadcast(days.withColumn("_1", F.lit(1))), "_1").withColumn(
        "exit", F.get(F.filter("_days", lambda x: x >= F.col("exit")), F.lit(0))
    ).drop("_1", "_days")


def trade_legs(requests: DataFrame, notional: float) -> DataFrame:
    """requests: (weight, price) -> shares (half-even rounding, at least one if half a share is
    wanted), value; rows without a good price go."""
    wanted = F.col("weight") * notional / F.col("price")
    shares = F.bround(wanted).cast("long")
    shares = F.when((shares == 0) & (F.abs(wanted) >= 0.5), F.signum(wanted).cast("long")).otherwise(shares)
    return requests.filter(F.col("price") > 0).withColumn("shares", shares).filter(F.col("shares") != 0).withColumn("value", F.col("shares") * F.col("price"))


def borrow_cost(intervals: DataFrame, calendar: DataFrame, rate: float = 0.03, overrides: dict[str, float] | None = None) -> DataFrame:
    """Daily cost of the shorts open on each date: sum of |value| x yearly rate / 252."""
    r = F.lit(rate)
    for name, value in (overrides or {}).items():
        r = F.when(F.col("ticker") == name, F.lit(value)).otherwise(r)
    open_days = days_open(intervals.filter("value < 0"), calendar)
    return open_days.groupBy("date").agg((F.sum(-F.col("value") * r) / 252).alias("cost"))


def days_open(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each interval once for every date of the calendar in [entry, exit): the interval is spread
    over its days and joined on equal dates, never compared with all."""
    spread = intervals.filter(F.col("exit") > F.col("entry")).withColumn("date", F.explode(F.sequence("entry", F.date_sub("exit", 1))))
    return spread.join(calendar.select("date").distinct(), "date")


def mark_to_market(intervals: DataFrame, prices: DataFrame) -> DataFrame:
    """Long and short value by date of positions (ticker, entry, exit, shares)."""
    spread = intervals.filter(F.col("exit") > F.col("entry")).withColumn("date", F.explode(F.sequence("entry", F.date_sub("exit", 1))))
    v = F.col("shares") * F.col("close")
    return spread.join(prices.select("ticker", "date", "close"), ["ticker", "date"]).groupBy("date").agg(
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("long"), F.coalesce(F.sum(F.when(v < 0, -v)), F.lit(0.0)).alias("short")
    ).withColumn("value", F.col("long") - F.col("short"))


def book_returns(weights: DataFrame, returns: DataFrame, cost: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Sum of weight x return, less cost x gross, by run and date, and the running product. Without ``by`` one
    task has all dates (a row each)."""
    by = by or []
    daily = weights.join(returns, ["ticker", "date"]).groupBy(*by, "date").agg((F.sum(F.col("weight") * F.col("ret")) - cost * F.sum(F.abs("weight"))).alias("ret"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(w)))


def sma_regime(prices: DataFrame, days: int = 100, bear: float = 0.5) -> DataFrame:
    """Cash overlay: the index return times 1 above its moving average (or before there is one), else
    times ``bear``."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(days - 1), 0)
    enough = F.count("close").over(w) >= days
    bull = ~enough | (F.col("close") >= F.avg("close").over(w))
    return prices.withColumn("bull", bull).withColumn("overlay", F.when(bull, F.lit(1.0)).otherwise(F.lit(bear)))
