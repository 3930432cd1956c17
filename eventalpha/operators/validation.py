"""Walk-forward folds and metrics; a fold is a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.functions.normal import expected_best, normal_cdf
from eventalpha.operators.folds import Fold, merged
from eventalpha.operators.scoring import correlation_weights, inverse_variance_weights


def windows(spark: SparkSession, start: str, end: str, train_months: int = 12, test_months: int = 3, step_months: int = 3, embargo_days: int = 5) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end: expanding training, months of 30 days, an
    embargo before each test."""
    first = F.date_add(F.lit(start).cast("date"), train_months * 30)
    k = F.floor((F.datediff(F.lit(end).cast("date"), first) - embargo_days - test_months * 30) / (step_months * 30))
    folds = spark.range(1).select(F.explode(F.filter(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), lambda i: i <= k)).alias("fold"))
    train_end = F.date_add(first, (F.col("fold") * step_months * 30).cast("int"))
    out = folds.select("fold", F.lit(start).cast("date").alias("train_start"), train_end.alias("train_end"), F.date_add(train_end, embargo_days).alias("test_start"))
    return out.withColumn("test_end", F.date_add("test_start", test_months * 30))


def assign(df: DataFrame, folds: DataFrame, least_train: int = 10, least_test: int = 5, date: str = "date") -> DataFrame:
    """Each row once for every fold and split that holds it; folds with too few rows go. The folds
    are a few rows whatever the data, so they ride along as an array."""
    spans = [(r.fold, split, a, b) for r in folds.collect() for split, a, b in (("train", r.train_start, r.train_end), ("test", r.test_start, r.test_end))]
    entries = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(s).alias("split"), F.lit(a).alias("a"), F.lit(b).alias("b")) for f, s, a, b in spans])
    if not spans:
        entries = F.array().cast("array<struct<fold:int,split:string,a:date,b:date>>")
    d = F.col(date)
    rows = df.withColumn("_e", F.explode(F.filter(entries, lambda e: (d >= e["a"]) & (d < e["b"])))).select(*df.columns, "_e.fold", "_e.split")
    n = rows.groupBy("fold").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    good = n.filter((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test)).select("fold")
    return rows.join(F.broadcast(good), "fold", "left_semi")  # one row a fold


def sharpe_by_split(rows: DataFrame, ret: str = "ret") -> DataFrame:
    """fold, train and test Sharpe, test return, overfit ratio (test / train; 0 without train skill)."""
    year = F.sqrt(F.lit(252.0))
    side = lambda s: F.when(F.col("split") == s, F.col(ret))
    sharpe = lambda s: F.coalesce(F.try_divide(F.avg(side(s)), F.stddev_samp(side(s))), F.lit(0.0)) * year
    g = rows.groupBy("fold").agg(
        sharpe("train").alias("train_sharpe"), sharpe("test").alias("test_sharpe"), (F.exp(F.sum(F.ln(1 + side("test")))) - 1).alias("test_return"), F.count(side("test")).alias("n_test"))
    return g.withColumn("overfit_ratio", F.when(F.col("train_sharpe") > 0, F.col("test_sharpe") / F.col("train_sharpe")).otherwise(F.lit(0.0)))


def train_weights(rows: DataFrame, names: list[str], method: str = "inverse_variance", ret: str = "ret") -> DataFrame:
    """fold and a column for each component's weight, fitted on the fold's training rows alone."""
    train = rows.filter("split = 'train'")
    w = inverse_variance_weights(train, names, ["fold"]) if method == "inverse_variance" else correlation_weights(train, names, ret, ["fold"])
    return w.groupBy("fold").agg(*[F.max(F.when(F.col("component") == c, F.col("weight"))).alias(c) for c in names])


def backtest(rows: DataFrame, weights: DataFrame, names: list[str], enter: float, ret: str = "ret", date: str = "date") -> DataFrame:
    """fold, split, date, n_trades, ret: each day's mean return of the rows whose weighted score is ``enter`` away
    from 0 or more, long above and short below; days without one are not in it."""
    w = weights.select("fold", *[F.col(c).alias(f"_w_{c}") for c in names])
    score = sum((F.col(c) * F.col(f"_w_{c}") for c in names), F.lit(0.0))
    taken = rows.join(w, "fold").withColumn("_s", score).filter(F.abs("_s") >= enter)
    return taken.groupBy("fold", "split", date).agg(F.count(F.lit(1)).alias("n_trades"), F.avg(F.signum("_s") * F.col(ret)).alias("ret"))


def fold_metrics(daily: DataFrame, date: str = "date") -> DataFrame:
    """A row for each fold with test days: Sharpe ratio, trades, return and deepest drawdown of training and test,
    and the overfit ratio (test / train Sharpe; 0 if training shows next to none). A window holds one fold's days."""
    days = Window.partitionBy("fold", "split").orderBy(date)
    so_far = days.rowsBetween(Window.unboundedPreceding, 0)
    equity = daily.withColumn("_e", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(so_far)))
    drawn = equity.withColumn("_d", F.col("_e") / F.greatest(F.max("_e").over(so_far), F.lit(1.0)) - 1)
    side = lambda s, c: F.when(F.col("split") == s, F.col(c))
    year = F.sqrt(F.lit(252.0))

    def of(s: str) -> list:
        r = side(s, "ret")
        return [
            (F.coalesce(F.try_divide(F.avg(r), F.stddev_samp(r)), F.lit(0.0)) * year).alias(f"{s}_sharpe"), F.coalesce(F.sum(side(s, "n_trades")), F.lit(0)).alias(f"{s}_n_trades"),
            F.coalesce(F.exp(F.sum(F.ln(1 + r))) - 1, F.lit(0.0)).alias(f"{s}_return"), F.coalesce(F.least(F.min(side(s, "_d")), F.lit(0.0)), F.lit(0.0)).alias(f"{s}_max_drawdown"),
        ]

    g = drawn.groupBy("fold").agg(*of("train"), *of("test")).filter("test_n_trades > 0")
    ratio = F.when(F.abs("train_sharpe") < 0.001, F.lit(0.0)).otherwise(F.col("test_sharpe") / F.col("train_sharpe"))
    return g.withColumn("overfit_ratio", ratio)


def aggregate(metrics: DataFrame, least_overfit: float = 0.4, least_profitable: float = 0.5, least_deflated: float = 0.9) -> DataFrame:
    """The folds together: mean, spread and extremes of the test Sharpe, share of folds above 0, trades, and how
    sure the mean is: probabilistic (against 0) and deflated Sharpe probability (against the best that as many
    folds without skill would show), from the spread over folds; ``passes`` is the gate. One row."""
    s = F.col("test_sharpe")
    g = metrics.agg(
        F.count(F.lit(1)).alias("folds"), F.avg("train_sharpe").alias("mean_train_sharpe"), F.avg(s).alias("mean_sharpe"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std_sharpe"),
        F.min(s).alias("min_sharpe"), F.max(s).alias("max_sharpe"), (F.count_if(s > 0) / F.count(F.lit(1))).alias("profitable"),
        F.coalesce(F.avg(F.when(F.col("train_sharpe") != 0, F.col("overfit_ratio"))), F.lit(0.0)).alias("overfit_ratio"), F.sum("test_n_trades").alias("n_trades"))
    n, error = F.col("folds"), F.col("std_sharpe") / F.sqrt("folds")
    known = (n >= 2) & (F.col("std_sharpe") > 0)
    g = g.withColumn("psr_z", F.when(known, F.col("mean_sharpe") / error)).withColumn("dsr_z", F.when(known, (F.col("mean_sharpe") - F.col("std_sharpe") * expected_best(n)) / error))
    unsure = F.when(F.col("mean_sharpe") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    g = g.withColumn("probabilistic_sharpe", F.coalesce(normal_cdf("psr_z"), unsure)).withColumn("deflated_sharpe", F.coalesce(normal_cdf("dsr_z"), F.lit(0.5)))
    gate = (F.col("mean_sharpe") > 0) & (F.col("overfit_ratio") > least_overfit) & (F.col("profitable") >= least_profitable) & (F.col("deflated_sharpe") >= least_deflated)
    return g.withColumn("passes", gate)


def per_fold(rows: DataFrame, fold: Fold, schema: str) -> DataFrame:
    """A user's mergeable fold of each fold and split to rows of ``schema``: states move, not rows."""
    return merged(rows, ["fold", "split"], fold, schema)


def funnel(stages: dict[str, DataFrame], by: str = "run_id") -> DataFrame:
    """stages in order, each with ``by`` -> counts and each stage's share of the one before."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        part = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name)).withColumn("nth", F.lit(i))
        out = part if out is None else out.unionByName(part)
    before = F.lag("n").over(Window.partitionBy(by).orderBy("nth"))
    return out.withColumn("share", F.try_divide(F.col("n"), before))
