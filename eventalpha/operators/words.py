"""Words and returns: scores of words, texts scored by them, trending words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventalpha.operators.features import on_days


def word_correlations(docs: DataFrame, tokens: str, ret: str, least: int, by: list[str] | None = None) -> DataFrame:
    """For each word (once for a document): (mean return with it - mean of all) / deviation of all.
    Sums combine on the map side; nothing of a frequent word is collected."""
    by = by or []
    every = docs.groupBy(*by).agg(F.avg(ret).alias("_mean"), F.stddev_pop(ret).alias("_std"))
    words = docs.select(*by, F.col(ret).alias("_r"), F.explode(F.array_distinct(tokens)).alias("word")).groupBy(*by, "word").agg(
        F.avg("_r").alias("_w"), F.count(F.lit(1)).alias("n_docs")
    ).filter(F.col("n_docs") >= least)
    joined = words.join(every, by) if by else words.withColumn("_one", F.lit(1)).join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")
    return joined.select(*by, "word", "n_docs", F.coalesce(F.try_divide(F.col("_w") - F.col("_mean"), F.col("_std")), F.lit(0.0)).alias("corr"))


def top_words(scores: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """The n best and n worst words beyond the threshold; ties by word."""
    best = scores.filter(F.col("corr") > threshold).orderBy(F.desc("corr"), "word").limit(n).withColumn("side", F.lit("best"))
    worst = scores.filter(F.col("corr") < -threshold).orderBy("corr", "word").limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def score_text(docs: DataFrame, tokens: str, scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """Mean score of a text's words (0 for unknown ones) and its best and worst words."""
    words = docs.select(key, F.size(tokens).alias("_n"), F.explode_outer(tokens).alias("word")).join(scores.select("word", "corr"), "word", "left")
    c = F.col("corr")
    return words.groupBy(key).agg(
        F.coalesce(F.sum(c) / F.max("_n"), F.lit(0.0)).alias("score"), F.count_if(c > threshold).alias("n_best"), F.count_if(c < -threshold).alias("n_worst"),
        F.array_join(F.sort_array(F.collect_set(F.when(c > threshold, F.col("word")))), "|").alias("best"),
        F.array_join(F.sort_array(F.collect_set(F.when(c < -threshold, F.col("word")))), "|").alias("worst"),
    )


def word_counts(texts: DataFrame, key: str, least: int = 6, text: str = "text") -> DataFrame:
    """key, word, n of the words of at least ``least`` letters; worth computing once for a text that
    many posts share."""
    words = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.filter(F.length("word") >= least).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def trending(words: DataFrame, k: int) -> DataFrame:
    """The k most frequent words of rows (word, n); ties by word."""
    return words.groupBy("word").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def listed(tokens: Column, words: list[str]) -> Column:
    """How many of the words are among the tokens."""
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))


def best_and_worst_counts(posts: DataFrame, events: DataFrame, days: int, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Sums of ``best`` and ``worst`` (see listed) over the positive and the negative posts of the days
    before each event; by day once, then over each event's days."""
    up, down = F.col("sentiment") > 0, F.col("sentiment") < 0
    sums = [F.sum(F.when(side, F.col(name)).otherwise(0)).alias(f"{name}_{kind}") for kind, side in (("positive", up), ("negative", down)) for name in ("best", "worst")]
    daily = posts.groupBy("ticker", F.to_date(ts).alias("day")).agg(*sums)
    return on_days(daily, events, days, -1, key).groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in daily.columns[2:]])
