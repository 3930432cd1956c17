"""Word scores as they were known on a date, and features of events from the texts before them."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.sources.tables import scratch


def _known(dates: list[datetime.date], day: str, following: Column) -> Column:
    """The dates on which what was known up to ``day`` is the latest: after it, up to the day that follows."""
    asked = F.array(*[F.lit(d) for d in sorted(set(dates))]).cast("array<date>")
    return F.explode(F.filter(asked, lambda d: (d > F.col(day)) & (following.isNull() | (d <= following))))


def score_table(docs: DataFrame, tokens: str, ret: str, date: str, dates: list[datetime.date], least: int) -> DataFrame:
    """as_of, word, n_docs, corr: for each of ``dates``, (mean return of the documents before it that have the word -
    mean of all before it) / deviation of all before it; words of ``least`` such documents. A document counts once
    for a word; one of the date itself does not count.

    Sums by word and day are added up along the days once, and each running sum goes to the dates on which it is
    the latest, so the work is not documents times dates. ``dates`` is a calendar (as long as the history, whatever
    the data) and becomes part of the plan."""
    rows = docs.select(F.col(date).alias("_day"), F.col(ret).cast("double").alias("_r"), F.col(tokens).alias("_t")).filter("_r is not null and _day is not null")
    by_word = Window.partitionBy("word").orderBy("_day")
    words = rows.select("_day", "_r", F.explode(F.array_distinct("_t")).alias("word")).groupBy("word", "_day").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("s"))
    upto = by_word.rowsBetween(Window.unboundedPreceding, 0)
    words = words.select("word", "_day", F.sum("n").over(upto).alias("n_docs"), F.sum("s").over(upto).alias("s"), F.lead("_day").over(by_word).alias("_next"))
    words = words.filter(F.col("n_docs") >= least).select(_known(dates, "_day", F.col("_next")).alias("as_of"), "word", "n_docs", "s")
    every = Window.partitionBy(F.lit(1)).orderBy("_day")  # a row a day
    so_far = every.rowsBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("s"), F.sum(F.col("_r") * F.col("_r")).alias("ss"))
    days = days.select("_day", *[F.sum(c).over(so_far).alias(c) for c in ("n", "s", "ss")], F.lead("_day").over(every).alias("_next"))
    mean = F.col("s") / F.col("n")
    days = days.select(_known(dates, "_day", F.col("_next")).alias("as_of"), mean.alias("_mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("_std"))
    corr = F.coalesce(F.try_divide(F.col("s") / F.col("n_docs") - F.col("_mean"), F.col("_std")), F.lit(0.0))
    return words.join(days, "as_of").select("as_of", "word", "n_docs", corr.alias("corr"))


#: What an event without words or posts in its window gets.
NO_WORDS = {"word_score": 0.0, "n_best_words": 0, "n_worst_words": 0, "best_positive": 0, "worst_positive": 0, "best_negative": 0, "worst_negative": 0}
NO_TERMS = {"dict_positive": 0, "dict_negative": 0, "dict_polarity": 0.0, "dict_subjectivity": 0.0}


PORTION = 1 << 20  # scores that go to all tasks at once, some 30 MB


def _windows(events: DataFrame, days: int, date: str) -> DataFrame:
    """(ticker, as_of, day) for the days before each date that a ticker has an event on; events of a ticker and
    date share their window."""
    spread = events.select("ticker", F.col(date).alias("as_of")).distinct()
    return spread.withColumn("day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda i: F.date_sub("as_of", i))))


def _daily(posts: DataFrame, doc: str, ts: str, high: float) -> DataFrame:
    s = F.col("sentiment")
    return posts.groupBy("ticker", F.to_date(ts).alias("day"), doc).agg(F.count(F.lit(1)).alias("k"), F.count_if(s > high).alias("up"), F.count_if(s < -high).alias("down"))


def word_features(
    posts: DataFrame, texts: DataFrame, tokens: str, events: DataFrame, scores: DataFrame, doc: str = "doc_id", days: int = 7, threshold: float = 0.1,
    high: float = 0.1, date: str = "event_date", ts: str = "ts",
) -> DataFrame:
    """ticker, as_of and, of the posts in the ``days`` before: mean score of all words (0 for unknown ones), how
    many of them score beyond the threshold, and in how many positive and negative posts each such word stands.
    ``texts`` (doc, tokens) has a text once, however many posts share it; ``scores`` is a ``score_table``.

    A text is scored once for each date, and posts meet its sums, not its words: the work is texts times words times
    dates of the calendar, plus posts. The words of a text are counted and written as one row, and scores go to all tasks, in
    portions of ``PORTION``, so a text is summed up where it is read: what is moved of it is a row of sums for each date
    and portion. Posts are dealt out by text once, and meet the dates that they count for after that."""
    windows = _windows(events, days, date).groupBy("ticker", "day").agg(F.collect_list("as_of").alias("_dates"))
    near = _daily(posts.repartition(doc), doc, ts, high).join(windows, ["ticker", "day"])
    spark, path = texts.sparkSession, scratch(texts.sparkSession, "word-counts")
    counts = texts.select(doc, tokens).repartition(doc).select(doc, F.explode(tokens).alias("word")).groupBy(doc, "word").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(doc).agg(F.collect_list(F.struct("word", "n")).alias("_words"))
    packed.write.parquet(path)
    counts = spark.read.schema(packed.schema).parquet(path).select(doc, F.inline("_words"))
    parts = max(1, -(-scores.count() // PORTION))
    portions = [scores.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == i).groupBy("word").agg(F.collect_list(F.struct("as_of", "corr")).alias("_scores")) for i in range(parts)]
    met = [counts.join(F.broadcast(some), "word").select(doc, "n", F.inline("_scores")) for some in portions]  # bounded by PORTION
    c, n = F.col("corr"), F.col("n")
    best, worst = c > threshold, c < -threshold
    of_text = reduce(DataFrame.union, met).groupBy(doc, "as_of").agg(
        F.sum(c * n).alias("_c"), F.sum(F.when(best, n)).alias("_nb"), F.sum(F.when(worst, n)).alias("_nw"), F.count_if(best).alias("_b"), F.count_if(worst).alias("_w"))
    of_text = of_text.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("as_of", F.struct("_c", "_nb", "_nw", "_b", "_w")))).alias("_sums"))
    joined = near.join(texts.select(doc, F.size(tokens).alias("_n")), doc).join(of_text, doc, "left")
    joined = joined.select("ticker", "k", "up", "down", "_n", "_sums", F.explode("_dates").alias("as_of")).withColumn("_at", F.element_at("_sums", F.col("as_of")))
    times = lambda x, y: F.coalesce(F.sum(F.col(x) * F.col("_at")[y]), F.lit(0))
    out = joined.groupBy("ticker", "as_of").agg(
        F.try_divide(F.sum(F.col("k") * F.col("_at")["_c"]), F.sum(F.col("k") * F.col("_n"))).alias("word_score"), times("k", "_nb").alias("n_best_words"), times("k", "_nw").alias("n_worst_words"),
        times("up", "_b").alias("best_positive"), times("up", "_w").alias("worst_positive"), times("down", "_b").alias("best_negative"), times("down", "_w").alias("worst_negative"))
    return out.select("ticker", "as_of", *NO_WORDS).fillna(NO_WORDS)


def term_features(
    posts: DataFrame, texts: DataFrame, positive: list[str], negative: list[str], events: DataFrame, doc: str = "doc_id", days: int = 7, text: str = "text",
    date: str = "event_date", ts: str = "ts",
) -> DataFrame:
    """ticker, as_of and the dictionary scores of all texts in the ``days`` before taken together: a term counts
    once, however many texts have it. A text is searched once, however many posts share it."""
    low = F.lower(text)
    flags = [F.contains(low, F.lit(t.lower())).cast("int") for t in [*positive, *negative]]
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    seen = texts.filter(F.col(text).isNotNull()).select(doc, words.alias("_n"), *[f.alias(f"_t{i}") for i, f in enumerate(flags)])
    daily = posts.repartition(doc).groupBy("ticker", F.to_date(ts).alias("day"), doc).agg(F.count(F.lit(1)).alias("k")).join(seen, doc)
    terms = [f"_t{i}" for i in range(len(flags))]
    daily = daily.groupBy("ticker", "day").agg(F.sum(F.col("k") * F.col("_n")).alias("_n"), *[F.max(t).alias(t) for t in terms])
    near = _windows(events, days, date).join(daily, ["ticker", "day"]).groupBy("ticker", "as_of").agg(F.sum("_n").alias("_n"), *[F.max(t).alias(t) for t in terms])
    up, down = (sum((F.col(t) for t in side), F.lit(0)) for side in (terms[: len(positive)], terms[len(positive) :]))
    near = near.withColumn("dict_positive", up).withColumn("dict_negative", down)
    both = F.col("dict_positive") + F.col("dict_negative")
    polarity = F.coalesce(F.try_divide(F.col("dict_positive") - F.col("dict_negative"), both), F.lit(0.0))
    return near.select("ticker", "as_of", "dict_positive", "dict_negative", polarity.alias("dict_polarity"), (both / F.greatest("_n", F.lit(1))).alias("dict_subjectivity"))


def feature_matrix(events: DataFrame, temporal: DataFrame, words: DataFrame, terms: DataFrame, kinds: dict[str, str], kind: str, key: str = "event_id", date: str = "event_date") -> DataFrame:
    """``key`` and all feature columns of each event: those of its own window (``temporal``, by key), those of its
    ticker's texts before its date (``words``, ``terms``), and a 0/1 column for each of ``kinds`` (name -> value)."""
    out = events.select(key, "ticker", F.col(date).alias("as_of"), *[F.coalesce((F.col(kind) == v).cast("int"), F.lit(0)).alias(n) for n, v in kinds.items()])
    out = out.join(temporal, key, "left").join(words, ["ticker", "as_of"], "left").join(terms, ["ticker", "as_of"], "left")
    return out.drop("ticker", "as_of").fillna({**NO_WORDS, **NO_TERMS})
