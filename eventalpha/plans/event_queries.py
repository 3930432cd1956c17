"""Queries over posts and events: fusion, quality, joins, reaction and word features."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventalpha.functions import text as X
from eventalpha.operators import features as FE
from eventalpha.operators import joins as J
from eventalpha.operators import market as M
from eventalpha.operators import pointintime as PIT
from eventalpha.operators import posts as P
from eventalpha.operators import quality as Q
from eventalpha.operators import words as W
from eventalpha.plans.text_queries import NEGATIVE, POSITIVE
from eventalpha.sources.tables import scratch
from eventalpha.plans.base import events, filings, posts, posts_text, prices, query, scored, sectors, signals, table, ticker, universe, weights


# --- fusion ---


@query("""SELECT ts AS timestamp, source AS text, CASE WHEN post_id % 3 = 0 THEN 1 ELSE followers END AS user_followers, CAST(0 AS BIGINT) AS retweets, likes, ticker, CASE WHEN post_id % 4 <> 0 THEN sentiment END AS sentiment,
    CAST(0 AS DOUBLE) AS esg_relevance, 'general' AS esg_category, CASE WHEN post_id % 5 = 0 THEN 0.5 ELSE quality END AS quality_score FROM posts""", "posts")
def posts_conform(spark, d):
    raw = posts(spark, d).select(
        F.col("ts").alias("timestamp"), F.col("source").alias("text"), F.when(F.col("post_id") % 3 == 0, "n/a").otherwise(F.col("followers").cast("string")).alias("user_followers"), "likes", "ticker",
        F.when(F.col("post_id") % 4 == 0, "").otherwise(F.col("sentiment").cast("string")).alias("sentiment"), F.when(F.col("post_id") % 5 != 0, F.col("quality")).alias("quality_score"), F.lit(1).alias("surplus"))
    return P.conform(raw)


_THREE = """u AS (SELECT post_id, ticker, ts, sentiment, CASE post_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source, quality,
    concat(upper(source), ' ', CAST(post_id % 97 AS VARCHAR)) AS text FROM posts)"""


def three(spark, d):
    p = posts(spark, d).select("post_id", "ticker", "ts", "sentiment", "quality", F.concat(F.upper("source"), F.lit(" "), (F.col("post_id") % 97).cast("string")).alias("text"))
    return P.union({k: p.filter(F.col("post_id") % 3 == i) for i, k in enumerate("abc")})


@query(f", {_THREE} SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(post_id) AS BIGINT) AS ids FROM u GROUP BY source", "posts")
def posts_union(spark, d):
    return three(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("post_id").alias("ids"))


@query(f", {_THREE} SELECT post_id, source, text FROM u QUALIFY row_number() OVER (PARTITION BY trim(lower(left(text, 100))) ORDER BY source, ts, post_id) = 1", "posts")
def posts_dedup(spark, d):
    return P.dedup_text(three(spark, d), [F.col("source"), F.col("ts"), F.col("post_id")]).select("post_id", "source", "text")


@query("SELECT ticker, post_id, quality FROM posts QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY quality DESC, post_id) <= 20", "posts")
def posts_topn(spark, d):
    return P.top_n(posts(spark, d), ["ticker"], [F.desc("quality"), F.col("post_id")], 20).select("ticker", "post_id", "quality")


@query("SELECT ticker, CAST(ts AS DATE) AS day, CAST(count(DISTINCT source) AS BIGINT) AS n_sources FROM posts GROUP BY ALL HAVING count(DISTINCT source) >= 3", "posts")
def source_quorum(spark, d):
    return P.quorum(posts(spark, d).withColumn("day", F.to_date("ts")), ["ticker", "day"], 3)


@query("""SELECT ticker, day, CAST(count(*) AS BIGINT) AS n_sources, CASE WHEN count(*) < 2 THEN 0 ELSE round(greatest(count(*) FILTER (m > 0), count(*) FILTER (m < 0), count(*) FILTER (m = 0)) / count(*), 3) END AS source_agreement
    FROM (SELECT ticker, CAST(ts AS DATE) AS day, source, CASE WHEN abs(sum(CAST(round(sentiment * 100) AS BIGINT))) > count(*) THEN sign(sum(CAST(round(sentiment * 100) AS BIGINT))) ELSE 0 END AS m FROM posts GROUP BY ALL) GROUP BY ALL""", "posts")
def source_agreement(spark, d):
    return P.source_agreement(posts(spark, d).withColumn("day", F.to_date("ts")), ["ticker", "day"])


@query("SELECT min(post_id) AS post_id, concat('https://x/', CAST(post_id % 700 AS VARCHAR)) AS url FROM posts GROUP BY url", "posts")
def posts_dedup_id(spark, d):
    p = posts(spark, d).withColumn("url", F.concat(F.lit("https://x/"), (F.col("post_id") % 700).cast("string")))
    return P.first_of(p, [F.col("url")], [F.col("post_id")]).select("post_id", "url")


@query("""SELECT post_id, CASE WHEN post_id % 4 = 0 THEN CASE WHEN post_id % 8 = 0 THEN 0 ELSE quality END ELSE sentiment END AS sentiment FROM posts""", "posts")
def fill_sentiment(spark, d):
    given = F.when(F.col("post_id") % 4 == 0, "none").otherwise(F.col("sentiment").cast("string"))
    return posts(spark, d).select("post_id", FE.fill_sentiment(given, F.when(F.col("post_id") % 8 != 0, F.col("quality"))).alias("sentiment"))


# --- quality ---


@query("""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (filing_id % 7 <> 0 AND date BETWEEN '2024-01-03' AND '2024-01-28') AS BIGINT) AS valid,
    CAST(count(*) FILTER (filing_id % 7 <> 0 AND NOT date BETWEEN '2024-01-03' AND '2024-01-28') AS BIGINT) AS out_of_range, CAST(count(*) FILTER (filing_id % 7 = 0) AS BIGINT) AS invalid,
    1 - count(*) FILTER (filing_id % 7 <> 0 AND date BETWEEN '2024-01-03' AND '2024-01-28') / count(*) > 0.1 AS alert FROM filings""", "filings")
def date_validate(spark, d):
    f = filings(spark, d).withColumn("date", F.when(F.col("filing_id") % 7 == 0, "soon").otherwise(F.col("date").cast("string")))
    return Q.validate_dates(f, "date", "2024-01-03", "2024-01-28")


@query("SELECT f.filing_id, f.date FROM filings f WHERE f.date > DATE '2024-01-05' + CAST(f.filing_id % 20 AS INTEGER)", "filings")
def lookahead_check(spark, d):
    f = filings(spark, d).withColumn("ref", F.date_add(F.lit("2024-01-05").cast("date"), (F.col("filing_id") % 20).cast("int")))
    return Q.lookahead(f, "date", "ref").select("filing_id", "date")


_BAD = """bad AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE intensity * 1.2 END AS raw_score, event_id % 7 AS quintile, event_confidence, n_posts - 2 AS n_posts FROM sigs)"""


def bad_signals(spark, d):
    k = F.col("event_id")
    return signals(spark, d).select("event_id", F.when(k % 11 != 0, F.col("intensity") * 1.2).alias("raw_score"), (k % 7).alias("quintile"), "event_confidence", (F.col("n_posts") - 2).alias("n_posts"))


@query(f""", {_BAD} SELECT * FROM (SELECT unnest(['raw_score', 'raw_score', 'raw_score', 'quintile', 'quintile', 'n_posts', 'volume_ratio']) AS "column", unnest(['null', 'below', 'above', 'below', 'above', 'below', 'missing']) AS problem,
    unnest([count(*) FILTER (raw_score IS NULL), count(*) FILTER (raw_score < -1), count(*) FILTER (raw_score > 1), count(*) FILTER (quintile < 1), count(*) FILTER (quintile > 5), count(*) FILTER (n_posts < 0), count(*)]) AS n FROM bad) WHERE n > 0""", "sigs")
def signal_violations(spark, d):
    return Q.signal_violations(bad_signals(spark, d))


@query(f""", {_BAD} SELECT event_id, round(coalesce(greatest(least(raw_score, 1), -1), 0), 6) AS raw_score, CAST(greatest(least(quintile, 5), 1) AS INTEGER) AS quintile, event_confidence, CAST(greatest(n_posts, 0) AS INTEGER) AS n_posts, CAST(0 AS DOUBLE) AS volume_ratio
    FROM (SELECT * REPLACE (coalesce(raw_score, 0) AS raw_score) FROM bad)""", "sigs")
def signal_enforce(spark, d):
    return Q.enforce_signals(bad_signals(spark, d)).withColumn("raw_score", F.round("raw_score", 6))


@query("""SELECT CAST(25 AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS covered, count(*) / 25 AS coverage, sum(n) / 25 AS posts_per_ticker,
      round(date_diff('second', max(last), TIMESTAMP '2024-02-01 00:00:00') / 3600, 4) AS stale_hours, CASE WHEN count(*) / 25 >= 0.8 THEN 'FULL' WHEN count(*) / 25 >= 0.5 THEN 'PARTIAL' WHEN count(*) / 25 >= 0.2 THEN 'SPARSE' ELSE 'DROPOUT' END AS quality,
      count(*) / 25 < 0.2 AS halt FROM (SELECT ticker, count(*) AS n, max(date_trunc('second', ts)) AS last FROM posts GROUP BY ticker)""", "posts")
def coverage(spark, d):
    expected = spark.range(25).select(ticker(F.col("id")).alias("ticker"))
    p = posts(spark, d).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return Q.coverage(expected, p, "2024-02-01 00:00:00").withColumn("stale_hours", F.round("stale_hours", 4))


@query("SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM posts GROUP BY ticker HAVING count(*) >= 30", "posts")
def covered_tickers(spark, d):
    return Q.covered(posts(spark, d), 30)


@query("""SELECT event_id, quality, CAST(m AS DOUBLE) AS size_multiplier, round(0.2 / (0.2 + 0.8 * w), 6) AS event_severity, round(0.4 * w / (0.2 + 0.8 * w), 6) AS intensity, round(0.25 * w / (0.2 + 0.8 * w), 6) AS volume, round(0.15 * w / (0.2 + 0.8 * w), 6) AS duration
    FROM (SELECT event_id, ['FULL', 'PARTIAL', 'SPARSE', 'DROPOUT'][event_id % 4 + 1] AS quality, [1, 0.7, 0.4, 0][event_id % 4 + 1] AS m, [1, 0.8, 0.5, 0][event_id % 4 + 1] AS w FROM sigs)""", "sigs")
def quality_weights(spark, d):
    q = F.get(F.array(*[F.lit(x) for x in ("FULL", "PARTIAL", "SPARSE", "DROPOUT")]), (F.col("event_id") % 4).cast("int"))
    w = signals(spark, d).select("event_id", q.alias("quality"), F.lit(0.2).alias("event_severity"), F.lit(0.4).alias("intensity"), F.lit(0.25).alias("volume"), F.lit(0.15).alias("duration"))
    out = Q.reweight(w, "event_severity", ["intensity", "volume", "duration"])
    return out.select("event_id", "quality", "size_multiplier", *[F.round(c, 6).alias(c) for c in ("event_severity", "intensity", "volume", "duration")])


_HOURS = """h AS (SELECT ticker, date_trunc('hour', ts) AS ts, CASE WHEN count(*) >= 3 THEN 'FULL' WHEN count(*) = 2 THEN 'SPARSE' ELSE 'DROPOUT' END AS quality FROM posts GROUP BY ALL)"""


@query(f""", {_HOURS} SELECT ticker, ts, quality, CASE WHEN n >= 2 AND nd / n >= 0.5 THEN 'HIGH' WHEN n >= 2 AND ns / n >= 0.7 THEN 'MEDIUM' ELSE 'NONE' END AS alert FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (quality = 'DROPOUT') OVER w AS nd, count(*) FILTER (quality = 'SPARSE') OVER w AS ns
    FROM h WINDOW w AS (PARTITION BY ticker ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW))""", "posts")
def quality_alerts(spark, d):
    n = F.count("*")
    h = posts(spark, d).groupBy("ticker", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.when(n >= 3, "FULL").when(n == 2, "SPARSE").otherwise("DROPOUT").alias("quality"))
    return Q.quality_alerts(h, 6, ["ticker"])


@query("""SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (n_posts > 0) / count(*), 6) AS covered, CASE WHEN count(*) > 1 THEN round(corr(event_id % 5 + 1, raw_score), 6) END AS corr, CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS q1,
    CAST(count(*) FILTER (event_id % 5 = 2) AS BIGINT) AS q3, CAST(count(*) FILTER (event_id % 5 = 4) AS BIGINT) AS q5, count(*) < 10 AS low FROM scored GROUP BY ROLLUP (date_trunc('month', date))""", "scored")
def signal_quality(spark, d):
    out = Q.signal_quality(scored(spark, d).withColumn("quintile", F.col("event_id") % 5 + 1))
    return out.withColumn("corr", F.round("corr", 6)).withColumn("covered", F.round("covered", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(raw_score), 6) AS mean, round(stddev_pop(raw_score), 6) AS std, min(raw_score) AS min, max(raw_score) AS max, median(raw_score) AS median FROM scored", "scored")
def signal_stats(spark, d):
    return Q.signal_stats(scored(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


# --- joins ---


@query("""SELECT event_id, post_id, round(epoch_us(ts) / 86400e6 - epoch_us(CAST(event_date AS TIMESTAMP)) / 86400e6, 6) AS days FROM posts p JOIN evts e ON p.ticker = e.ticker
    AND ts >= event_date - INTERVAL 10 DAYS AND ts <= event_date + INTERVAL 3 DAYS""", "posts evts")
def event_window_join(spark, d):
    p, e = posts(spark, d).select("post_id", "ticker", "ts"), events(spark, d).select("event_id", "ticker", "event_date")
    return J.interval_join(p, e, 10, 3, digits=6).select("event_id", "post_id", "days")


@query("""SELECT event_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(post_id) AS BIGINT) AS ids FROM posts p JOIN evts e ON p.ticker = e.ticker AND ts >= event_date - INTERVAL 7 DAYS AND ts < event_date GROUP BY event_id""", "posts evts")
def pre_window_join(spark, d):
    return FE.window_sums(posts(spark, d), events(spark, d), {"ids": F.col("post_id")})


@query("SELECT s.event_id, s.ticker, s.date, p.close AS close_asof FROM sigs s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.date >= p.date", "sigs prices")
def price_asof(spark, d):
    return M.price_asof(signals(spark, d).select("event_id", "ticker", "date"), prices(spark, d))


@query("""SELECT s.event_id, round(f.r, 6) AS forward_ret FROM sigs s JOIN (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS r FROM prices) f USING (ticker, date)""", "sigs prices")
def docs_returns(spark, d):
    f = M.forward_return(prices(spark, d), 5).select("ticker", "date", "forward_ret")
    return signals(spark, d).join(f, ["ticker", "date"]).select("event_id", F.round("forward_ret", 6).alias("forward_ret"))


@query("""SELECT a.date, round(a.ret, 6) AS a, round(b.ret, 6) AS b FROM rets a JOIN rets b ON a.date = b.date AND a.run_id = 'T01' AND b.run_id = 'T02'""", "rets")
def align_returns(spark, d):
    from eventalpha.plans.base import returns

    r = returns(spark, d)
    a, b = (r.filter(F.col("run_id") == x).select("date", F.round("ret", 6).alias(n)) for x, n in (("T01", "a"), ("T02", "b")))
    return J.align(a, b, ["date"])


@query("""SELECT coalesce(t.date, c.date) AS date, coalesce(t.ticker, c.ticker) AS ticker, coalesce(t.weight, 0) AS target, coalesce(c.weight, 0) AS current
    FROM weights t FULL JOIN (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS date, ticker, weight FROM weights) c ON t.date = c.date AND t.ticker = c.ticker""", "weights")
def weights_outer(spark, d):
    w = weights(spark, d)
    return J.outer_weights(w, w.withColumn("date", F.add_months("date", 1)), ["date", "ticker"])


_GRID = """grid AS (SELECT s.*, CAST(DATE '2024-01-05' + CAST(k * 7 AS INTEGER) AS DATE) AS grid_date FROM (SELECT *, unnest(range(CAST(ceil(date_diff('day', DATE '2024-01-05', date) / 7) AS BIGINT), CAST(ceil((date_diff('day', DATE '2024-01-05', date) + 49) / 7) AS BIGINT))) AS k FROM scored) s),
    book AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY grid_date, ticker ORDER BY date DESC, raw_score DESC, event_id) = 1)"""


@query(f", {_GRID} SELECT grid_date, ticker, event_id FROM book", "scored")
def signal_book(spark, d):
    return latest_on_grid(spark, d).select("grid_date", "ticker", "event_id")


def latest_on_grid(spark, d):
    return P.first_of(J.on_grid(scored(spark, d), 7, 49), [F.col("grid_date"), F.col("ticker")], [F.negative(F.datediff("date", F.lit("2020-01-01").cast("date"))), -F.col("raw_score"), F.col("event_id")])


@query("SELECT filing_id, ticker FROM filings WHERE ticker IN (SELECT ticker FROM universe WHERE cap > 5000)", "filings universe")
def universe_semi(spark, d):
    return J.restrict(filings(spark, d), universe(spark, d).filter("cap > 5000"), ["ticker"]).select("filing_id", "ticker")


@query("""SELECT event_id, ticker FROM evts WHERE (ticker, event_date) NOT IN (SELECT (ticker, CAST(ts AS DATE)) FROM posts GROUP BY ticker, CAST(ts AS DATE)
    HAVING sum(CAST(round(sentiment * 100) AS BIGINT)) > 0)""", "evts posts")
def missing_posts(spark, d):
    """Events on days without posts of good mood on the whole."""
    total = F.sum(F.round(F.col("sentiment") * 100).cast("long"))
    days = posts(spark, d).groupBy("ticker", F.to_date("ts").alias("event_date")).agg(total.alias("mood")).filter("mood > 0")
    return J.missing(events(spark, d), days, ["ticker", "event_date"]).select("event_id", "ticker")


@query("SELECT e.event_id, coalesce(s.sector, 'UNMAPPED') AS sector FROM evts e LEFT JOIN sectors s USING (ticker)", "evts sectors")
def sector_lookup(spark, d):
    return J.lookup(events(spark, d), sectors(spark, d), "ticker", "sector").select("event_id", "sector")


@query("""SELECT post_id, coalesce(CASE WHEN post_id % 150 < 100 THEN post_id % 150 * 10 END, 0) AS followers FROM posts WHERE source <> 'view'""", "posts")
def post_authors(spark, d):
    authors = spark.range(100).select(F.col("id").alias("author_id"), (F.col("id") * 10).alias("followers"))
    p = posts(spark, d).drop("followers").withColumn("author_id", F.col("post_id") % 150)
    return J.posts_with_authors(p, authors, F.col("source") != "view").select("post_id", "followers")


# --- features ---

_AROUND = """around AS (SELECT e.event_id, p.*, (epoch_us(ts) - epoch_us(CAST(event_date AS TIMESTAMP))) / 86400e6 AS days, CAST(ts AS DATE) AS day, (retweets + likes / 10) * ln(1 + followers) AS v
      FROM posts p JOIN evts e ON p.ticker = e.ticker AND ts >= event_date - INTERVAL 10 DAYS AND ts <= event_date + INTERVAL 3 DAYS),
    reac AS (SELECT a.event_id, coalesce(sum(sentiment * (v + 1) * (quality + 0.5)) FILTER (days >= 0) / sum((v + 1) * (quality + 0.5)) FILTER (days >= 0), 0) AS intensity, count(*) FILTER (days >= 0) AS n_post, count(*) FILTER (days < 0) AS n_pre,
      coalesce(ln(1 + avg(v) FILTER (days >= 0)), 0) AS amplification, avg(sentiment) FILTER (days < 0) AS pre, count(*) AS n_posts, any_value(dd.n) AS duration_days
      FROM around a LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT event_id, day FROM around WHERE days >= 0 GROUP BY ALL HAVING abs(round(avg(sentiment), 9)) > 0.2) GROUP BY event_id) dd ON a.event_id = dd.event_id GROUP BY a.event_id)"""


@query(f""", {_AROUND} SELECT e.event_id, round(coalesce(intensity, 0), 6) AS intensity, round(CASE WHEN r.event_id IS NULL OR n_post = 0 THEN 1 WHEN n_pre < 3 THEN ln(1 + n_post) ELSE n_post / n_pre END, 6) AS volume_ratio,
      CAST(coalesce(duration_days, 0) AS BIGINT) AS duration_days, round(coalesce(amplification, 0), 6) AS amplification, round(CASE WHEN coalesce(n_pre, 0) = 0 THEN 0 ELSE (n_post - n_pre) / sqrt(n_pre) END, 6) AS baseline_deviation,
      round(CASE WHEN coalesce(n_pre, 0) < 3 THEN 0 ELSE pre END, 6) AS pre_event_sentiment, CAST(coalesce(n_posts, 0) AS BIGINT) AS n_posts, CAST(coalesce(n_pre, 0) AS BIGINT) AS n_pre, CAST(coalesce(n_post, 0) AS BIGINT) AS n_post
    FROM evts e LEFT JOIN reac r USING (event_id)""", "posts evts")
def reaction_features(spark, d):
    e = events(spark, d)
    f = FE.with_defaults(e.select("event_id"), FE.reaction_features(posts(spark, d), e))
    return f.select("event_id", *[F.round(c, 6).alias(c) for c in ("intensity", "volume_ratio", "amplification", "baseline_deviation", "pre_event_sentiment")], "duration_days", "n_posts", "n_pre", "n_post")


_BEFORE = """bef AS (SELECT e.event_id, p.*, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY e.event_id ORDER BY ts, post_id) AS nth FROM {} p JOIN evts e ON p.ticker = e.ticker AND ts >= event_date - INTERVAL 7 DAYS AND ts < event_date)"""


@query(f""", {_BEFORE.format('posts_text')} SELECT e.event_id, CAST(coalesce(n, 0) AS BIGINT) AS n_posts, CAST(coalesce(np, 0) AS BIGINT) AS n_positive, CAST(coalesce(nn, 0) AS BIGINT) AS n_negative, CAST(coalesce(sp, 0) AS BIGINT) AS n_strong_positive, CAST(coalesce(sn, 0) AS BIGINT) AS n_strong_negative,
      CAST(coalesce(nw, 0) AS BIGINT) AS n_words, round(coalesce(m, 0), 8) AS mean, round(coalesce(sd, 0), 8) AS std, coalesce(mx, 0) AS max, coalesce(mi, 0) AS min, CAST(coalesce(nd, 0) AS BIGINT) AS n_days, round(coalesce(np / greatest(nn, 1), 0), 8) AS ratio, round(coalesce(n, 0) / 7, 8) AS daily_volume, round(coalesce(nd, 0) / 7, 8) AS coverage
    FROM evts e LEFT JOIN (SELECT event_id, count(*) AS n, count(*) FILTER (sentiment > 0.1) AS np, count(*) FILTER (sentiment < -0.1) AS nn, count(*) FILTER (sentiment > 0.5) AS sp, count(*) FILTER (sentiment < -0.5) AS sn,
      sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS nw, avg(sentiment) AS m, stddev_samp(sentiment) AS sd, max(sentiment) AS mx, min(sentiment) AS mi, count(DISTINCT day) AS nd FROM bef GROUP BY event_id) f USING (event_id)""", "posts_text evts")
def temporal_features(spark, d):
    p = posts_text(spark, d, lambda docs: docs.select("doc_id", FE.word_count().alias("n_words")))
    out = FE.temporal_features(p, events(spark, d))
    return out.select(*[F.round(c, 8).alias(c) if c in ("mean", "std", "ratio", "daily_volume", "coverage") else F.col(c) for c in out.columns])


@query(f", {_BEFORE.format('posts')} SELECT event_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(sentiment, nth) END, 6) AS trend FROM bef GROUP BY event_id", "posts evts")
def sentiment_trend(spark, d):
    return FE.sentiment_trend(posts(spark, d), events(spark, d)).withColumn("trend", F.round("trend", 6))


@query(f""", {_BEFORE.format('posts')} SELECT event_id, round(coalesce(avg(d2), 0) + 1e-9, 6) AS acceleration FROM (SELECT event_id, sentiment - 2 * lag(sentiment) OVER w + lag(sentiment, 2) OVER w AS d2 FROM bef WINDOW w AS (PARTITION BY event_id ORDER BY nth)) GROUP BY event_id""", "posts evts")
def sentiment_accel(spark, d):
    return FE.sentiment_acceleration(posts(spark, d), events(spark, d)).withColumn("acceleration", F.round(F.col("acceleration") + 1e-9, 6))


@query(f""", {_BEFORE.format('posts')} SELECT event_id, round(CASE WHEN count(*) < 2 THEN 1 ELSE (sum(n * n) / (sum(n) * sum(n)) - 1 / count(*)) / (1 - 1 / count(*)) END, 6) AS concentration FROM (SELECT event_id, day, count(*) AS n FROM bef GROUP BY ALL) GROUP BY event_id""", "posts evts")
def volume_hhi(spark, d):
    return FE.volume_concentration(posts(spark, d), events(spark, d)).withColumn("concentration", F.round("concentration", 6))


BEST, WORST = ["the", "que", "ing", "und"], ["and", "les", "der", "del"]


@query(f""", {_BEFORE.format('posts_text')}, t AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM bef),
    c AS (SELECT event_id, sentiment, len(list_filter(w, lambda x: x IN ('the', 'que', 'ing', 'und'))) AS b, len(list_filter(w, lambda x: x IN ('and', 'les', 'der', 'del'))) AS o FROM t)
    SELECT event_id, CAST(coalesce(sum(b) FILTER (sentiment > 0), 0) AS BIGINT) AS best_positive, CAST(coalesce(sum(o) FILTER (sentiment > 0), 0) AS BIGINT) AS worst_positive, CAST(coalesce(sum(b) FILTER (sentiment < 0), 0) AS BIGINT) AS best_negative,
      CAST(coalesce(sum(o) FILTER (sentiment < 0), 0) AS BIGINT) AS worst_negative FROM c GROUP BY event_id""", "posts_text evts")
def wordcorr_counts(spark, d):
    def counted(docs):
        w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
        return docs.select("doc_id", *[W.listed(w, x).alias(n) for n, x in (("best", BEST), ("worst", WORST))])

    return W.best_and_worst_counts(posts_text(spark, d, counted), events(spark, d), 7)


_DR = "dr AS (SELECT filing_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3) AS w, (filing_id * 37 % 201 - 100) / 1000 AS r, filing_id % 3 AS yr FROM filings)"
_DOCRET = f"""{_DR},
    dw AS (SELECT filing_id, r, yr, unnest(list_distinct(w)) AS word FROM dr),
    ws AS (SELECT word, count(*) AS n_docs, (avg(r) - (SELECT avg(r) FROM dr)) / (SELECT stddev_pop(r) FROM dr) AS corr FROM dw GROUP BY word HAVING count(*) >= 10)"""


def docs_with_returns(spark, d):
    i = F.col("filing_id")
    return filings(spark, d).select("filing_id", X.word_tokens(F.col("text")).alias("w"), ((i * 37 % 201 - 100) / 1000).alias("r"), (i % 3).alias("yr"))


@query(f""", {_DOCRET}, y AS (SELECT yr, avg(r) AS m, stddev_pop(r) AS s FROM dr GROUP BY yr) SELECT yr, word, CAST(count(*) AS BIGINT) AS n_docs, round((avg(r) - any_value(m)) / any_value(s), 6) AS corr FROM dw JOIN y USING (yr) GROUP BY yr, word HAVING count(*) >= 5""", "filings")
def word_correlations(spark, d):
    return W.word_correlations(docs_with_returns(spark, d), "w", "r", 5, ["yr"]).withColumn("corr", F.round("corr", 6))


def word_scores(spark, d):
    return W.word_correlations(docs_with_returns(spark, d), "w", "r", 10).withColumn("corr", F.round("corr", 6))


@query(f""", {_DOCRET}, wr AS (SELECT word, n_docs, round(corr, 6) AS corr FROM ws) (SELECT word, CAST(n_docs AS BIGINT) AS n_docs, corr, 'best' AS side FROM wr WHERE corr > 0.05 ORDER BY corr DESC, word LIMIT 15)
    UNION ALL (SELECT word, CAST(n_docs AS BIGINT) AS n_docs, corr, 'worst' AS side FROM wr WHERE corr < -0.05 ORDER BY corr, word LIMIT 15)""", "filings")
def top_words(spark, d):
    return W.top_words(word_scores(spark, d), 15, 0.05)


@query(f""", {_DOCRET}, wr AS (SELECT word, round(corr, 6) AS corr FROM ws), x AS (SELECT filing_id, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM dr)
    SELECT filing_id, round(coalesce(sum(corr) / max(n), 0), 6) AS score, CAST(count(*) FILTER (corr > 0.1) AS BIGINT) AS n_best, CAST(count(*) FILTER (corr < -0.1) AS BIGINT) AS n_worst,
      md5(coalesce(string_agg(DISTINCT CASE WHEN corr > 0.1 THEN word END, '|' ORDER BY CASE WHEN corr > 0.1 THEN word END), '')) AS best_md5 FROM x LEFT JOIN wr USING (word) GROUP BY filing_id""", "filings")
def score_text(spark, d):
    out = W.score_text(docs_with_returns(spark, d), "w", word_scores(spark, d), "filing_id", 0.1)
    return out.select("filing_id", F.round("score", 6).alias("score"), "n_best", "n_worst", F.md5("best").alias("best_md5"))


@query("""SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM posts_text) WHERE length(word) >= 6 GROUP BY word ORDER BY n DESC, word LIMIT 10""", "posts_text")
def trending_terms(spark, d):
    return W.trending(posts_text(spark, d, lambda docs: W.word_counts(docs, "doc_id")).filter("word is not null"), 10)


@query("SELECT ticker, date, round(close / lag(close) OVER w - 1, 6) AS ret, round(ln(close / lag(close) OVER w), 6) AS log_ret, round(lead(close, 3) OVER w / close - 1, 6) AS forward_ret FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)", "prices")
def returns(spark, d):
    p = M.forward_return(M.simple_returns(prices(spark, d)), 3)
    return p.select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("ret", "log_ret", "forward_ret")])


_TEMPORAL = """tmp AS (SELECT event_id, count(*) AS n_posts, count(*) FILTER (sentiment > 0.1) AS n_positive, count(*) FILTER (sentiment < -0.1) AS n_negative, count(*) FILTER (sentiment > 0.5) AS n_strong_positive, count(*) FILTER (sentiment < -0.5) AS n_strong_negative,
      sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS n_words, avg(sentiment) AS mean, stddev_samp(sentiment) AS std, max(sentiment) AS max, min(sentiment) AS min, count(DISTINCT day) AS n_days, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(sentiment, nth) END AS trend FROM bef GROUP BY event_id)"""
# Documents with returns by date, scores of words as of each event date, and the texts before each ticker's event dates.
_POINT = f"""{_DR}, drd AS (SELECT f.date, dr.* FROM dr JOIN filings f USING (filing_id)), dts AS (SELECT DISTINCT event_date AS d FROM evts),
    tot AS (SELECT d, avg(r) AS m, stddev_pop(r) AS s FROM dts JOIN drd ON date < d GROUP BY d), dwd AS (SELECT date, r, unnest(list_distinct(w)) AS word FROM drd),
    pws AS (SELECT d, word, (avg(r) - any_value(m)) / any_value(s) AS corr FROM dts JOIN dwd ON date < d JOIN tot USING (d) GROUP BY d, word HAVING count(*) >= 10),
    per AS (SELECT ticker, CAST(ts AS DATE) AS day, post_id % (SELECT max(doc_id) + 1 FROM documents) AS filing_id, count(*) AS k, count(*) FILTER (sentiment > 0.1) AS up, count(*) FILTER (sentiment < -0.1) AS down FROM posts GROUP BY ALL),
    nr AS (SELECT w.ticker, d, p.* EXCLUDE (ticker) FROM (SELECT DISTINCT ticker, event_date AS d FROM evts) w JOIN per p ON p.ticker = w.ticker AND day >= d - 7 AND day < d),
    dwn AS (SELECT filing_id, word, count(*) AS n FROM (SELECT filing_id, unnest(w) AS word FROM dr) GROUP BY ALL),
    wsc AS (SELECT ticker, d, sum(corr * k * n) AS s, sum(k * n) FILTER (corr > 0.1) AS n_best_words, sum(k * n) FILTER (corr < -0.1) AS n_worst_words, sum(up) FILTER (corr > 0.1) AS best_positive, sum(up) FILTER (corr < -0.1) AS worst_positive,
      sum(down) FILTER (corr > 0.1) AS best_negative, sum(down) FILTER (corr < -0.1) AS worst_negative FROM nr JOIN dwn USING (filing_id) JOIN pws USING (d, word) GROUP BY ALL),
    wtt AS (SELECT ticker, d, sum(k * len(w)) AS total FROM nr JOIN dr USING (filing_id) GROUP BY ALL),
    trm AS (SELECT ticker, d, sum(k * words) AS words, max(a1) + max(a2) + max(a3) AS dict_positive, max(b1) + max(b2) + max(b3) AS dict_negative FROM nr JOIN (SELECT filing_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words,
      contains(t, 'tion')::INT AS a1, contains(t, 'and')::INT AS a2, contains(t, 'la')::INT AS a3, contains(t, 'ble')::INT AS b1, contains(t, 'the')::INT AS b2, contains(t, 'sch')::INT AS b3 FROM (SELECT *, lower(text) AS t FROM filings WHERE text IS NOT NULL)) USING (filing_id) GROUP BY ALL)"""
_WHOLE = ["n_posts", "n_positive", "n_negative", "n_strong_positive", "n_strong_negative", "n_words", "n_days", "n_best_words", "n_worst_words", "best_positive", "worst_positive", "best_negative", "worst_negative"]
_REAL = {"mean": 8, "std": 8, "max": 8, "min": 8, "trend": 6, "word_score": 8}


@query(f""", {_BEFORE.format('posts_text')}, {_TEMPORAL}, {_POINT} SELECT e.event_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in _WHOLE)}, {', '.join(f'round(coalesce({"s / total" if c == "word_score" else c}, 0), {n}) AS {c}' for c, n in _REAL.items())},
    round(coalesce(n_positive / greatest(n_negative, 1), 0), 8) AS ratio, round(coalesce(n_posts, 0) / 7, 8) AS daily_volume, round(coalesce(n_days, 0) / 7, 8) AS coverage, CAST(coalesce(dict_positive, 0) AS INTEGER) AS dict_positive, CAST(coalesce(dict_negative, 0) AS INTEGER) AS dict_negative,
    round(coalesce((dict_positive - dict_negative) / nullif(dict_positive + dict_negative, 0), 0), 8) AS dict_polarity, round(coalesce((dict_positive + dict_negative) / greatest(words, 1), 0), 8) AS dict_subjectivity, CAST(filing_type = '8-K' AS INTEGER) AS is_8k, CAST(filing_type = '10-K' AS INTEGER) AS is_10k
    FROM evts e LEFT JOIN tmp USING (event_id) LEFT JOIN wsc ON wsc.ticker = e.ticker AND wsc.d = event_date LEFT JOIN wtt ON wtt.ticker = e.ticker AND wtt.d = event_date LEFT JOIN trm ON trm.ticker = e.ticker AND trm.d = event_date""", "posts_text evts")
def feature_matrix(spark, d):
    """All features of each event, from what was known before its date."""
    e, docs = events(spark, d), filings(spark, d).withColumnRenamed("filing_id", "doc_id")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    p = posts(spark, d).withColumn("doc_id", F.col("post_id") % (last + 1))
    texts = docs.select("doc_id", X.word_tokens(F.col("text")).alias("w"))
    known = docs.select("date", X.word_tokens(F.col("text")).alias("w"), ((F.col("doc_id") * 37 % 201 - 100) / 1000).alias("r"))
    dates = [r[0] for r in e.select("event_date").distinct().collect()]  # a calendar
    path = scratch(spark, "word-scores")  # written first, so that the planner sees their size
    PIT.score_table(known, "w", "r", "date", dates, 10).write.parquet(path)
    scores = spark.read.parquet(path)
    temporal = FE.temporal_features(posts_text(spark, d, lambda t: t.select("doc_id", FE.word_count().alias("n_words"))), e)
    temporal = temporal.join(FE.sentiment_trend(posts(spark, d), e), "event_id", "left").fillna({"trend": 0.0})
    out = PIT.feature_matrix(e, temporal, PIT.word_features(p, texts, "w", e, scores), PIT.term_features(p, docs, POSITIVE, NEGATIVE, e), {"is_8k": "8-K", "is_10k": "10-K"}, "filing_type")
    places = _REAL | {c: 8 for c in ("ratio", "daily_volume", "coverage", "dict_polarity", "dict_subjectivity")}
    return out.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in out.columns])
