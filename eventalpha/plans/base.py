"""Registry of queries and the carrier tables that they run on.

The driver tables are not financial, so carriers derive posts, filings, prices, signals and runs from
them by integer arithmetic, once as DataFrames and once as SQL. Every carrier has all rows of its table
and whole texts: a post for each row of ``events``, a filing and an event for each document. Several
posts share a document as their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: str = ""):
    """Register a query under its function's name; ``needs`` names the carriers that ``sql`` uses."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = carriers_sql(needs.split()) + sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that is bound by processors: a table of fewer files than cores is dealt out to all cores.
    A large table has more files, and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def ticker(n: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(n.cast("string"), 2, "0"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    e, i = spread(table(spark, d, "events")), F.col("event_id")
    return e.select(
        i.alias("post_id"), ticker(F.col("user_id") % 25).alias("ticker"), "ts",
        ((i * 37 % 201 - 100) / 100).alias("sentiment"), F.floor("value").cast("long").alias("likes"),
        F.get_json_object("props", "$.k").cast("long").alias("retweets"), (i * 7919 % 5000).alias("followers"),
        (i * 13 % 100 / 100).alias("quality"), F.col("event_type").alias("source"),
    )


def posts_text(spark: SparkSession, d: str, derive: Callable[[DataFrame], DataFrame] | None = None, tickers: bool = False) -> DataFrame:
    """Posts with their whole texts. ``derive`` computes columns from ``text`` alone: once for a text
    that many posts share, before the join; it may drop the text, so that the join does not move it. With
    ``tickers`` it also has those of the text's posts, each once."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    p = posts(spark, d).withColumn("doc_id", F.col("post_id") % (last + 1))
    if tickers:
        docs = docs.join(p.select("doc_id", "ticker").distinct().groupBy("doc_id").agg(F.collect_list("ticker").alias("tickers")), "doc_id", "left")
    docs = derive(docs) if derive else docs
    return p.join(docs, "doc_id", "left").drop("doc_id")


def filings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(i % 10 < 7, "8-K").when(i % 10 == 7, "10-K").otherwise("10-Q")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(
        i.alias("filing_id"), ticker(i % 25).alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("date"),
        kind.alias("filing_type"), "text",
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """One event for every filing."""
    return filings(spark, d).select(F.col("filing_id").alias("event_id"), "ticker", F.col("date").alias("event_date"), "filing_type")


def grade(sentiment: Column) -> Column:
    """A severity for each post, so that about one in twenty is a scandal of some kind."""
    return F.when(sentiment <= -0.99, "CRITICAL").when(sentiment <= -0.97, "HIGH").when(sentiment <= -0.94, "MEDIUM").otherwise("LOW")


def prices(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(
        ticker(F.col("l_suppkey") % 10).alias("ticker"), F.date_add(F.to_date("l_shipdate"), 10591).alias("date")
    ).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / (F.sum(F.col("l_quantity").cast("long")) * 100)).alias("close"),
        F.sum(F.col("l_quantity").cast("long")).alias("volume"),
    )


def returns(spark: SparkSession, d: str) -> DataFrame:
    from eventalpha.operators.market import simple_returns

    return simple_returns(prices(spark, d)).filter("ret is not null").select(F.col("ticker").alias("run_id"), "date", (F.col("ret") / 20).alias("ret"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("event_id"), ticker(F.col("o_custkey") % 25).alias("ticker"), F.date_add(F.to_date("o_orderdate"), 10591).alias("date"),
        ((k * 29 % 201 - 100) / 100).alias("intensity"), ((k % 10 + 1) / 10).alias("event_confidence"), (k * 17 % 500 / 100).alias("volume_ratio"),
        (k * 3 % 8).alias("duration_days"), ((k * 53 % 201 - 100) / 100).alias("pre_event_sentiment"), (k * 7 % 40).alias("n_posts"),
        (k % 4 + 1).alias("n_sources"), (k * 11 % 101 / 100).alias("source_agreement"), F.left("o_orderpriority", F.lit(1)).alias("category"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Signals with an exact raw score (a two-decimal number), so that ranks agree across engines."""
    return signals(spark, d).select("event_id", "ticker", "date", "event_confidence", "category", "n_posts", F.col("intensity").alias("raw_score"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    """Target weights by date: the scored signals of each month's first days, one row for a ticker."""
    s = scored(spark, d).withColumn("date", F.to_date(F.date_trunc("month", "date")))
    return s.groupBy("date", "ticker").agg((F.sum(F.round(F.col("raw_score") * 100).cast("long")) / 10000).alias("weight"))


def factors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").groupBy(F.date_add(F.to_date("o_orderdate"), 10591).alias("date")).agg(
        ((F.sum(k * 31 % 201) % 201 - 100) / 10000).alias("mkt"), ((F.sum(k * 43 % 201) % 201 - 100) / 10000).alias("smb"),
        ((F.sum(k * 59 % 201) % 201 - 100) / 10000).alias("hml"), ((F.sum(k * 71 % 201) % 201 - 100) / 10000).alias("mom"),
    ).withColumn("rf", F.lit(0.0001))


def universe(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        ticker(F.col("s_suppkey") % 25).alias("ticker"), F.col("s_suppkey").alias("member_id"), F.col("r_name").alias("sector"),
        F.col("n_name").alias("category"), F.col("s_acctbal").alias("cap"),
    )


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """ticker -> sector, for tickers T00 to T19 (the rest have none)."""
    return spark.range(20).select(ticker(F.col("id")).alias("ticker"), F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("sector"))


_T = "concat('T', lpad(CAST({} AS VARCHAR), 2, '0'))"

CARRIERS = {
    "posts": (f"""SELECT event_id AS post_id, {_T.format('user_id % 25')} AS ticker, ts, (event_id * 37 % 201 - 100) / 100 AS sentiment,
        CAST(floor(value) AS BIGINT) AS likes, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS retweets,
        event_id * 7919 % 5000 AS followers, event_id * 13 % 100 / 100 AS quality, event_type AS source FROM events""", ""),
    "posts_text": ("""SELECT p.*, d.text FROM posts p LEFT JOIN documents d
        ON p.post_id % (SELECT max(doc_id) + 1 FROM documents) = d.doc_id""", "posts"),
    "graded": ("""SELECT *, CASE WHEN sentiment <= CAST(-0.99 AS DOUBLE) THEN 'CRITICAL' WHEN sentiment <= CAST(-0.97 AS DOUBLE) THEN 'HIGH' WHEN sentiment <= CAST(-0.94 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM posts""", "posts"),
    "filings": (f"""SELECT doc_id AS filing_id, {_T.format('doc_id % 25')} AS ticker, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date,
        CASE WHEN doc_id % 10 < 7 THEN '8-K' WHEN doc_id % 10 = 7 THEN '10-K' ELSE '10-Q' END AS filing_type, text FROM documents""", ""),
    "evts": ("SELECT filing_id AS event_id, ticker, date AS event_date, filing_type FROM filings", "filings"),
    "prices": (f"""SELECT {_T.format('l_suppkey % 10')} AS ticker, CAST(l_shipdate AS DATE) + 10591 AS date,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (sum(CAST(l_quantity AS BIGINT)) * 100) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2""", ""),
    "rets": ("""SELECT ticker AS run_id, date, ret / 20 AS ret FROM (SELECT ticker, date,
        close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices) WHERE ret IS NOT NULL""", "prices"),
    "sigs": (f"""SELECT o_orderkey AS event_id, {_T.format('o_custkey % 25')} AS ticker, CAST(o_orderdate AS DATE) + 10591 AS date,
        (o_orderkey * 29 % 201 - 100) / 100 AS intensity, (o_orderkey % 10 + 1) / 10 AS event_confidence, o_orderkey * 17 % 500 / 100 AS volume_ratio,
        o_orderkey * 3 % 8 AS duration_days, (o_orderkey * 53 % 201 - 100) / 100 AS pre_event_sentiment, o_orderkey * 7 % 40 AS n_posts,
        o_orderkey % 4 + 1 AS n_sources, o_orderkey * 11 % 101 / 100 AS source_agreement, left(o_orderpriority, 1) AS category FROM orders""", ""),
    "scored": ("SELECT event_id, ticker, date, event_confidence, category, n_posts, intensity AS raw_score FROM sigs", "sigs"),
    "weights": ("""SELECT CAST(date_trunc('month', date) AS DATE) AS date, ticker, CAST(sum(CAST(round(raw_score * 100) AS BIGINT)) AS BIGINT) / 10000 AS weight
        FROM scored GROUP BY 1, 2""", "scored"),
    "factors": ("""SELECT CAST(o_orderdate AS DATE) + 10591 AS date, (sum(o_orderkey * 31 % 201) % 201 - 100) / 10000 AS mkt,
        (sum(o_orderkey * 43 % 201) % 201 - 100) / 10000 AS smb, (sum(o_orderkey * 59 % 201) % 201 - 100) / 10000 AS hml,
        (sum(o_orderkey * 71 % 201) % 201 - 100) / 10000 AS mom, CAST(0.0001 AS DOUBLE) AS rf FROM orders GROUP BY 1""", ""),
    "universe": (f"""SELECT {_T.format('s_suppkey % 25')} AS ticker, s_suppkey AS member_id, r_name AS sector, n_name AS category, s_acctbal AS cap
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", ""),
    "sectors": (f"SELECT {_T.format('i')} AS ticker, concat('S', CAST(i % 4 AS VARCHAR)) AS sector FROM range(20) t(i)", ""),
}


def carriers_sql(names: list[str]) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in CARRIERS[name][1].split():
                add(x)
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CARRIERS[n][0]})" for n in order) + " " if order else ""
