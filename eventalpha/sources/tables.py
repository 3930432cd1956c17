"""Reading and writing: filings, CSV and JSON tables, lexicons, factors, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = "date DATE, ticker STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume LONG, adj_close DOUBLE"
EVENTS = "ticker STRING, date DATE, filing_type STRING, category STRING, confidence DOUBLE, keywords_matched STRING, text_excerpt STRING"
POSTS_JSON = (
    "id LONG, ticker STRING, body STRING, created TIMESTAMP_NTZ, likes STRUCT<total: LONG>, entities STRUCT<sentiment: STRUCT<basic: STRING>>"
)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Text files under .../ticker/filing_type/accession/file: one row each, whole text."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    part = lambda i: F.regexp_replace(F.element_at(parts, i), "^[^=]*=", "")  # noqa: E731  a folder may be name=value
    return raw.select(part(-4).alias("ticker"), part(-3).alias("filing_type"), part(-2).alias("accession"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_posts_json(spark: SparkSession, path: str, schema: str = POSTS_JSON) -> DataFrame:
    return flatten_posts(spark.read.schema(schema).json(path))


def parse_posts(df: DataFrame, column: str, schema: str = POSTS_JSON) -> DataFrame:
    """From a column of JSON text; ``likes`` may be a number or an object with ``total``."""
    plain = F.get_json_object(column, "$.likes").try_cast("long")
    parsed = df.withColumn("_p", F.from_json(column, schema)).withColumn("_n", plain).select("_p.*", "_n")
    return flatten_posts(parsed).withColumn("likes", F.coalesce("likes", "_n", F.lit(0))).drop("_n")


def flatten_posts(df: DataFrame) -> DataFrame:
    return df.withColumn("likes", F.col("likes.total")).withColumn("label", F.col("entities.sentiment.basic")).drop("entities")


def lexicon_from_json(df: DataFrame, column: str) -> DataFrame:
    """{category: {polarity: [terms]}} -> (category, polarity, term)."""
    parsed = df.select(F.from_json(column, "map<string,map<string,array<string>>>").alias("m"))
    by_category = parsed.select(F.explode("m").alias("category", "p"))
    return by_category.select("category", F.explode("p").alias("polarity", "t")).select("category", "polarity", F.explode("t").alias("term"))


def lexicon_to_json(df: DataFrame) -> DataFrame:
    by_polarity = df.groupBy("category", "polarity").agg(F.sort_array(F.collect_list("term")).alias("t"))
    by_category = by_polarity.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("polarity", "t")))).alias("p"))
    return by_category.select("category", F.to_json("p").alias("json"))


def factor_table(factors: DataFrame, momentum: DataFrame, start: str, end: str) -> DataFrame:
    """Factors in percent joined with momentum on the date, as fractions, names cleaned, sliced."""
    def tidy(df: DataFrame) -> DataFrame:
        return df.select([F.col(f"`{c}`").alias(c.strip().lower().replace("-", "_")) for c in df.columns])

    j = tidy(factors).join(tidy(momentum), "date", "left")
    return j.select("date", *[(F.col(c) / 100).alias(c) for c in j.columns if c != "date"]).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """``name: value`` lines of log files -> (file, metric, value); the last of a name counts."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("nth"))
    return parse_log_lines(lines)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    pattern = r"^\s*([A-Za-z][A-Za-z0-9 _/]*?)\s*:\s*\$?(-?[0-9][0-9,]*\.?[0-9]*)\s*%?\s*$"
    name, value = (F.regexp_extract("value", pattern, i) for i in (1, 2))
    m = lines.withColumn("metric", F.lower(F.regexp_replace(name, r"\s+", "_"))).withColumn("number", F.regexp_replace(value, ",", "").try_cast("double")).filter("metric <> '' and number is not null")
    return m.groupBy("file", "metric").agg(F.max_by("number", "nth").alias("value"))


def save(df: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode).partitionBy(*(by or []))
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``). Where it is
    unset, in a temporary folder of this machine if Spark runs on this machine alone, else ValueError."""
    import tempfile
    import uuid

    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
