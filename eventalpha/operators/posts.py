"""Posts from many sources: conform, union, de-duplicate, cap, score, agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The standard columns of a post: name, type, value for missing or unreadable.
COLUMNS: list[tuple[str, str, object]] = [
    ("timestamp", "timestamp_ntz", None), ("text", "string", ""), ("user_followers", "long", 1), ("retweets", "long", 0), ("likes", "long", 0),
    ("ticker", "string", ""), ("sentiment", "double", None), ("esg_relevance", "double", 0.0), ("esg_category", "string", "general"), ("quality_score", "double", 0.5),
]
REPUTABLE = ("reuters.com", "bloomberg.com", "wsj.com", "ft.com", "cnbc.com", "bbc.com", "nytimes.com", "washingtonpost.com", "theguardian.com", "apnews.com", "marketwatch.com")


def conform(df: DataFrame) -> DataFrame:
    """The standard columns in order: missing ones added, unreadable values replaced, others dropped."""
    def column(name: str, kind: str, default) -> Column:
        if name not in df.columns:
            return F.lit(default).cast(kind).alias(name)
        value = F.col(name).try_cast(kind)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name)

    return df.select([column(*c) for c in COLUMNS])


def union(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows, with the name of their source."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_of(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. ``order`` should tell all rows apart. The minimum by a struct
    combines on the map side, so a boilerplate key does not sort in one task."""
    rest = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keys = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    return df.groupBy(*keys).agg(F.min_by(rest, rank).alias("_row")).select("_row.*")


def dedup_text(df: DataFrame, order: list[Column], text: str = "text", prefix: int = 100) -> DataFrame:
    return first_of(df, [F.trim(F.lower(F.left(F.col(text), F.lit(prefix))))], order)


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def quorum(df: DataFrame, group: list[str], least: int) -> DataFrame:
    return df.groupBy(*group).agg(F.countDistinct("source").alias("n_sources")).filter(F.col("n_sources") >= least)


def source_agreement(df: DataFrame, group: list[str], dead: float = 0.01) -> DataFrame:
    """Share of the sources whose mean sentiment points the majority's way; 0 for one source. Sentiments
    are summed in whole millionths, so a mean on the edge falls the same way in whatever order rows come."""
    unit = 1_000_000
    means = df.groupBy(*group, "source").agg(F.sum(F.round(F.col("sentiment") * unit).cast("long")).alias("s"), F.count("sentiment").alias("c"))
    edge = F.col("c") * round(dead * unit)
    up, down = F.count_if(F.col("s") > edge), F.count_if(F.col("s") < -edge)
    n = F.count(F.lit(1))
    most = F.greatest(up, down, n - up - down)
    return means.groupBy(*group).agg(n.alias("n_sources"), F.when(n < 2, F.lit(0.0)).otherwise(F.round(most / n, 3)).alias("source_agreement"))


def score_news(df: DataFrame, least: int = 20, length: Column | None = None) -> DataFrame:
    """English news of a minimal length, with sentiment (given, else from tone) and quality. ``length`` is that of the
    trimmed text where it is known, so that the text need not be there."""
    from eventalpha.functions.lexicon import blend

    tone = F.greatest(F.least(F.col("tone") / 10, F.lit(1.0)), F.lit(-1.0))
    known = F.array(*[F.lit(x) for x in REPUTABLE])
    reputation = F.when(F.exists(known, lambda x: F.contains(F.coalesce("domain", F.lit("")), x)), F.lit(0.9)).otherwise(F.lit(0.5))
    return (
        df.filter(F.lower(F.coalesce("language", F.lit(""))).isin("", "english")).filter((F.length(F.trim("text")) if length is None else length) >= least)
        .withColumn("sentiment", F.coalesce("sentiment", tone, F.lit(0.0)))
        .withColumn("quality", blend([(0.4, F.col("relevance")), (0.3, reputation), (0.3, F.abs("sentiment"))]))
    )


def score_messages(df: DataFrame, least: int = 10, length: Column | None = None) -> DataFrame:
    """Messages with a user's own label in JSON, as sentiment where no score is given; ``length`` as in ``score_news``."""
    from eventalpha.functions.lexicon import blend

    basic = F.get_json_object("entities", "$.sentiment.basic")
    label = F.when(basic == "Bullish", F.lit(0.5)).when(basic == "Bearish", F.lit(-0.5)).otherwise(F.lit(0.0))
    return (
        df.filter((F.length(F.trim("text")) if length is None else length) >= least)
        .withColumn("sentiment", F.coalesce("sentiment", label))
        .withColumn("quality", blend([(0.3, F.col("relevance")), (0.3, F.least(F.col("likes") / 20, F.lit(1.0))), (0.4, F.abs("sentiment"))]))
    )
