"""Boilerplate lines by their frequency within a site.

For each host, the pages that hold a line are divided by the host's page total; lines above ``ratio`` are
dropped from that host's pages. A line on fewer than ``least_pages`` (two) pages of its host is never
dropped, as it repeats nothing there; beyond that a host's size does not matter: on a host of 2 pages a line
that both have goes, on one of 20 a line of 2, on one of 1,000 a line of 51. A page counts once for a
line, however often it repeats it. Blank lines are neither counted nor dropped. Lines are told apart by a
128-bit hash.

Why the result is small: a page with k distinct lines adds k to its host's line counts, so a host
has at most (mean lines a page) / ratio lines above the ratio, whatever its size. A page's lines
meet them in one hashed intersection, so looking up costs lines of the page + lines of the list.

Defined cases: a null host is a host of its own; a null text stays null and counts as a page
without lines; a page all of whose lines go keeps an empty text; repeated rows are pages of their
own; an empty table gives an empty result; further columns pass through, columns named like the two
counts are replaced (name the counts otherwise to keep them), and names that begin with ``_ld_`` are
reserved. Very long texts are read whole: a row holds its lines as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

RATIO, LEAST_PAGES = 0.05, 2


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def frequent_lines(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_ld_host, _ld_hash: the hashes of the host's boilerplate lines."""
    pages = df.select(F.col(host).alias("_ld_host"), F.col(text).alias("_ld_text"))
    totals = pages.groupBy("_ld_host").agg(F.count(F.lit(1)).alias("_ld_pages"))
    lines = pages.select("_ld_host", F.explode(F.array_distinct(F.split("_ld_text", "\n"))).alias("_ld_line"))
    counts = (
        lines.filter(F.trim("_ld_line") != "")
        .select("_ld_host", _hash(F.col("_ld_line")).alias("_ld_hash"))
        .groupBy("_ld_host", "_ld_hash")
        .agg(F.count(F.lit(1)).alias("_ld_on"))
    )
    return (
        counts.alias("c")
        .join(totals.alias("t"), F.col("c._ld_host").eqNullSafe(F.col("t._ld_host")))
        .filter((F.col("_ld_on") >= least_pages) & (F.col("_ld_on") > F.lit(ratio) * F.col("_ld_pages")))
        .select("c._ld_host", "_ld_hash")
    )


def drop_frequent_lines(
    df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """``df`` with ``text`` rewritten, plus the columns ``n_lines`` and ``n_dropped`` (long; 0 for a null text)."""
    # Within one host's short list 64 bits tell lines apart.
    heavy = frequent_lines(df, host, text, ratio, least_pages).groupBy("_ld_host").agg(F.collect_list("_ld_hash.a").alias("_ld_lines"))
    heavy = cut(heavy, "frequent-lines")
    # No hint: the written table's size decides whether it is broadcast; beyond the session's
    # threshold Spark sorts and merges and splits a hot host.
    joined = df.join(heavy, F.col(host).eqNullSafe(F.col("_ld_host")), "left")
    lines = F.split(text, "\n")
    joined = joined.withColumn("_ld_here", F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), "_ld_lines"))
    kept = F.when(F.size("_ld_here") > 0, F.filter(lines, lambda x: ~F.array_contains("_ld_here", F.xxhash64(x)))).otherwise(lines)
    joined = joined.withColumn("_ld_kept", kept).withColumn("_ld_n", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    dropped = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("_ld_n") - F.size("_ld_kept")).cast("long")
    return (
        joined.withColumn(n_lines, F.col("_ld_n")).withColumn(n_dropped, dropped).withColumn(text, F.array_join("_ld_kept", "\n"))
        .drop("_ld_host", "_ld_lines", "_ld_here", "_ld_kept", "_ld_n")
    )


def op10_site_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_frequent_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP10_SQL = """
WITH lines AS (
  SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
heavy AS (
  SELECT l.source, l.line FROM (
    SELECT source, line, count(*) AS on_pages FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line) l
  JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE l.on_pages >= 2 AND l.on_pages > CAST(0.05 AS DOUBLE) * p.pages),
by_host AS (SELECT source, list(line) AS lines FROM heavy GROUP BY source),
cut AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS a,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(h.lines, []), x)) AS b
  FROM documents d LEFT JOIN by_host h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(a) - len(b), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(b, chr(10)), '')) AS kept_sha256
FROM cut
"""
