"""Host-level quality rules.

Every document gets counts (words, symbols, repeated lines, words in repeated 5-word windows) and
from them two hard rules and three soft ones. Soft failures are added up by host; the raw failure
rates of the hosts give an empirical Beta prior by the method of moments, and each host's rate is
shrunk towards it, so that a host with few pages is judged like the average host and one with many
by its own pages. The verdict joins back: on a host whose shrunk rate is over ``times`` the prior's
mean one soft failure is enough to drop a document, elsewhere it takes two. So what counts as a bad
host follows from the table, and where hosts differ only by chance none is bad.

Defined cases: a null text counts as an empty one; a null host is a host of its own; repeated rows
count as often as they occur; an empty table gives an empty result. A line that repeats counts each
time after its first. Windows are compared by a 64-bit hash within one document. Columns not carried
are not read, so their names may be those of the counts; a carried column must not have such a name
(ValueError). Very long texts are read whole: a row holds its words and, if a window repeats, their
hashes with places as arrays, some 10 times its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, table, text_of, words_of

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_repeated_words(df: DataFrame, words: str, out: str, width: int = WINDOW) -> DataFrame:
    """``df`` plus ``out``: how many words lie in windows of ``width`` words that occur more than
    once in the array column ``words``. Only rows with a repeated window take the sorting path."""
    w, n = F.col(words), F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (width - 1)),
        lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]),
    )

    def again(x: Column, i: Column) -> Column:
        pairs = F.col("_qr_pairs")
        before, after = F.get(pairs, i - 1)["h"], F.get(pairs, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    covered = F.aggregate(
        F.sort_array(F.transform(F.filter("_qr_pairs", again), lambda x: x["i"])),
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct(
            (i + width).alias("end"),
            (a["n"] + F.when(i >= a["end"], F.lit(width)).otherwise(i + width - a["end"])).alias("n"),
        ),
        lambda a: a["n"],
    )
    return (
        df.withColumn("_qr_hashes", F.when(n > width, hashes))
        .withColumn("_qr_pairs", F.when(
            F.size(F.array_distinct("_qr_hashes")) < F.size("_qr_hashes"),
            F.sort_array(F.transform("_qr_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ))
        .withColumn(out, F.coalesce(F.when(F.col("_qr_pairs").isNotNull(), covered), F.lit(0)).cast("long"))
        .drop("_qr_hashes", "_qr_pairs")
    )


def document_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = text_of(text)
    words = F.col("_qr_words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = (
        df.withColumn("_qr_words", words_of(t))
        .withColumn("_qr_lines", lines)
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", (F.size(F.split(t, "[#*$%&|<>]", -1)) - 1).cast("long"))
        .withColumn("n_lines", F.size("_qr_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long"))
    )
    return with_repeated_words(counted, "_qr_words", "n_repeat_words").drop("_qr_words", "_qr_lines")


def soft_failures() -> Column:
    """Number of soft rules that fail: symbols, repeated lines, mean word length."""
    rules = [
        F.col("n_symbols") * 10 > F.col("n_words"),
        F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        (F.col("word_chars") < F.col("n_words") * 3) | (F.col("word_chars") > F.col("n_words") * 10),
    ]
    return sum((r.cast("int") for r in rules), F.lit(0))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) from the hosts' raw rates by the method of moments. What rates would vary by chance alone,
    m (1 - m) / documents, is taken off their variance; where nothing is left, hosts are alike and the
    prior is as firm as it gets (1e6 documents)."""
    rate = F.col("n_failed") / F.col("n_docs")
    m, v, chance = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs"))).first()
    if m is None:
        return 0.5, 0.5
    v -= m * (1 - m) * chance
    size = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    return m * size, (1 - m) * size


TIMES = 2.0


def host_verdicts(counted: DataFrame, host: str = "source", times: float = TIMES) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_failed. ``counted`` has base_failed and n_soft."""
    failed = F.col("base_failed") | (F.col("n_soft") > 0)
    hosts = cut(
        counted.groupBy(F.col(host).alias("_qr_host")).agg(
            F.count(F.lit(1)).alias("n_docs"), F.count_if(failed).alias("n_failed")
        ),
        "host-failures",
    )
    a, b = beta_prior(hosts)
    rate = (F.col("n_failed") + a) / (F.col("n_docs") + a + b)
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > times * a / (a + b))


def apply_rules(df: DataFrame, host: str = "source", text: str = "text", times: float = TIMES, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``df``: the columns ``carry`` and host, the counts, base_failed,
    n_soft, host_rate, kept."""
    carry = [c for c in (carry or []) if c != host]
    if taken := {*carry, host} & {*COUNTS, "base_failed", "n_soft", "host_rate", "kept"}:
        raise ValueError(f"columns named like results: {sorted(taken)}")
    counted = document_counts(df.select(*carry, host, text), text).drop(text)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    counted = cut(counted.withColumn("base_failed", base).withColumn("n_soft", soft_failures()), "document-counts")
    verdicts = host_verdicts(counted, host, times).select("_qr_host", "rate", "host_failed")
    need = F.when(F.col("host_failed"), F.lit(1)).otherwise(F.lit(2))
    return (
        counted.join(verdicts, F.col(host).eqNullSafe(F.col("_qr_host")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_soft") < need))
        .withColumnRenamed("rate", "host_rate")
        .drop("_qr_host", "host_failed")
    )


def op4_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return apply_rules(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN rep r ON b.doc_id = r.doc_id),
ruled AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         CAST(n_symbols * 10 > n_words AS INT) + CAST(n_dup_lines * 10 > n_lines * 3 AS INT)
         + CAST(word_chars < n_words * 3 OR word_chars > n_words * 10 AS INT) AS n_soft
  FROM counted),
hosts AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (base_failed OR n_soft > 0) AS n_failed FROM ruled GROUP BY source),
moments AS (SELECT m, v - m * (1 - m) * chance AS v FROM (
  SELECT avg(n_failed / n_docs) AS m, var_pop(n_failed / n_docs) AS v, avg(1 / n_docs) AS chance FROM hosts)),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS s FROM moments),
verdict AS (
  SELECT source, (n_failed + m * s) / (n_docs + s) > 2 * m AS host_failed FROM hosts, prior)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_soft < CASE WHEN host_failed THEN 1 ELSE 2 END) AS kept
FROM ruled r JOIN verdict v ON r.source IS NOT DISTINCT FROM v.source
"""
