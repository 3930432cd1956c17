"""Secret scan: fixed patterns plus a battery of randomness tests.

Base spans come from three patterns (assign, access, hex). The battery looks at what they leave: at
every run of 20 or more characters of ``[A-Za-z0-9+/_-]`` between them. A run that mixes ``+ /`` with
``- _`` is in no encoding as a whole and is cut into its stretches of 20 or more in one of the two. A
run or stretch that holds a letter and a digit gets its encoding (hex, HEX, base32, base62, base64,
base64url: the first whose alphabet covers it), its characters become alphabet indices, and there are
three z-scores under "uniform and independent":

* chi-squared of the symbol counts, standardised by its exact mean and variance for short runs;
* Wald-Wolfowitz runs above and below the alphabet's middle;
* lag-1 serial correlation.

Their squared sum has a chi-squared law with 3 degrees of freedom; its tail is the run's p-value.
A run is cleared as structured text if the Benjamini-Hochberg procedure at level ``alpha`` rejects
randomness among the runs of like encoding and length (a stratum is an encoding and a power of two
of the length, so that plentiful short runs do not set the cutoff for long ones); what survives is
reported as ``random``. p-values are binned, rounded up, so that the procedure needs one count for
each stratum and bin (at most 6 x 31 x 401 numbers), not a sort of the corpus.

All of it is column expressions. Offsets are code points, ends exclusive. Defined cases: a null
text is empty; repeated rows give repeated results; an empty table gives an empty result; spans of one
kind never overlap, and a random span never overlaps a base span; columns named ``spans`` or
``base_spans`` are replaced, the text is left out, other columns pass through, and names that begin
with ``_ss_`` are reserved. Very long texts are read whole: a row holds its text, the text between
matches, and the spans; the work grows with the text and its spans, also in a text of very many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table, text_of

# Fixed patterns. A run that is too short never matches in the second and third, which gives the
# same spans as matching first and dropping short ones afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
STRETCH = r"[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_-]{20,}={0,2}"
MIXED = r"[+/].*[_-]|[_-].*[+/]"

KINDS = ("assign", "access", "hex", "random")

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base62": ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    "base64": ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
}
BINS_PER_DECADE, MAX_BIN = 20, 400
ALPHA = 0.05  # the share of random runs among those cleared as structured

BLOCK, PIECE, LEAST = 64, 4096, 20  # places of a block, code points of a piece, and of the shortest run

_SPAN = "array<struct<start:int,end:int,token:string>>"


def _bound(value: Column, f) -> Column:
    """f of a variable that holds the value, so that it is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def prefixes(values: Column, op) -> Column:
    """Of an array<bigint>: for each place ``op`` (a sum, a maximum) of 0 and all values before it. By blocks, first
    within them and then over them, as an array that grows by one value is copied each time."""
    zero = F.lit(0).cast("long")

    def along(xs: Column, start: Column) -> Column:
        return F.aggregate(
            xs, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def scanned(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        starts = along(F.transform(blocks, lambda b: F.aggregate(part(b), zero, op)), zero)
        return _bound(starts, lambda s: F.flatten(F.transform(blocks, lambda b: along(part(b), F.get(s, b)))))

    return F.when(F.size(values) > 0, _bound(values, scanned)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, offset: Column | int = 0) -> Column:
    """The matches of ``pattern`` as array<struct<start,end,token>>, counted from ``offset``."""
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("got"), F.split(text, pattern, -1).alias("gaps"))
    first = F.lit(offset) if isinstance(offset, int) else offset

    def walked(x: Column) -> Column:
        got, gaps = x["got"], x["gaps"]
        places = F.sequence(F.lit(0), F.size(got) - 1)
        lengths = F.transform(places, lambda i: (F.length(F.get(gaps, i)) + F.length(F.get(got, i))).cast("long"))

        def placed(before: Column) -> Column:
            start = lambda i: (first + F.get(before, i) + F.length(F.get(gaps, i))).cast("int")
            return F.transform(places, lambda i: F.struct(start(i).alias("start"), (start(i) + F.length(F.get(got, i))).alias("end"), F.get(got, i).alias("token")))

        return _bound(prefixes(lengths, lambda a, x: a + x), placed)

    return F.when(text.rlike(pattern), _bound(pair, walked)).otherwise(F.array().cast(_SPAN))


def between(text: Column, spans: Column, least: int) -> Column:
    """What the spans, sorted by start, leave of the text in stretches of ``least`` or more:
    array<struct<start,text>>. Stretches are put together from pieces of the text, as finding a place in a
    string means to walk to it."""
    size = F.length(text)

    def cut_out(x: Column) -> Column:
        pieces, ends = x["pieces"], x["ends"]
        n = F.size(spans)
        start = lambda i: F.get(ends, i)
        stop = lambda i: F.when(i < n, F.get(spans, i)["start"]).otherwise(size)
        free = F.filter(F.sequence(F.lit(0), n), lambda i: stop(i) - start(i) >= least)
        in_piece = lambda i, k, a, b: F.substring(
            F.get(pieces, k), F.greatest(a - k * PIECE, F.lit(0)).cast("int") + 1, (F.least(b, (k + 1) * PIECE) - F.greatest(a, k * PIECE)).cast("int"))
        whole = lambda i, a, b: F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), lambda k: in_piece(i, k, a, b)), "")
        return F.transform(free, lambda i: F.struct(start(i).cast("int").alias("start"), whole(i, start(i), stop(i)).alias("text")))

    latest = prefixes(F.concat(F.transform(spans, lambda s: s["end"].cast("long")), F.array(F.lit(0).cast("long"))), lambda a, x: F.greatest(a, x))
    return _bound(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), latest.alias("ends")), cut_out)


def in_one_encoding(runs: Column) -> Column:
    """The runs, those that mix the encodings' signs in stretches that do not."""
    return F.flatten(F.transform(runs, lambda c: F.when(c["token"].rlike(MIXED), matches(c["token"], STRETCH, c["start"])).otherwise(F.array(c))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(v: Column, n: Column, f) -> Column:
    """f(earlier, later) of neighbours."""
    return F.zip_with(F.slice(v, F.lit(1), n - 1), F.slice(v, F.lit(2), n - 1), f)


def tail_of_three(t: Column) -> Column:
    """P(chi-squared with 3 degrees of freedom > t); erfc by Abramowitz and Stegun 7.1.26."""
    x = F.sqrt(t / 2)
    k = 1 / (1 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    e = F.exp(-t / 2)
    return F.least(F.lit(1.0), poly * e + F.sqrt(2 * t / 3.141592653589793) * e)


def with_battery(df: DataFrame, runs: str, out: str) -> DataFrame:
    """``df`` plus ``out``: array<struct<start,end,stratum,bin>> of the tested runs in ``runs``."""

    def encoded(c):
        core = F.regexp_replace(c["token"], "=+$", "")
        mixed = core.rlike("[0-9]") & core.rlike("[A-Za-z]")
        name = F.coalesce(*[F.when(mixed & core.rlike(p), F.lit(k)) for k, (p, _) in ENCODINGS.items()])
        alphabet = F.coalesce(*[F.when(core.rlike(p), F.lit(a)) for p, a in ENCODINGS.values()])
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), core.alias("core"), name.alias("name"), alphabet.alias("alphabet"))

    def valued(c):
        chars = F.split(c["core"], "")
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0),
            lambda a, ch: a + F.pow(F.length(c["core"]) - F.length(F.replace(c["core"], ch, F.lit(""))), F.lit(2.0)),
        )
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["name"].alias("name"),
            F.length(c["alphabet"]).cast("double").alias("k"), F.length(c["core"]).alias("n"),
            F.transform(chars, lambda ch: (F.instr(c["alphabet"], ch) - 1).cast("double")).alias("v"),
            squares.alias("squares"),
        )

    def summed(c):
        high = _total(F.transform(c["v"], lambda x: (x >= c["k"] / 2).cast("double")))
        changes = _total(_pairs(c["v"], c["n"], lambda a, b: ((a >= c["k"] / 2) != (b >= c["k"] / 2)).cast("double")))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["name"].alias("name"), c["k"].alias("k"),
            c["n"].cast("double").alias("n"), c["n"].alias("n_int"), c["v"].alias("v"), c["squares"].alias("squares"),
            high.alias("high"), (changes + 1).alias("runs"), (_total(c["v"]) / c["n"]).alias("mean"),
        )

    def scored(c):
        n, k = c["n"], c["k"]
        chi = (c["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        expected = 2 * c["high"] * (n - c["high"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, (c["runs"] - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))
        over = _total(F.transform(c["v"], lambda x: (x - c["mean"]) * (x - c["mean"])))
        along = _total(_pairs(c["v"], c["n_int"], lambda a, b: (a - c["mean"]) * (b - c["mean"])))
        serial = F.when(over > 0, (along / over + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        t = F.least(F.lit(200.0), chi * chi + runs * runs + serial * serial)
        stratum = F.concat_ws(":", c["name"], F.floor(F.log2(n)).cast("string"))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum.alias("stratum"), tail_of_three(t).alias("p"))

    def binned(c):
        b = F.floor(-F.log10(F.greatest(c["p"], F.lit(1e-20))) * BINS_PER_DECADE)
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["stratum"].alias("stratum"), c["p"].alias("p"),
            F.least(F.greatest(b, F.lit(0)), F.lit(MAX_BIN)).cast("int").alias("bin"),
        )

    x = "_ss_runs"
    return (
        df.withColumn(x, F.transform(runs, encoded))
        .withColumn(x, F.filter(x, lambda c: c["name"].isNotNull()))
        .withColumn(x, F.transform(x, valued))
        .withColumn(x, F.transform(x, summed))
        .withColumn(x, F.transform(x, scored))
        .withColumn(out, F.transform(x, binned))
        .drop(x)
    )


def cleared_bins(tested: DataFrame, column: str, alpha: float) -> dict[str, int]:
    """stratum -> smallest bin that Benjamini-Hochberg rejects. A few hundred rows at most."""
    counts = tested.select(F.explode(column).alias("c")).groupBy("c.stratum", "c.bin").count()
    whole = Window.partitionBy("stratum")
    so_far = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    bound = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    rejected = (
        counts.withColumn("r", F.sum("count").over(so_far))
        .withColumn("m", F.sum("count").over(whole))
        .filter(bound * F.col("m") <= alpha * F.col("r"))
    )
    return {r[0]: r[1] for r in rejected.groupBy("stratum").agg(F.min("bin")).collect()}


def scan(df: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """The columns of ``df`` but ``text``, plus ``spans``: array<struct<start,rank,end>> in order of
    start and kind (rank: the place in KINDS)."""
    t = F.col("_ss_text")
    found = df.withColumn("_ss_text", text_of(text)).drop(text)

    def ranked(spans: Column | str, rank: int) -> Column:
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end")))

    long_enough = F.filter(matches(t, ASSIGN), lambda c: F.length(F.regexp_extract(c["token"], ASSIGN, 2)) >= 8)
    base = F.concat(*[ranked(spans, r) for r, spans in enumerate((long_enough, matches(t, ACCESS), matches(t, HEX)))])
    found = found.withColumn("_ss_base", F.sort_array(base))
    left = F.flatten(F.transform(between(t, F.col("_ss_base"), LEAST), lambda g: matches(g["text"], RUN, g["start"])))
    runs = F.when(F.size("_ss_base") > 0, left).otherwise(matches(t, RUN))
    found = found.withColumn("_ss_run", in_one_encoding(runs)).drop("_ss_text")
    found = cut(with_battery(found, "_ss_run", "_ss_tested").drop("_ss_run"), "secret-spans")
    cleared = cleared_bins(found, "_ss_tested", alpha)
    limit = F.lit(MAX_BIN + 1)
    if cleared:
        known = F.create_map(*[x for k, v in sorted(cleared.items()) for x in (F.lit(k), F.lit(v))])
        random = F.filter("_ss_tested", lambda c: c["bin"] < F.coalesce(F.try_element_at(known, c["stratum"]), limit))
    else:
        random = F.col("_ss_tested")
    return (
        found.withColumn("spans", F.sort_array(F.concat("_ss_base", ranked(random, 3))))
        .withColumn("base_spans", F.col("_ss_base"))
        .drop("_ss_base", "_ss_tested")
    )


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_randomness(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda r: F.size(F.filter("base_spans", lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written("base_spans"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


def _matches_sql(kind: str, rank: int, pattern: str, keep: str = "true", source: str = "docs", offset: str = "0") -> str:
    p = pattern.replace("'", "''")
    size = "list_transform({}, lambda x: length(x))"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, tok, start, start + length(tok) AS stop FROM (
      SELECT doc_id, m[i] AS tok, CAST(off + list_sum({size.format('g[1:i]')}) + coalesce(list_sum({size.format('m[1:i - 1]')}), 0) AS BIGINT) AS start
      FROM (SELECT doc_id, off, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, {offset} AS off, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM {source} WHERE regexp_matches(t, '{p}'))))
      WHERE {keep}"""


def _by_encoding(i: int) -> str:
    return " ".join(f"WHEN regexp_matches(core, '{v[0]}') THEN '{(k, v[1])[i]}'" for k, v in ENCODINGS.items())


OP2_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_matches_sql('assign', 0, ASSIGN, "length(regexp_extract(tok, '" + ASSIGN.replace("'", "''") + "', 2)) >= 8")}
  UNION ALL {_matches_sql('access', 1, ACCESS)} UNION ALL {_matches_sql('hex', 2, HEX)}),
known AS (SELECT doc_id, start, stop, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM base),
gaps AS (SELECT doc_id, coalesce(before, 0) AS a, start AS b FROM known UNION ALL SELECT doc_id, max(stop), NULL FROM base GROUP BY doc_id),
rest AS (SELECT doc_id, 0 AS off, t FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM base)
  UNION ALL SELECT d.doc_id, a, CASE WHEN b IS NULL THEN substring(t, CAST(a AS BIGINT) + 1) ELSE substring(t, CAST(a AS BIGINT) + 1, CAST(greatest(b - a, 0) AS BIGINT)) END FROM docs d JOIN gaps g ON d.doc_id = g.doc_id),
runs AS ({_matches_sql('random', 3, RUN, source='rest', offset='off')}),
mixed AS (SELECT doc_id, start, tok AS t FROM runs WHERE regexp_matches(tok, '{MIXED}')),
pieces AS (SELECT * FROM runs WHERE NOT regexp_matches(tok, '{MIXED}') UNION ALL {_matches_sql('random', 3, STRETCH, source='mixed', offset='start')}),
free AS (SELECT *, regexp_replace(tok, '=+$', '') AS core FROM pieces),
named AS (SELECT *, CASE {_by_encoding(0)} END AS name, CASE {_by_encoding(1)} END AS alphabet, length(core) AS n
  FROM free WHERE regexp_matches(core, '[0-9]') AND regexp_matches(core, '[A-Za-z]')),
valued AS (SELECT *, CAST(length(alphabet) AS DOUBLE) AS k, list_transform(regexp_extract_all(core, '.'), lambda c: CAST(strpos(alphabet, c) - 1 AS DOUBLE)) AS v,
  list_sum(list_transform(list_distinct(regexp_extract_all(core, '.')), lambda c: pow(n - length(replace(core, c, '')), 2))) AS squares FROM named WHERE name IS NOT NULL),
summed AS (SELECT *, CAST(len(list_filter(v, lambda x: x >= k / 2)) AS DOUBLE) AS high, list_sum(v) / n AS mean,
  1 + len(list_filter(range(2, n + 1), lambda i: (v[i] >= k / 2) <> (v[i - 1] >= k / 2))) AS changes FROM valued),
parts AS (SELECT *, (squares * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, 2 * high * (n - high) / n + 1 AS expected,
  list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) AS over_mean,
  list_sum(list_transform(range(2, n + 1), lambda i: (v[i - 1] - mean) * (v[i] - mean))) AS along FROM summed),
scored AS (SELECT *, least(200, chi * chi + pow(CASE WHEN (expected - 1) * (expected - 2) > 0 THEN (changes - expected) / sqrt((expected - 1) * (expected - 2) / (n - 1)) ELSE 9 END, 2)
  + pow(CASE WHEN over_mean > 0 THEN (along / over_mean + 1 / n) * sqrt(n) ELSE 9 END, 2)) AS x FROM parts),
tailed AS (SELECT *, 1 / (1 + CAST(0.3275911 AS DOUBLE) * sqrt(x / 2)) AS q FROM scored),
tested AS (SELECT doc_id, kind, rank, start, stop, concat(name, ':', CAST(CAST(floor(log2(n)) AS BIGINT) AS VARCHAR)) AS stratum,
  least(greatest(floor(-log10(greatest(least(1, q * (0.254829592 + q * (-0.284496736 + q * (1.421413741 + q * (-1.453152027 + q * 1.061405429)))) * exp(-x / 2) + sqrt(2 * x / pi()) * exp(-x / 2)), 1e-20)) * {BINS_PER_DECADE}), 0), {MAX_BIN}) AS bin FROM tailed),
counted AS (SELECT stratum, bin, sum(count(*)) OVER (PARTITION BY stratum ORDER BY bin DESC) AS r, sum(count(*)) OVER (PARTITION BY stratum) AS m FROM tested GROUP BY stratum, bin),
cleared AS (SELECT stratum, min(bin) AS bin FROM counted WHERE pow(10, -bin / {BINS_PER_DECADE}) * m <= {ALPHA} * r GROUP BY stratum),
spans AS (SELECT doc_id, kind, rank, start, stop FROM base
  UNION ALL SELECT t.doc_id, t.kind, t.rank, t.start, t.stop FROM tested t LEFT JOIN cleared c ON t.stratum = c.stratum WHERE t.bin < coalesce(c.bin, {MAX_BIN + 1})),
joined AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
  string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans,
  string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) FILTER (rank < 3) AS own FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
