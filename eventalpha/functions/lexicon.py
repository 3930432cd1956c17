"""Lexicons as data, and what is computed from their hits.

A lexicon is a list of (category, polarity, term) or a DataFrame of these columns; it is folded into
the plan as a literal array, so detection is a projection over the scan. A single word matches whole
words, a phrase any substring; text and terms are lower-cased."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Entry = tuple[str, str, str]
WORD_SPLIT = r"[^\p{L}\p{N}_]+"


MOST_ENTRIES = 20_000  # a lexicon becomes part of the plan


def load(entries: DataFrame | list[Entry], casefold_terms: bool = True, dedupe_terms: bool = True) -> list[Entry]:
    """Entries of a lexicon table; ValueError beyond MOST_ENTRIES rows."""
    if isinstance(entries, DataFrame):
        rows = [tuple(r) for r in entries.select("category", "polarity", "term").limit(MOST_ENTRIES + 1).collect()]
    else:
        rows = list(entries)
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a lexicon of over {MOST_ENTRIES} entries: join it as a table of words instead")
    rows = [(c, p, t.lower() if casefold_terms else t) for c, p, t in rows if t]
    return list(dict.fromkeys(rows)) if dedupe_terms else rows


def extend(entries: list[Entry], more: list[Entry]) -> list[Entry]:
    return load([*entries, *more])


def hits(text: Column, lexicon: list[Entry]) -> Column:
    """array<struct<category,polarity,term>> of the entries that the text has, in lexicon order."""
    by_term: dict[str, list] = {}
    for nth, (c, p, t) in enumerate(lexicon):
        by_term.setdefault(t, []).append(F.struct(F.lit(nth).alias("nth"), F.lit(c).alias("category"), F.lit(p).alias("polarity"), F.lit(t).alias("term")))
    entries = F.create_map(*[x for t, es in by_term.items() for x in (F.lit(t), F.array(*es))])
    terms = lambda phrase: F.array(*[F.lit(t) for t in by_term if (" " in t) == phrase]).cast("array<string>")

    def found(low: Column) -> Column:
        singles = F.array_intersect(terms(False), F.split(low, WORD_SPLIT))
        phrases = F.filter(terms(True), lambda t: F.contains(low, t))
        return F.sort_array(F.flatten(F.transform(F.concat(singles, phrases), lambda t: F.try_element_at(entries, t))))

    # The lower-cased text is bound to a variable, so that it is computed once however many terms there
    # are, also where the optimizer copies this expression into a filter.
    rows = F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))
    return F.transform(rows, lambda e: F.struct(e["category"].alias("category"), e["polarity"].alias("polarity"), e["term"].alias("term")))


def detect(df: DataFrame, lexicon: list[Entry], text: str = "text", categories: tuple[str, ...] = ("E", "S", "G")) -> DataFrame:
    """``df`` plus num_matches, confidence, category, sentiment, matched_keywords. Ties between
    categories go to the first; as many positive as negative hits count as negative."""
    h = F.col("_hits")
    count = lambda f: F.size(F.filter(h, f))
    per = [count(_in(c)) for c in categories]
    most = F.greatest(*per)
    category = F.coalesce(*[F.when((n == most) & (n > 0), F.lit(c)) for c, n in zip(categories, per)])
    positive = count(lambda e: e["polarity"] == "positive")
    return (
        df.withColumn("_hits", hits(F.coalesce(F.col(text), F.lit("")), lexicon))
        .withColumn("num_matches", F.size("_hits"))
        .withColumn("confidence", F.least(F.col("num_matches") / 10, F.lit(1.0)))
        .withColumn("category", category)
        .withColumn("sentiment", F.when(F.col("num_matches") == 0, F.lit(None)).when(positive > F.col("num_matches") - positive, "positive").otherwise("negative"))
        .withColumn("matched_keywords", F.transform("_hits", lambda e: e["term"]))
        .drop("_hits")
    )


def _in(category: str):
    return lambda e: e["category"] == category


def type_threshold(filing_type: Column, threshold: float) -> Column:
    """Periodic reports are long and need more hits."""
    return F.when(filing_type.isin("10-K", "10-Q"), F.lit(max(2.4 * threshold, 0.60))).otherwise(F.lit(threshold))


def dictionary_scores(text: Column, positive: list[str], negative: list[str]) -> Column:
    """struct<polarity,subjectivity,n_positive,n_negative> by substrings of the lower-cased text."""
    low = F.lower(text)
    n = [sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) for terms in (positive, negative)]
    total = n[0] + n[1]
    words = F.greatest(F.size(F.array_remove(F.split(text, r"\s+"), "")), F.lit(1))
    return F.struct(
        F.when(total > 0, (n[0] - n[1]) / total).otherwise(F.lit(0.0)).alias("polarity"),
        F.when(total > 0, total / words).otherwise(F.lit(0.0)).alias("subjectivity"),
        n[0].alias("n_positive"), n[1].alias("n_negative"),
    )


def group_hits(text: Column, groups: dict[str, tuple[float, list[str]]]) -> Column:
    """struct<group: array<struct<term,at>>>: the words of each group that the text has and where each is first found.
    It depends on the text alone, so a text that many posts share is searched once."""
    listed = {n: F.array(*[F.lit(t) for t in terms]) for n, (_, terms) in groups.items()}

    def placed(low: Column, words: Column, x: Column) -> Column:
        return F.transform(F.array_intersect(x, words), lambda t: F.struct(t.alias("term"), F.instr(low, t).alias("at")))

    # The lower-cased text and its words are bound to variables, so that a text is split once for all groups.
    def found(low: Column) -> Column:
        return F.get(F.transform(F.array(F.split(low, WORD_SPLIT)), lambda w: F.struct(*[placed(low, w, x).alias(n) for n, x in listed.items()])), F.lit(0))

    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found), F.lit(0))


def hits_behind(lead: Column, hits: Column, groups: dict[str, tuple[float, list[str]]]) -> Column:
    """``group_hits`` of the lead and the text behind it, from those of the text; the lead is empty or ends in a space."""
    low = F.lower(lead)
    none = F.array().cast("array<struct<term:string,at:int>>")

    def of(name: str, terms: list[str]) -> Column:
        own = F.array_intersect(F.array(*[F.lit(t) for t in terms]), F.split(low, WORD_SPLIT))
        first = lambda t: F.instr(low, t)
        there = F.coalesce(hits.getField(name), none)
        here = F.transform(own, lambda t: F.struct(t.alias("term"), first(t).alias("at")))
        rest = F.transform(
            F.filter(there, lambda h: ~F.array_contains(own, h["term"])),
            lambda h: F.struct(h["term"].alias("term"), F.when(first(h["term"]) > 0, first(h["term"])).otherwise(h["at"] + F.length(lead)).alias("at")))
        return F.when(lead.isNull(), none).when(lead == "", there).otherwise(F.concat(here, rest)).alias(name)

    return F.struct(*[of(n, terms) for n, (_, terms) in groups.items()])


def names_found(text: Column, names: Column) -> Column:
    """array<struct<name,at>> of those of the names, in either case, that the text has, and where each is first found."""
    up = F.upper(F.coalesce(text, F.lit("")))
    placed = F.get(F.transform(F.array(up), lambda u: F.transform(names, lambda t: F.struct(t.alias("name"), F.instr(u, F.upper(t)).alias("at")))), F.lit(0))
    return F.filter(placed, lambda x: x["at"] > 0)


def relevance(df: DataFrame, groups: dict[str, tuple[float, list[str]]], text: str = "text", ticker: str | None = "ticker") -> DataFrame:
    """``df`` plus relevance and relevance_category. Each category scores min(hits / 3, 1) times its
    weight; several categories lift the best by 1.2, a ticker within 50 characters of a hit by 1.3."""
    at = F.instr(F.upper(F.coalesce(F.col(text), F.lit(""))), F.upper(F.col(ticker))) if ticker else None
    return weigh_hits(df.withColumn("_r", group_hits(F.col(text), groups)), groups, F.col("_r"), at).drop("_r")


def weigh_hits(df: DataFrame, groups: dict[str, tuple[float, list[str]]], hits: Column, at: Column | None) -> DataFrame:
    """``relevance`` from the hits of a text and the place of the ticker in it (0: nowhere)."""
    hit = {n: hits.getField(n) for n in groups}
    score = {n: F.least(F.size(hit[n]) / 3, F.lit(1.0)) * w for n, (w, _) in groups.items()}
    best = F.greatest(*score.values())
    several = sum(((F.size(hit[n]) > 0).cast("int") for n in groups), F.lit(0)) > 1
    value = F.when(several, F.least(best * 1.2, F.lit(1.0))).otherwise(best)
    if at is not None:
        near = F.exists(F.concat(*hit.values()), lambda h: F.abs(at - h["at"]) < 50)
        value = F.when((at > 0) & near, F.least(value * 1.3, F.lit(1.0))).otherwise(value)
    name = F.coalesce(*[F.when((s == best) & (s > 0), F.lit(n)) for n, s in score.items()], F.lit("general"))
    return df.withColumn("relevance", value).withColumn("relevance_category", name)


def engagement(score: Column, comments: Column, karma: Column) -> Column:
    """Log-scaled votes, comments and author karma, weighted .4, .3, .3."""
    part = lambda x, top, w: F.least(F.log1p(F.greatest(x, F.lit(0)).cast("double")) / F.log(F.lit(float(top))), F.lit(1.0)) * w
    return part(score, 1000, 0.4) + part(comments, 50, 0.3) + part(karma, 100000, 0.3)


def blend(parts: list[tuple[float, Column]]) -> Column:
    return sum((w * c for w, c in parts), F.lit(0.0))


def simple_sentiment(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """struct<label,score> from counts of listed words."""
    words = F.split(F.lower(text), r"\s+")
    pos, neg = (F.size(F.filter(words, _one_of(terms))) for terms in (positive, negative))
    total = pos + neg
    return F.struct(
        F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral").alias("label"),
        F.when(pos == neg, F.lit(0.5)).otherwise(F.greatest(pos, neg) / total).alias("score"),
    )


def _one_of(terms: tuple[str, ...]):
    return lambda w: w.isin(*terms)


def numeric(label: Column, score: Column) -> Column:
    return F.when(label == "positive", score).when(label == "negative", -score).otherwise(F.lit(0.0))


def rule_sentiment(
    text: Column, weights: dict[str, float], shifters: dict[str, float], negators: tuple[str, ...], terminators: tuple[str, ...], window: int = 5,
) -> Column:
    """struct<score,n,shifters,negated,polarization,confidence> by one pass over the words.

    Shifters multiply until the next weighted word; a negator turns the following ``window`` plain
    words (factor -0.8) unless a terminator comes first; shifters do not use up the window.

    The terms that a text has come from one hashed intersection, so the tables are searched once for
    each of them, not for each word; the fold visits only words that are terms or hold a terminator, and
    reckons the words between from their places."""
    marks = r"(?<!\S)[.,!?;:]+|[.,!?;:]+(?!\S)"
    words = F.split(F.regexp_replace(F.lower(text), marks, ""), r"\s+")
    kind_of = {t: 0 for t in weights} | {t: 1 for t in shifters} | {t: 2 for t in negators}
    value_of = {t: float(v) for t, v in (weights | shifters).items()}
    # kind: 0 weighted, 1 shifter, 2 negator; a word that only ends a window is 3
    terms = F.array(*[F.lit(t) for t in kind_of]).cast("array<string>")
    table = F.create_map(*[x for t, k in kind_of.items() for x in (F.lit(t), F.struct(F.lit(k).alias("kind"), F.lit(value_of.get(t, 0.0)).alias("value")))])
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(0).alias("until"), F.lit(0).alias("others"), F.lit(1.0).alias("mod"), zero.alias("s"), zero.alias("ss"), F.lit(0).alias("n"),
        F.lit(0).alias("shifters"), F.lit(False).alias("negated"),
    )

    def ends(w: Column) -> Column:
        out = F.lit(False)
        for t in terminators:
            out = out | F.contains(w, F.lit(t))
        return out

    def step(a: Column, x: Column) -> Column:
        kind, value = x["kind"], x["value"]
        plain = x["place"] - a["others"]  # plain words before this one
        negator, shifter, has = kind == 2, kind == 1, kind == 0
        score = value * a["mod"] * F.when(plain < a["until"], F.lit(-0.8)).otherwise(F.lit(1.0))
        return F.struct(
            F.when(negator, plain + window).when(x["ends"] & ~shifter, F.lit(0)).otherwise(a["until"]).alias("until"),
            (a["others"] + (negator | shifter).cast("int")).alias("others"),
            F.when(shifter, a["mod"] * value).when(has, F.lit(1.0)).otherwise(a["mod"]).alias("mod"),
            (a["s"] + F.when(has, score).otherwise(zero)).alias("s"), (a["ss"] + F.when(has, score * score).otherwise(zero)).alias("ss"),
            (a["n"] + has.cast("int")).alias("n"), (a["shifters"] + shifter.cast("int")).alias("shifters"), (a["negated"] | negator).alias("negated"),
        )

    def done(a: Column) -> Column:
        mean = F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(zero)
        spread = F.when(a["n"] > 0, F.sqrt(F.greatest(a["ss"] / a["n"] - mean * mean, zero))).otherwise(zero)
        return F.struct(
            F.greatest(F.least(mean, F.lit(1.0)), F.lit(-1.0)).alias("score"), a["n"].alias("n"), a["shifters"].alias("shifters"),
            a["negated"].alias("negated"), spread.alias("polarization"), F.least(a["n"] / 10, F.lit(1.0)).alias("confidence"),
        )

    def folded(words: Column, here: Column, entries: Column) -> Column:
        def entry(w: Column, i: Column) -> Column:
            at = F.array_position(here, w).cast("int")
            e = F.get(entries, at - 1)
            return F.struct(i.alias("place"), F.when(at > 0, e["kind"]).otherwise(F.lit(3)).alias("kind"), F.when(at > 0, e["value"]).otherwise(zero).alias("value"), ends(w).alias("ends"))

        found = F.filter(F.transform(words, entry), lambda x: (x["kind"] < 3) | x["ends"])
        return F.aggregate(found, start, step, done)

    def bound(value: Column, f) -> Column:
        """f of a variable that holds the value, so that it is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    looked_up = lambda here: F.transform(here, lambda t: F.try_element_at(table, t))
    return F.when(text.isNotNull(), bound(words, lambda w: bound(F.array_intersect(w, terms), lambda here: bound(looked_up(here), lambda e: folded(w, here, e)))))


def label_of(score: Column, dead: float = 0.1) -> Column:
    return F.when(score > dead, "positive").when(score < -dead, "negative").otherwise("neutral")
