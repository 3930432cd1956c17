"""Quality classifier: a sparse ensemble of conjunctive rules.

A few statistics of a text are column expressions. A random forest over them (Spark ML, on labelled
rows) is only a source of rules: every path from a root to a node is a conjunction of comparisons.
Rules that hold for nearly all or nearly no training rows are dropped, equal ones merged, and an L1
logistic regression over the rule indicators sets most weights to zero. What is left is compiled
into one column expression, so scoring is a projection over the scan: no join, shuffle or Python.

``max_rows`` bounds the labelled rows that the fit reads (chosen by a hash of their id); everything
else covers all rows. Features never include labels, language, source or ids.

Defined cases: null and empty texts have all statistics 0 and get a score like any text; without
labels of both classes every score is the share of label 1 (0.5 for none); a document labelled more
than once counts once with its least label; repeated rows get equal scores; further columns pass
through, and names that begin with ``_qm_`` are reserved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, table, text_of, words_of

STATISTICS = (
    "words", "mean_word", "distinct_share", "symbol_share", "upper_share", "digit_share",
    "punctuation", "repeated_lines", "words_a_line",
)

#: A comparison of a statistic: (name, is it "at most" rather than "over", threshold).
Comparison = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Comparison, ...], float], ...]

    def score(self, prefix: str = "_qm_") -> Column:
        """The probability of label 1, from columns ``prefix`` + statistic."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Comparison, ...], prefix: str = "_qm_") -> Column:
    out = F.lit(True)
    for name, at_most, threshold in rule:
        c = F.col(prefix + name)
        out = out & ((c <= threshold) if at_most else (c > threshold))
    return out


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "_qm_") -> DataFrame:
    t = text_of(text)
    words, lines = F.col(f"{prefix}w"), F.col(f"{prefix}l")
    n_words, n_chars = F.size(words).cast("double"), F.length(t).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    count = lambda pattern: (F.size(F.split(t, pattern, -1)) - 1).cast("double")
    values = {
        "words": n_words,
        "mean_word": share(F.length(F.array_join(words, "")), n_words),
        "distinct_share": share(F.size(F.array_distinct(words)), n_words),
        "symbol_share": share(count("[#*$%&|<>]"), n_chars),
        "upper_share": share(count(r"\p{Lu}"), n_chars),
        "digit_share": share(count("[0-9]"), n_chars),
        "punctuation": share(count("[.,;:!?]"), n_words),
        "repeated_lines": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": share(n_words, F.size(lines)),
    }
    out = df.withColumn(f"{prefix}w", words_of(t)).withColumn(
        f"{prefix}l", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    )
    return out.withColumns({prefix + k: values[k].cast("double") for k in STATISTICS}).drop(f"{prefix}w", f"{prefix}l")


def tree_paths(tree) -> list[tuple[Comparison, ...]]:
    """All paths from the root to a node of a fitted Spark ML tree; the tightest bound of each side
    of a statistic, in the order of STATISTICS."""
    out: list[tuple[Comparison, ...]] = []

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            out.append(tuple((n, s, path[n, s]) for n in STATISTICS for s in (True, False) if (n, s) in path))
        if not node.getClass().getSimpleName().endswith("InternalNode"):
            return
        split = node.split()
        name, at = STATISTICS[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), path | {(name, True): min(at, path.get((name, True), at))})
        walk(node.rightChild(), path | {(name, False): max(at, path.get((name, False), at))})

    walk(tree._java_obj.rootNode(), {})
    return out


def training_rows(df: DataFrame, labels: DataFrame, max_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics and label of at most ``max_rows`` labelled documents outside the held-out fold."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_qm_key")).agg(F.min("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("_qm_key"), "_qm_key").limit(max_rows)
    )
    chosen = F.broadcast(cut(known, "labelled-rows"))  # max_rows rows of 16 bytes
    return with_statistics(df.select(F.col(key).alias("_qm_key"), F.col(text).alias("_qm_text")).join(chosen, "_qm_key"), "_qm_text").drop("_qm_text")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    df: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 3,
    penalty: float = 0.001, key: str = "doc_id", text: str = "text", seed: int = 7,
) -> RuleModel:
    rows = cut(training_rows(df, labels, max_rows, key, text), "training-statistics")
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < ones < n:
        share = ones / n if n else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(_logit(share), ())
    # An order of its own, so that bootstrap samples do not depend on how rows are partitioned.
    rows = rows.repartition(4, "_qm_key").sortWithinPartitions("_qm_key")
    vectors = rows.select("label", array_to_vector(F.array(*[f"_qm_{s}" for s in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, minInstancesPerNode=5).fit(vectors)
    rules = list(dict.fromkeys(p for tree in forest.trees for p in tree_paths(tree)))
    if not rules:
        return RuleModel(_logit(ones / n), ())
    support = rows.agg(*[F.avg(holds(r).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    rules = [r for r, s in zip(rules, support) if 0.005 <= s <= 0.995]
    if not rules:
        return RuleModel(_logit(ones / n), ())
    indicators = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(indicators)
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def classify(
    df: DataFrame, model: RuleModel, threshold: float = 0.7, text: str = "text", score: str = "score", predicted: str = "predicted",
) -> DataFrame:
    """``df`` plus the columns ``score`` and ``predicted``, which take the place of columns of these names."""
    scored = with_statistics(df, text).withColumn(score, model.score()).drop(*[f"_qm_{s}" for s in STATISTICS])
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op1_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
