"""Labels, feature selection and classifiers on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventalpha.operators.folds import Fold, merged
from eventalpha.operators.ranks import tile, with_rank
from eventalpha.sources.tables import scratch


def return_label(ret: Column, low: float = -0.01, high: float = 0.01) -> Column:
    """0 down, 1 flat, 2 up."""
    return F.when(ret > high, 2).when(ret < low, 0).otherwise(1)


def long_form(df: DataFrame, features: list[str], target: str, key: str) -> DataFrame:
    """(key, target, feature, x); missing values are 0."""
    filled = df.select(key, F.col(target).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return filled.unpivot([key, "y"], features, "feature", "x")


def _top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def select_by_correlation(df: DataFrame, features: list[str], target: str, k: int, method: str = "pearson", key: str = "vec_id") -> DataFrame:
    """The k features of the largest |correlation| with the target; Spearman by average ranks."""
    rows = long_form(df, features, target, key)
    if method == "spearman":
        # Equal values share their mean row number; every feature has as many rows as the table.
        n = df.count()
        rx = with_rank(rows.select("feature", "x", key), ["feature", "x", key]).groupBy("feature", "x").agg(F.avg(F.col("_rank") % n).alias("rx"))
        ry = with_rank(rows.filter(F.col("feature") == features[0]).select("y", key), ["y", key]).groupBy("y").agg(F.avg("_rank").alias("ry"))
        rows = rows.join(rx, ["feature", "x"]).join(ry, "y").select("feature", F.col("rx").alias("x"), F.col("ry").alias("y"))
    score = F.coalesce(F.nanvl(F.abs(F.corr("x", "y")), F.lit(0.0)), F.lit(0.0))
    return _top(rows.groupBy("feature").agg(score.alias("score")), k)


def select_by_variance(df: DataFrame, features: list[str], k: int, least: float = 0.01, key: str = "vec_id", target: str = "label") -> DataFrame:
    rows = long_form(df, features, target, key)
    return _top(rows.groupBy("feature").agg(F.var_samp("x").alias("score")).filter(F.col("score") >= least), k)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of the columns, a before b in the list; 0 where undefined. One pass: each task
    folds its rows into means and co-moments, and only these matrices are merged."""
    import numpy as np

    def update(state, frame):
        x = frame[columns].to_numpy(np.float64)
        mean = x.mean(axis=0)
        return merge(state, (len(x), mean, (x - mean).T @ (x - mean)))

    def merge(a, b):
        if a is None or b is None:
            return a or b
        n = a[0] + b[0]
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def finish(state):
        m = state[2]
        spread = np.sqrt(np.outer(np.diag(m), np.diag(m)))
        corr = np.divide(m, spread, out=np.zeros_like(m), where=spread > 0)
        return [(columns[i], columns[j], float(corr[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns))]

    clean = df.select(F.lit(0).alias("_all"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return merged(clean, ["_all"], Fold(lambda: None, update, merge, finish), "a string, b string, corr double").drop("_all")


def drop_collinear(df: DataFrame, features: list[str], target: str, limit: float = 0.8) -> DataFrame:
    """Features without those that lose a pair of |correlation| above the limit (the one less
    correlated with the target loses; ties: the later name), with that correlation as score."""
    both = correlations(df.select(*features, F.col(target).alias("_y")), [*features, "_y"]).withColumn("c", F.abs("corr"))
    own = both.filter("b = '_y'").select(F.col("a").alias("feature"), F.col("c").alias("score"))
    close = both.filter((F.col("b") != "_y") & (F.col("c") > limit)).select("a", "b")
    j = close.join(own.select(F.col("feature").alias("a"), F.col("score").alias("sa")), "a").join(own.select(F.col("feature").alias("b"), F.col("score").alias("sb")), "b")
    losers = j.select(F.when(F.col("sa") >= F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("feature")).distinct()
    return own.join(losers, "feature", "left_anti")


def select_by_mutual_information(df: DataFrame, features: list[str], target: str, k: int, bins: int = 5, key: str = "vec_id") -> DataFrame:
    """Mutual information of equal-count bins with the label."""
    rows = long_form(df, features, target, key)
    n = df.count()  # rows of each feature
    binned = with_rank(rows, ["feature", "x", key]).withColumn("bx", tile(F.col("_rank") % n, n, bins))
    joint = binned.groupBy("feature", "bx", "y").agg(F.count(F.lit(1)).alias("n"))
    f = Window.partitionBy("feature")
    total, nx, ny = F.sum("n").over(f), F.sum("n").over(Window.partitionBy("feature", "bx")), F.sum("n").over(Window.partitionBy("feature", "y"))
    mi = joint.withColumn("i", F.col("n") / total * F.ln(F.col("n") * total / (nx * ny)))
    return _top(mi.groupBy("feature").agg(F.sum("i").alias("score")), k)


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    clean = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(clean)


def _importances(data: DataFrame, names: list[str], seed: int) -> list[tuple[str, float]]:
    """Of rows (features, label): the names, most important first; ties by name."""
    weights = RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed).fit(data).featureImportances.toArray()
    return sorted(zip(names, map(float, weights)), key=lambda x: (-x[1], x[0]))


def select_by_forest(df: DataFrame, features: list[str], target: str, k: int, seed: int = 42) -> list[tuple[str, float]]:
    data = _assembled(df, features).select("features", F.col(target).cast("double").alias("label"))
    return _importances(data, features, seed)[:k]


def eliminate(df: DataFrame, features: list[str], target: str, k: int, step: int = 1, seed: int = 42) -> DataFrame:
    """Recursive elimination: (feature, ranking, importance). Each round fits a forest to the features left and
    drops the ``step`` least important ones, until k are left; these have ranking 1, those of the last round
    2, and so on; importance is that of the last fit that had the feature. The vectors are assembled and written
    once, and each round takes a slice of them."""
    path = scratch(df.sparkSession, "assembled")
    _assembled(df, features).select("features", F.col(target).cast("double").alias("label")).write.parquet(path)
    data = df.sparkSession.read.parquet(path).withColumnRenamed("features", "every")
    left, dropped, scores = list(features), [], {}
    while True:
        at = [features.index(f) for f in left]
        found = _importances(VectorSlicer(inputCol="every", outputCol="features", indices=at).transform(data).select("features", "label"), left, seed)
        scores |= dict(found)
        if len(left) <= k:
            break
        gone = {f for f, _ in found[max(k, len(left) - step) :]}
        dropped.append(gone)
        left = [f for f in left if f not in gone]
    rank = {f: 1 for f in left} | {f: 2 + i for i, gone in enumerate(reversed(dropped)) for f in gone}
    return df.sparkSession.createDataFrame([(f, rank[f], scores[f]) for f in features], "feature string, ranking int, importance double")


def vote(selections: list[DataFrame], scores: DataFrame, least: int, k: int) -> DataFrame:
    """Features chosen by ``least`` selections; more votes first, then by score."""
    out = selections[0].select("feature")
    for s in selections[1:]:
        out = out.unionAll(s.select("feature"))
    votes = out.groupBy("feature").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= least)
    return votes.join(scores.select("feature", "score"), "feature", "left").orderBy(F.desc("votes"), F.desc("score"), "feature").limit(k)


def pipeline(features: list[str], kind: str = "forest", classes: int = 3, seed: int = 42) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="raw")
    scale = (MinMaxScaler if kind == "bayes" else StandardScaler)(inputCol="raw", outputCol="features")
    model = {
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
        "bayes": lambda: NaiveBayes(),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[len(features), 16, classes], seed=seed, maxIter=30),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=10)),
    }[kind]()
    return Pipeline(stages=[assembler, scale, model])


@dataclass
class Fitted:
    """A pipeline and, for a model that takes no negative values, the least training value of each feature:
    smaller ones count as that, so that a scaled feature is never below 0."""

    model: PipelineModel
    features: list[str]
    floors: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df.withColumns({c: F.greatest(_filled(c), F.lit(self.floors[c])) if c in self.floors else _filled(c) for c in self.features}))

    def importances(self) -> DataFrame:
        """(feature, importance) of a forest, most important first."""
        weights = self.model.stages[-1].featureImportances.toArray()
        rows = sorted(zip(self.features, map(float, weights)), key=lambda x: (-x[1], x[0]))
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def fit(df: DataFrame, features: list[str], label: str = "label", kind: str = "forest") -> Fitted:
    clean = df.withColumns({c: _filled(c) for c in features}).withColumn("label", F.col(label).cast("double"))
    floors = clean.agg(*[F.min(c).alias(c) for c in features]).first().asDict() if kind == "bayes" else {}
    return Fitted(pipeline(features, kind).fit(clean), features, floors)


def predict(model: Fitted, df: DataFrame) -> DataFrame:
    return model.transform(df)


def accuracy(predictions: DataFrame, label: str = "label") -> Column | DataFrame:
    return predictions.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def time_series_cv(df: DataFrame, features: list[str], order: list[str], splits: int, label: str = "label", kind: str = "forest") -> DataFrame:
    """fold, accuracy: each block predicted from all before, one fit a fold. ``order`` must tell all rows
    apart; the rows are numbered by range."""
    ranked = with_rank(df, order)
    blocks = ranked.withColumn("_b", tile(F.col("_rank"), ranked.count(), splits + 1)).drop("_rank")
    out = None
    for i in range(1, splits + 1):
        model = fit(blocks.filter(F.col("_b") <= i), features, label, kind)
        part = accuracy(predict(model, blocks.filter(F.col("_b") == i + 1)), label).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def ensemble_vote(predictions: DataFrame, key: str) -> DataFrame:
    """predictions: (key, model, prediction, weight): the class of the greatest weight; ties to the lower class."""
    g = predictions.groupBy(key, "prediction").agg(F.sum("weight").alias("w"))
    return g.groupBy(key).agg(F.max_by("prediction", F.struct("w", (-F.col("prediction")).alias("p"))).alias("prediction"))


def confusion(predictions: DataFrame, classes: list[int], label: str = "label") -> DataFrame:
    """Rows by label, columns p<class>, and recall of the label, precision and f1 of the class."""
    g = predictions.groupBy(F.col(label).cast("int").alias("label")).pivot("prediction", classes).agg(F.count(F.lit(1))).fillna(0)
    g = g.select("label", *[F.col(str(c)).alias(f"p{c}") for c in classes])
    hit = sum((F.when(F.col("label") == c, F.col(f"p{c}")).otherwise(0) for c in classes), F.lit(0))
    every = Window.partitionBy(F.lit(1))  # a row for each class
    called = sum((F.when(F.col("label") == c, F.sum(f"p{c}").over(every)).otherwise(0) for c in classes), F.lit(0))
    g = g.withColumn("recall", F.coalesce(F.try_divide(hit, sum((F.col(f"p{c}") for c in classes), F.lit(0))), F.lit(0.0))).withColumn("precision", F.coalesce(F.try_divide(hit, called), F.lit(0.0)))
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
