"""Scaling, components, clusters, pair labels, classifiers and their explanation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import difference_vector
from .sampling import hash_order, seeded_sample

#: Rows on which scalers, components and clusters are fitted; everything is transformed.
FIT_ROWS = 200_000

#: Rows that stand in one hashed order when pairs are drawn.
SLICE_ROWS = 10_000


def numeric_columns(df: DataFrame, but: set[str]) -> list[str]:
    """Numeric columns other than metadata."""
    return [f.name for f in df.schema.fields if f.name not in but and isinstance(f.dataType, T.NumericType)]


def vectors(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


@dataclass
class Clusters:
    scaler: object
    pca: object
    kmeans: KMeansModel
    costs: list[tuple[int, float]]
    silhouette: float

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with its cluster."""
        rows = self.kmeans.transform(self.pca.transform(self.scaler.transform(df)))
        return rows.drop("scaled", "pca")


def components_for(explained: np.ndarray, share: float = 0.95) -> int:
    """How many components explain ``share`` of the variance."""
    total = np.cumsum(explained)
    return int(min(len(total), np.searchsorted(total, share * total[-1]) + 1))


def cluster(df: DataFrame, key: str, k: int = 10, elbow: tuple[int, ...] = (), share: float = 0.95, seed: int = 42, fit_rows: int = FIT_ROWS) -> Clusters:
    """Scale, reduce to the components that explain ``share``, and cluster, fitted on a hashed sample of ``fit_rows``.

    The scaler divides by the sample's standard deviation. The silhouette is
    of squared Euclidean distances.
    """
    fit = seeded_sample(df, key, fit_rows, seed).persist()
    try:
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(fit)
        scaled = scaler.transform(fit)
        width = len(fit.first()["features"])
        full = PCA(k=width, inputCol="scaled", outputCol="pca").fit(scaled)
        pca = PCA(k=components_for(full.explainedVariance.toArray(), share), inputCol="scaled", outputCol="pca").fit(scaled)
        reduced = pca.transform(scaled).persist()
        means = lambda n: KMeans(k=n, seed=seed, featuresCol="pca", predictionCol="cluster").fit(reduced)
        costs = [(n, means(n).summary.trainingCost) for n in elbow]
        model = means(k)
        score = ClusteringEvaluator(featuresCol="pca", predictionCol="cluster").evaluate(model.transform(reduced)) if k > 1 else 0.0
        reduced.unpersist()
        return Clusters(scaler, pca, model, costs, score)
    finally:
        fit.unpersist()


def neighbour_pairs(df: DataFrame, key: str, group: str, vector: str, per_row: int = 2, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Labelled pairs, a bounded number per row: followers in hashed order within the group, and across groups.

    (a, b, label, pair): label 1 within a group, 0 across; pair is the
    difference vector. Rows stand in a hashed order, within slices of about
    ``slice_rows`` of which each meets the next few, so no group is paired
    with itself whole. Only ids are sorted; vectors are joined to the pairs.
    """
    rows = df.select(F.col(key).alias("a"), F.col(group).alias("g"), F.col(vector).alias("x"))
    slices = max(1, rows.count() // slice_rows)
    ids = rows.select("a", "g", hash_order(F.col("a"), seed=seed).alias("h"))
    ids = ids.withColumn("slice", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % slices)
    alike, near = Window.partitionBy("slice", "g").orderBy("h", "a"), Window.partitionBy("slice").orderBy("h", "a")
    steps = range(1, per_row + 1)
    follow = [F.struct(F.lit(1).alias("label"), F.lead("a", n).over(alike).alias("b"), F.col("g").alias("g2")) for n in steps]
    follow += [F.struct(F.lit(0).alias("label"), F.lead("a", n).over(near).alias("b"), F.lead("g", n).over(near).alias("g2")) for n in steps]
    pairs = ids.select("a", "g", F.array(*follow).alias("f")).select("a", "g", F.inline("f")).filter("b is not null and (label = 1 or g <> g2)").select("a", "b", "label")
    both = pairs.join(rows.select("a", "x"), "a").join(rows.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    return both.select("a", "b", "label", difference_vector(F.col("x"), F.col("y")).alias("pair"))


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """A ``weight`` that gives each class the same sum."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total, out = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        out = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(out)
    return df.withColumn("weight", out)


CLASSIFIERS = {
    "rf": lambda seed: RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed), "lr": lambda seed: LogisticRegression(regParam=0.01, elasticNetParam=0.5),
    "gbt": lambda seed: GBTClassifier(maxIter=30, seed=seed), "tree": lambda seed: DecisionTreeClassifier(maxDepth=6, seed=seed),
}


def train(df: DataFrame, kind: str = "rf", seed: int = 42) -> PipelineModel:
    """A classifier of ``features`` to ``label``, classes balanced by weight."""
    stage = CLASSIFIERS[kind](seed).setFeaturesCol("features").setLabelCol("label").setWeightCol("weight")
    return Pipeline(stages=[stage]).fit(with_class_weights(df))


def cross_validated(df: DataFrame, key: Column, grid: dict[str, list] | None = None, folds: int = 5, seed: int = 42) -> CrossValidatorModel:
    """Logistic regression over a grid, with folds by hash within each label."""
    w = Window.partitionBy("label").orderBy(hash_order(key, seed=seed))
    rows = with_class_weights(df).withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight")
    build = ParamGridBuilder()
    for name, values in (grid or {"regParam": [0.001, 0.01, 0.1]}).items():
        build = build.addGrid(lr.getParam(name), values)
    return CrossValidator(estimator=lr, estimatorParamMaps=build.build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold").fit(rows)


def split(df: DataFrame, key: Column, test: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash, the same share of each label in expectation."""
    u = F.conv(F.substring(hash_order(key, F.col("label"), seed=seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    rows = df.withColumn("__u", u)
    return rows.filter(F.col("__u") >= test).drop("__u"), rows.filter(F.col("__u") < test).drop("__u")


def probability(model: PipelineModel, df: DataFrame, out: str = "model_prob") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability")


def report(predicted: DataFrame, score: str = "model_prob") -> DataFrame:
    """(label, prediction, n): the confusion matrix."""
    return predicted.groupBy("label", (F.col(score) >= 0.5).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def quality(predicted: DataFrame, score: str = "model_prob") -> dict[str, float]:
    """AUC, precision, recall and F1 of label 1."""
    auc = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label").evaluate(predicted)
    n = {(r["label"], r["prediction"]): r["n"] for r in report(predicted, score).collect()}
    tp, fp, fn = n.get((1, 1), 0), n.get((0, 1), 0), n.get((1, 0), 0)
    precision, recall = tp / max(1, tp + fp), tp / max(1, tp + fn)
    return {"auc": auc, "precision": precision, "recall": recall, "f1": 2 * precision * recall / max(1e-12, precision + recall)}


def importances(model: PipelineModel, names: list[str], top: int = 20) -> list[tuple[str, float]]:
    """The features with the largest importance, or coefficient, of the last stage."""
    stage = model.stages[-1]
    values = stage.featureImportances.toArray() if hasattr(stage, "featureImportances") else np.abs(stage.coefficients.toArray())
    return sorted(zip(names, values.tolist()), key=lambda x: (-x[1], x[0]))[:top]


def contributions(x: Column, mean: list[float], std: list[float], coefficients: list[float]) -> Column:
    """Per feature coefficient * (x - mean) / std, 0 where std is 0: a linear score taken apart."""
    parts = F.arrays_zip(x.alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s"), F.array(*map(F.lit, coefficients)).alias("c"))
    return F.transform(parts, lambda e: F.when(e["s"] > 0, e["c"] * (e["x"] - e["m"]) / e["s"]).otherwise(0.0))
