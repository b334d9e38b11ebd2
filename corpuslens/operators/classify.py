"""Repository classification: a weighted, elastic-net logistic model; predictions; exact attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.metrics import auc, class_weights, confusion_matrix, per_class, roc_points, summary
from corpuslens.schemas import LABELS


def fit(rows: DataFrame, label: str = "y", l1: float = 1e-3, decay: float = 1e-3, epochs: int = 30):
    """A model of rows (features, y) with weights against class imbalance; L1 and L2 as one elastic net."""
    from pyspark.ml.classification import LogisticRegression

    weights = class_weights(rows, label).select(label, (F.col("weight")).alias("_w"))
    strength = l1 + decay
    learner = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", maxIter=epochs, regParam=strength, elasticNetParam=l1 / strength if strength else 0.0)
    return learner.fit(rows.join(F.broadcast(weights), label))


def fit_k_fold(rows: DataFrame, folds: int = 5, label: str = "y", **options) -> list[tuple[int, float]]:
    """(fold, validation accuracy) for rows with a fold column."""
    out = []
    for i in range(folds):
        model = fit(rows.filter(F.col("fold") != i), label, **options)
        scored = model.transform(rows.filter(F.col("fold") == i))
        out.append((i, scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]))
    return out


def best_checkpoint(results: DataFrame, name: str = "name", score: str = "val_acc") -> DataFrame:
    return results.agg(F.max_by(name, score).alias("best"), F.max(score).alias(score))


def predict(model, rows: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """repository_id, label, prediction (class names), score (probability of class 1)."""
    from pyspark.ml.functions import vector_to_array

    names = F.create_map(*[x for i, n in (labels or LABELS).items() for x in (F.lit(float(i)), F.lit(n))])
    scored = model.transform(rows)
    return scored.select("repository_id", "label", F.element_at(names, F.col("prediction")).alias("prediction"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def checked_predictions(predictions: DataFrame, repositories: DataFrame) -> DataFrame:
    """predictions joined with their repositories; one without raises when the plan runs."""
    names = repositories.select("repository_id", "name")
    joined = predictions.join(names, "repository_id", "left")
    return joined.withColumn("_ok", F.assert_true(F.col("name").isNotNull(), F.lit("prediction without repository"))).filter("_ok is null").drop("_ok")


def evaluate(rows: DataFrame, truth: str = "truth", pred: str = "pred", score: str | None = None) -> dict[str, DataFrame]:
    """matrix, classes, summary, and with a score auc and roc, of rows of class indices."""
    matrix = confusion_matrix(rows, sorted(LABELS), truth, pred)
    out = {"matrix": matrix, "classes": per_class(matrix), "summary": summary(matrix)}
    if score:
        out |= {"auc": auc(rows, truth, score), "roc": roc_points(rows, truth, score)}
    return out


def linear_attribution(long_rows: DataFrame, weights: DataFrame) -> DataFrame:
    """id, feature, attribution = w * (x - mean x): the exact Shapley value of a linear model.

    long_rows: id, feature, x with zeros left out only if they are not wanted; weights: feature, w.
    """
    means = long_rows.groupBy("feature").agg(F.avg("x").alias("m"))
    return long_rows.join(means, "feature").join(weights, "feature").select("id", "feature", (F.col("w") * (F.col("x") - F.col("m"))).alias("attribution"))


def top_features(attributions: DataFrame, k: int, names: DataFrame | None = None) -> DataFrame:
    """The k features with the largest mean, by size, with their mean; `[i] name` titles where names are known."""
    means = attributions.groupBy("feature").agg(F.avg("attribution").alias("mean"), F.avg(F.abs("attribution")).alias("mean_abs"))
    best = means.orderBy(F.desc(F.abs("mean")), "feature").limit(k)
    if names is None:
        return best
    title = F.concat(F.lit("["), F.col("feature").cast("string"), F.lit("] "), F.coalesce("name", F.lit("Unknown Feature")))
    return best.join(names, "feature", "left").withColumn("title", title).drop("name")
