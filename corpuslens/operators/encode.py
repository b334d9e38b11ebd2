"""Feature encoding of cluster counts in long form (one row for each repository and cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.schemas import LABELS


def validated(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Raises on clusters outside 0..k-1 and on negative counts; drops zero counts."""
    fine = (F.col("cluster_id") >= 0) & (F.col("cnt") >= 0)
    if k is not None:
        fine = fine & (F.col("cluster_id") < k)
    checked = counts.withColumn("_ok", F.assert_true(F.coalesce(fine, F.lit(True)), F.lit("cluster or count out of range")))
    return checked.filter("_ok is null").drop("_ok").filter("cnt > 0")


def percentages(counts: DataFrame, key: str = "repository_id") -> DataFrame:
    """pct: the cluster's share of its repository's count."""
    return counts.withColumn("pct", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key)))


def frobenius_scaled(shares: DataFrame) -> DataFrame:
    """value: pct divided by the Frobenius norm of the whole matrix."""
    norm = shares.agg(F.sqrt(F.sum(F.col("pct") * F.col("pct"))).alias("_norm"))
    return shares.crossJoin(F.broadcast(norm)).withColumn("value", F.col("pct") / F.col("_norm")).drop("_norm")


def decoded(values: DataFrame, threshold: float = 0.5, column: str = "pct") -> DataFrame:
    return values.filter(F.col(column) >= threshold)


def top_clusters(counts: DataFrame, most: int = 512, key: str = "repository_id", k: int | None = None) -> DataFrame:
    """The most frequent clusters (ties: least id) with weights that sum to 1 over those kept; odd tokens are left out."""
    fine = (F.col("cluster_id") >= 0) & (F.col("cnt") > 0)
    if k is not None:
        fine = fine & (F.col("cluster_id") < k)
    ranked = counts.filter(fine).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cnt"), "cluster_id")))
    return ranked.filter(F.col("rank") <= most).withColumn("weight", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key)))


def sparse_features(repositories: DataFrame, values: DataFrame, k: int, value: str = "value") -> DataFrame:
    """repositories with features (a sparse vector of size k); without clusters all zero."""
    from pyspark.ml.functions import array_to_vector  # noqa: F401
    from pyspark.ml.linalg import Vectors, VectorUDT

    entries = values.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", F.col(value).cast("double").alias("v")))).alias("e"))

    @F.udf(VectorUDT())
    def build(e):
        return Vectors.sparse(k, [x[0] for x in e or []], [x[1] for x in e or []])

    return repositories.join(entries, "repository_id", "left").withColumn("features", build("e")).drop("e")


def label_index(label, labels: dict[int, str] | None = None):
    """The class index of a label, -1 for unknown ones."""
    out = F.lit(-1)
    for i, name in (labels or LABELS).items():
        out = F.when(label == name, F.lit(i)).otherwise(out)
    return out
