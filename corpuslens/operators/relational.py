"""Joins, filters and aggregates over the repository tree.

Every operator is a declarative plan: filters sit on the scans, functionalities
are counted before they meet wider rows, and joins carry keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.materialize import fixed
from corpuslens.schemas import binary_label


def pending_snippets_with_meta(snippets: DataFrame, files: DataFrame) -> DataFrame:
    """Unprocessed snippets (a null flag is not pending) with their file's columns."""
    meta = files.select("file_id", "language", "filename", "filepath", "repository_id")
    return snippets.filter(~F.col("processed")).select("snippet_id", "file_id", "code", "start_line", "end_line", "processed").join(meta, "file_id")


def functionalities_by_repository(functionalities: DataFrame, snippets: DataFrame, files: DataFrame, repository_id: int | None = None) -> DataFrame:
    """functionalities with repository_id: one join for all repositories instead of a query for each."""
    owners = files.select("file_id", "repository_id")
    if repository_id is not None:
        owners = owners.filter(F.col("repository_id") == repository_id)
    return functionalities.join(snippets.select("snippet_id", "file_id").join(owners, "file_id").drop("file_id"), "snippet_id")


def cluster_counts(functionalities: DataFrame, snippets: DataFrame, files: DataFrame) -> DataFrame:
    """repository_id, cluster_id, cnt; null clusters do not count."""
    per_snippet = functionalities.filter(F.col("cluster_id").isNotNull()).groupBy("snippet_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    per_file = per_snippet.join(snippets.select("snippet_id", "file_id"), "snippet_id").groupBy("file_id", "cluster_id").agg(F.sum("n").alias("n"))
    return per_file.join(files.select("file_id", "repository_id"), "file_id").groupBy("repository_id", "cluster_id").agg(F.sum("n").alias("cnt"))


def repository_clusters(repositories: DataFrame, counts: DataFrame, split: str | None = None) -> DataFrame:
    """Processed repositories (all of them, also empty ones) left-joined with their cluster counts."""
    chosen = repositories.filter("processed")
    if split is not None:
        chosen = chosen.filter(F.col("split") == split)
    return chosen.select("repository_id", "label").join(counts, "repository_id", "left")


def repository_histograms(clusters: DataFrame) -> DataFrame:
    """repository_id, label, data: map of cluster to count, null for repositories without clusters."""
    entries = F.collect_list(F.when(F.col("cluster_id").isNotNull(), F.struct("cluster_id", "cnt")))
    grouped = clusters.groupBy("repository_id", "label").agg(F.array_sort(entries).alias("e"))
    return grouped.select("repository_id", "label", F.when(F.size("e") > 0, F.map_from_entries("e")).alias("data"))


def with_binary_label(rows: DataFrame, column: str = "label") -> DataFrame:
    return rows.withColumn(column, binary_label(F.col(column)))


def changed(old: Column, new: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~old.eqNullSafe(new)


def not_true(flag: Column) -> Column:
    """IS NOT TRUE: false or null."""
    return ~flag.eqNullSafe(F.lit(True))


def parents_with_open_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.filter(not_true(F.col("processed"))), key, "left_semi")


def parents_without_open_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """NOT EXISTS (child that is not processed): also true for parents without children."""
    return parents.join(children.filter(not_true(F.col("processed"))), key, "left_anti")


def point_lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """The row with that key; more than one raises when the plan runs."""
    found = rows.filter(F.col(column) == F.lit(value))
    n = found.agg(F.count(F.lit(1)).alias("_n"))
    return found.crossJoin(F.broadcast(n.select(F.assert_true(F.col("_n") <= 1, F.lit(f"more than one row for {column}")).alias("_ok")))).filter("_ok is null").drop("_ok")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with batch_id: consecutive batches of `size` rows in the order of a key.

    Row numbers come from range partitions and their counts, so no task sorts everything.
    """
    return numbered(rows, order).withColumn("batch_id", F.floor((F.col("row_no") - 1) / size).cast("long"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with row_no = 1..n in the order of the columns, by a distributed sort."""
    # Range bounds are sampled anew on each evaluation; the checkpoint makes counts and rows agree.
    placed = fixed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    ends = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = ends.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    return local.join(F.broadcast(before), "_part").withColumn("row_no", (F.col("_at") + F.col("_base")).cast("long")).drop("_part", "_at", "_base")


def batch_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("batches"))
