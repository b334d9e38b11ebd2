"""Exact, reproducible splits: order within a class comes from a seeded hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.relational import numbered

#: Class tables of at most so many rows are broadcast.
FEW_CLASSES = 100_000


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def ranked_in_class(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """rows with place = 1.. within their class and size = the class's count.

    One distributed sort by class and hash numbers all rows; a class's first
    number turns these into places, so that no task sorts a whole class.
    """
    placed = numbered(rows.withColumn("_draw", _draw(F.col(key), seed)), label, "_draw", key)
    classes = placed.groupBy(F.col(label).alias("_class")).agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("size"))
    if classes.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES:
        classes = F.broadcast(classes)
    joined = placed.join(classes, F.col(label).eqNullSafe(F.col("_class")))
    return joined.select(*rows.columns, (F.col("row_no") - F.col("_first") + 1).alias("place"), "size")


def stratified_split(rows: DataFrame, key: str, label: str, test_size: float, train_size: float | None = None, seed: int = 42) -> DataFrame:
    """rows with split: round(test_size * n) of each class are test, the rest train."""
    if train_size is not None and abs(train_size + test_size - 1) > 1e-8:
        raise ValueError("train_size and test_size must sum to 1")
    if test_size == 1.0:
        return rows.withColumn("split", F.lit("test"))
    ranked = ranked_in_class(rows, key, label, seed)
    return ranked.withColumn("split", F.when(F.col("place") <= F.floor(F.col("size") * test_size + 0.5), F.lit("test")).otherwise(F.lit("train"))).drop("place", "size")


def kfold(rows: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return ranked_in_class(rows, key, label, seed).withColumn("fold", ((F.col("place") - 1) % folds).cast("int")).drop("place", "size")


def balanced(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Each class down-sampled to the size of the smallest."""
    ranked = ranked_in_class(rows, key, label, seed)
    least = ranked.agg(F.min("size").alias("_least"))
    return ranked.crossJoin(F.broadcast(least)).filter(F.col("place") <= F.col("_least")).drop("place", "size", "_least")


def weighted_sample(rows: DataFrame, label: str, seed: int = 42, key: str | None = None) -> DataFrame:
    """As many rows as there are, with replacement, each class equally often (the remainder goes to the first classes).

    A systematic draw in hash order: exact in number, and the same whatever the
    partitioning. key tells rows apart; without one, all columns do.
    """
    keyed = rows.withColumn("_key", F.col(key).cast("string") if key else F.xxhash64(*rows.columns).cast("string"))
    ranked = ranked_in_class(keyed, "_key", label, seed)
    classes = ranked.groupBy(label).agg(F.first("size").alias("_n"))
    if classes.limit(FEW_CLASSES + 1).count() > FEW_CLASSES:
        raise ValueError("too many classes to weigh")
    sizes = sorted(((r[0], r[1]) for r in classes.collect()), key=lambda x: (x[0] is not None, x[0]))
    total, quota = sum(n for _, n in sizes), F.lit(0)
    for i, (name, _) in enumerate(sizes):
        share = total // len(sizes) + (i < total % len(sizes))
        quota = F.when(F.col(label).eqNullSafe(F.lit(name)), F.lit(share)).otherwise(quota)
    upto = lambda place: F.expr(f"(({place}) * _quota) div size")
    copies = (upto("place") - upto("place - 1")).cast("int")
    drawn = ranked.withColumn("_quota", quota.cast("long")).withColumn("_copies", copies).filter("_copies > 0")
    return drawn.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*rows.columns)


def propagate_split(repositories: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors whose payload takes the split of its repository; one join for all of them."""
    side = repositories.select(F.col("repository_id").alias("_r"), F.col("split").alias("_split"))
    joined = vectors.join(side, F.col("payload.repository_id") == F.col("_r"), "left")
    return joined.withColumn("payload", F.col("payload").withField("split", F.coalesce("_split", "payload.split"))).select(*vectors.columns)
