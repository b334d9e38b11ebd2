"""Derived `processed` flags: snippets -> files -> repositories, whole or for affected parents only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_up(parents: DataFrame, children: DataFrame, key: str, empty_as_processed: bool = True) -> DataFrame:
    """parents with processed = no child is open (false or null); parents without children as told."""
    flags = children.groupBy(key).agg(F.bool_and(F.coalesce("processed", F.lit(False))).alias("_all"))
    kept = [c for c in parents.columns if c != "processed"]
    return parents.join(flags, key, "left").select(*kept, F.coalesce("_all", F.lit(empty_as_processed)).alias("processed"))


def backfill(repositories: DataFrame, files: DataFrame, snippets: DataFrame, empty_as_processed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, repositories) with both levels derived anew; running it again changes nothing."""
    done = rolled_up(files, snippets, "file_id", empty_as_processed)
    return done, rolled_up(repositories, done, "repository_id", empty_as_processed)


def affected_parents(before: DataFrame, after: DataFrame, child: str, key: str) -> DataFrame:
    """Parents of children that were added, removed, changed their flag, or moved (old and new parent)."""
    old = before.select(F.col(child).alias("c"), F.col(key).alias("p0"), F.col("processed").alias("f0"))
    new = after.select(F.col(child).alias("c"), F.col(key).alias("p1"), F.col("processed").alias("f1"))
    moved = old.join(new, "c", "full").filter(~F.col("p0").eqNullSafe(F.col("p1")) | ~F.col("f0").eqNullSafe(F.col("f1")))
    return moved.select(F.explode(F.array("p0", "p1")).alias(key)).filter(F.col(key).isNotNull()).distinct()


def incremental(parents: DataFrame, children: DataFrame, key: str, affected: DataFrame) -> DataFrame:
    """Recomputes the affected parents only; the others keep their flag."""
    redone = rolled_up(parents.join(affected, key, "left_semi"), children.join(affected, key, "left_semi"), key)
    return parents.join(affected, key, "left_anti").unionByName(redone)
