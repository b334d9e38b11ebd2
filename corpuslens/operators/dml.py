"""Changes to tables as derived versions: inserts, partial updates, upserts, cascading deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.relational import numbered


def insert(base: DataFrame, new: DataFrame, key: str, ordinal: str) -> DataFrame:
    """base and new rows; new keys continue after the greatest key, in the order of `ordinal`."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    fresh = numbered(new, ordinal).crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("row_no")).cast(base.schema[key].dataType)).drop("_top", "row_no", ordinal)
    return base.unionByName(fresh, allowMissingColumns=True)


def split_valid(rows: DataFrame, rule) -> tuple[DataFrame, DataFrame]:
    """(good, dead-letter) rows by a condition; null counts as bad."""
    good = F.coalesce(rule, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def collapse_updates(updates: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One update for each key: by field, the last one that is set wins."""
    fields = [c for c in updates.columns if c not in (key, ordinal)]
    return updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal))).alias(c) for c in fields])


def merge_update(base: DataFrame, updates: DataFrame, key: str, stamp: str | None = None, now=None) -> DataFrame:
    """base with the fields set in updates (one row a key); null means unchanged; unknown keys are ignored.

    stamp: a time column that is set to `now` where any field was supplied.
    """
    fields = [c for c in updates.columns if c != key and c in base.columns]
    side = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = base.join(side, key, "left")
    any_set = F.coalesce(*[F.when(F.col(f"_new_{c}").isNotNull(), F.lit(True)) for c in fields], F.lit(False))
    changes = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields}
    if stamp:
        changes[stamp] = F.when(any_set, F.current_timestamp() if now is None else now).otherwise(F.col(stamp))
    return out.withColumns(changes).select(*base.columns)


def changed_rows(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of after that differ from before in a field: writes that are no-ops are left out."""
    old = before.select(key, *[F.col(c).alias(f"_old_{c}") for c in fields])
    differs = [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in fields]
    condition = differs[0]
    for d in differs[1:]:
        condition = condition | d
    return after.join(old, key).filter(condition).select(*after.columns)


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows replace old ones with their key; an empty `new` changes nothing."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def merge_payload(vectors: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Sets payload fields by id; others stay."""
    side = updates.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    kept = [f.name for f in vectors.schema["payload"].dataType.fields]
    new = F.struct(*[(F.coalesce(F.col(f"_new_{c}"), F.col(f"payload.{c}")) if c in fields else F.col(f"payload.{c}")).alias(c) for c in kept])
    return vectors.join(side, "id", "left").withColumn("payload", new).select(*vectors.columns)


def delete_cascade(tables: dict[str, DataFrame], root: str, keys: DataFrame, tree) -> dict[str, DataFrame]:
    """tables without the rows of `root` whose key is in keys, and without all their descendants."""
    out, gone, name = dict(tables), keys, root
    for parent, child, link, child_key in tree:
        if parent == name:
            out[parent] = out[parent].join(gone, gone.columns[0], "left_anti") if parent == root else out[parent]
            lost = tables[child].join(gone.withColumnRenamed(gone.columns[0], link), link, "left_semi").select(child_key)
            out[child] = tables[child].join(gone.withColumnRenamed(gone.columns[0], link), link, "left_anti")
            gone, name = lost, child
    if name == root:
        out[root] = out[root].join(gone, gone.columns[0], "left_anti")
    return out


def get_or_create(existing: DataFrame, seen: DataFrame, ordinal: str) -> DataFrame:
    """Repositories of seen (name, label, ordinal) that do not exist yet: the first label of each name wins."""
    first = seen.groupBy("name").agg(F.min_by("label", ordinal).alias("label"), F.min(ordinal).alias(ordinal))
    return first.join(existing.select("name"), "name", "left_anti")
