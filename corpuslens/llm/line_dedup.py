"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

Documents come in batches of ascending id, of about equal size by quantiles.
Their lines' hashes are written once, by batch. For each batch, the distinct
keys of its lines are merge-joined with the runs written so far: keys that no
run holds make the batch's own sorted run (an anti-join), the others learn
which document holds them first. Runs are tables bucketed and sorted by key, so
that a merge moves the batch's keys only and never a run. After `fanout` runs on
a level, they are merged into one run on the next level, bucket by bucket. A
line goes if an earlier document holds its key.

Defined results: a null text counts as one empty line; a null id sorts after
all others; rows that share an id count as one document, so they do not remove
each other's lines; lines whose key is shorter than `min_chars` code points
always stay; very long texts and lines are taken whole; an empty table gives an
empty table; further columns are kept (a clash with `n_lines`, `n_dropped` or
`kept_text` is overwritten).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Has a scan of a table of sorted buckets with a file each say that its rows are sorted.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
OUTPUT = ("n_lines", "n_dropped", "kept_text")


@contextmanager
def sorted_scans(spark: SparkSession):
    before = spark.conf.get(SORTED_SCANS, "false")
    spark.conf.set(SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCANS, before)


class LevelledRuns:
    """Sorted runs of (h1, h2) -> first id, as bucketed tables whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels, self.tables = spark, fanout, {0: []}, []
        #: As many buckets as a shuffle has partitions: a batch's aggregate then lies as the runs do.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _store(self, rows: DataFrame) -> str:
        name = f"corpuslens_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        with sorted_scans(self.spark), C.no_shuffle_left(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", C.scratch(self.spark, "run")).saveAsTable(name)
        return name

    def _run(self, name: str, first: str) -> DataFrame:
        return self.spark.table(name).filter("is_new").select("h1", "h2", F.col("first_id").alias(first)).hint("merge")

    def add(self, batch: DataFrame) -> DataFrame:
        """Joins the batch's keys (h1, h2, lo, hi) with the runs, writes its run, returns its keys with their first and last id."""
        names = [n for level in self.levels.values() for n in level]
        joined, found = batch, []
        for i, name in enumerate(names):
            found.append(f"run{i}")
            joined = joined.join(self._run(name, found[-1]), ["h1", "h2"], "left")
        first = F.coalesce(*found, F.lit(None).cast("long"))
        name = self._store(joined.select("h1", "h2", F.coalesce(first, F.col("lo")).alias("first_id"), F.col("hi").alias("last_id"), first.isNull().alias("is_new")))
        self.levels[0].append(name)
        self._compact()
        return self.spark.table(name)

    def _compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            merged = self._run(self.levels[level][0], "first_id")
            for name in self.levels[level][1:]:  # no key is in two runs
                merged = merged.join(self._run(name, "other"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("first_id", "other").alias("first_id")).hint("merge")
            self.levels[level] = []
            self.levels.setdefault(level + 1, []).append(self._store(merged.withColumn("is_new", F.lit(True))))
            level += 1

    def drop(self) -> None:
        """Takes the tables out of the session's catalog; their files go with the scratch folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_key(line: Column) -> Column:
    return C.lower_ascii(F.btrim(line, F.lit(C.SPACE)))


def identity(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(C.quoted(id_col).cast("long"), F.lit(C.MAX_LONG)), C.text_key(C.quoted(text_col))]


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line that could go: ord, tk (document), pos, h1, h2 (key)."""
    ord_, tk = identity(id_col, text_col)
    rows = docs.select(ord_.alias("ord"), tk.alias("tk"), F.posexplode_outer(F.split(C.no_nul(C.quoted(text_col)), "\n")).alias("pos", "line"))
    rows = rows.select("ord", "tk", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select("ord", "tk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, batches: int, fanout: int) -> DataFrame:
    """h1, h2, first_id of the keys that two documents hold. lines has a column `batch`."""
    runs, shared = LevelledRuns(lines.sparkSession, fanout), None
    try:
        for b in range(batches):
            keys = lines.filter(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
            got = runs.add(keys).filter("first_id < last_id").select("h1", "h2", "first_id")
            shared = got if shared is None else shared.unionByName(got)
        return C.written(shared.groupBy("h1", "h2").agg(F.min("first_id").alias("first_id")), "shared-lines")
    finally:
        runs.drop()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 3, fanout: int = 2, replace: bool = False) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; one row for each row of docs. replace: docs' own columns, with the kept text in place of the text."""
    ord_, tk = identity(id_col, text_col)
    shares = [i / batches for i in range(1, batches)]
    bounds = (docs.select(ord_.alias("ord")).agg(F.percentile_approx("ord", shares)).first()[0] or []) if shares else []
    batch = sum((F.when(F.col("ord") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    with C.temporary(docs.sparkSession) as keep:
        path = C.scratch(docs.sparkSession, "lines")
        lines_of(docs, id_col, text_col, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
        lines = docs.sparkSession.read.schema("ord long, tk long, pos int, h1 long, h2 long, batch int").parquet(path)
        shared = shared_lines(lines, batches, fanout)
        drops = lines.join(C.checked_broadcast(shared, 48), ["h1", "h2"]).filter("ord > first_id")
        drops = keep(C.written(drops.groupBy(F.col("ord").alias("_ld_ord"), F.col("tk").alias("_ld_tk")).agg(F.collect_set("pos").alias("_ld_drop")), "dropped-lines"))
    kept = [C.quoted(c) for c in (docs.columns if replace else C.others(docs, *OUTPUT))]
    joined = docs.select(*kept, *[C.quoted(c).alias("_ld_text") for c in [text_col]], ord_.alias("_ld_ord"), tk.alias("_ld_tk"))
    joined = joined.join(C.checked_broadcast(drops, 48, "_ld_drop"), ["_ld_ord", "_ld_tk"], "left")
    text = C.no_nul(F.col("_ld_text"))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    left = C.let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(x)), F.transform("_ld_drop", lambda p: p + 1)), lambda i: F.get(x, i - 1)), "\n"))
    n_dropped = F.greatest(F.coalesce(F.size("_ld_drop"), F.lit(0)), F.lit(0)).cast("long")
    kept_text = F.when(F.col("_ld_drop").isNull(), text).otherwise(left)
    if replace:
        return joined.select(*[kept_text.alias(c) if c == text_col else C.quoted(c) for c in docs.columns])
    return joined.select(*kept, n_lines.cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), kept_text.alias("kept_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos] AS line,
        regexp_replace(translate(regexp_replace(regexp_replace(ls[pos], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '$^', '') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
f AS (SELECT k, min(doc_id) AS first_id FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, pos, line, (f.k IS NOT NULL AND l.doc_id > f.first_id) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
