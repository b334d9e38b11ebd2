"""What the training-data operators share: tables, scratch space, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the bytes of [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
MAX_LONG = 2**63 - 1
#: A side of a join is broadcast only when it was written, counted and found smaller than this.
BROADCAST_BYTES = 32 << 20
#: Text that goes to a Python worker at once; Spark's own bound (64 MB) costs several times that in buffers.
ARROW_BYTES = 8 << 20
#: Has a query's shuffle files go as it ends; else they lie there until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths made within the innermost temporary().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most ARROW_BYTES, unless it sets a smaller bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) < ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            base = f"file://{tempfile.mkdtemp(prefix='corpuslens-')}"
            spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/corpuslens/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Writes within it leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut and any executor can read them."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    with no_shuffle_left(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


def drop(table: DataFrame) -> None:
    """Deletes a table that written() gave, and nothing else; no plan that is still to run may read it."""
    if path := vars(table).get("_scratch_path"):
        _delete(table.sparkSession, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables made within it go at its end, but for those of written() that went through the function it gives.

    What is kept belongs to the temporary() around it, where there is one.
    """
    kept, outer = set(), _made.get()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._scratch_path)
        return table

    token = _made.set([])
    try:
        yield keep
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def checked_broadcast(df: DataFrame, row_bytes: int | Column, items: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast of a written table if its counted size is under the limit; beyond it, Spark shuffles.

    row_bytes: an upper estimate for a row, or each row's own size; items: an array column whose elements count 8 bytes each.
    """
    size = F.coalesce(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes).cast("long")), F.lit(0))
    if items:
        size = size + F.coalesce(F.sum(F.size(items).cast("long")), F.lit(0)) * 8
    return F.broadcast(df) if df.agg(size).first()[0] <= limit else df


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *taken: str) -> list[str]:
    """df's columns but for those that clash with the names taken (names do not tell cases apart)."""
    gone = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in gone]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, in one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def no_nul(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(no_nul(text))


def ascii_words(text: Column) -> Column:
    """The maximal runs of [^\\x20\\x09-\\x0D]; none for null."""
    return F.filter(F.split(F.btrim(no_nul(text), F.lit(SPACE)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
