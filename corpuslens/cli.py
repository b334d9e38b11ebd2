"""Command line: the engine's stages over Parquet tables in a work folder.

    python -m corpuslens.cli load ROOT WORK
    python -m corpuslens.cli prompts WORK OUT [--model M]
    python -m corpuslens.cli annotate WORK
    python -m corpuslens.cli ingest WORK FOLDER        (responses as JSONL)
    python -m corpuslens.cli load-cache WORK FOLDER    (functionalities_<id>.json)
    python -m corpuslens.cli split WORK [--test 0.3]
    python -m corpuslens.cli cluster WORK {search,train,test} [-k K]
    python -m corpuslens.cli classify WORK {train,test} [-k K]
    python -m corpuslens.cli train|test WORK -k K      (cluster, then classify)
"""

from __future__ import annotations

import argparse
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.functions import chunker, code
from corpuslens.operators import annotate, classify, dml, encode, prompts, relational, rollup, splits, vectors
from corpuslens.sources import files as sources

TABLES = {"repositories": schemas.REPOSITORIES, "files": schemas.FILES, "snippets": schemas.SNIPPETS, "functionalities": schemas.FUNCTIONALITIES, "vectors": schemas.VECTORS}


class Store:
    """Versions of each table in a folder. Staged versions become current together, when commit replaces the one file that names them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.staged: dict[str, str] = {}

    def current(self) -> dict[str, str]:
        pointer = self.folder / "current.json"
        return json.loads(pointer.read_text()) if pointer.exists() else {}

    def read(self, name: str) -> DataFrame:
        version = self.current().get(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(self.folder / version))

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes a version that is not current yet, and gives it."""
        schema = TABLES[name]
        known = set(rows.columns)
        version = f"{name}-{uuid.uuid4().hex[:12]}"
        rows.select(*[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(str(self.folder / version))
        self.staged[name] = version
        return self.spark.read.schema(schema).parquet(str(self.folder / version))

    def commit(self) -> None:
        pointer = self.folder / "current.json.new"
        pointer.write_text(json.dumps(self.current() | self.staged))
        pointer.rename(self.folder / "current.json")
        self.staged = {}

    def write(self, name: str, rows: DataFrame) -> None:
        self.stage(name, rows)
        self.commit()


def load(spark: SparkSession, root: str, store: Store, max_tokens: int = 100) -> None:
    """A source tree -> repositories, files, snippets. A file that can't be chunked leaves no row."""
    scanned = sources.scan_sources(spark, root).filter("error is null").withColumn("path_id", F.xxhash64("path"))
    old = store.read("repositories")
    names = dml.get_or_create(old, scanned.select(F.col("repository").alias("name"), "label", F.col("path").alias("at")), "at")
    repositories = store.stage("repositories", dml.insert(old, names.withColumns({"processed": F.lit(False), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}), "repository_id", "at"))
    ids = repositories.select("repository_id", F.col("name").alias("repository"))
    chunks, failed = chunker.chunk_files(scanned.select(F.col("path_id").alias("file_id"), "language", "source"), max_tokens)
    good = scanned.join(failed.select(F.col("file_id").alias("path_id")), "path_id", "left_anti").join(ids, "repository")
    before = store.read("files")
    new = good.select("repository_id", "language", "filename", F.col("path").alias("filepath"), F.lit(False).alias("processed"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"), F.col("path").alias("at"))
    known = before.select("filepath")
    files = store.stage("files", dml.insert(before, new.join(known, "filepath", "left_anti"), "file_id", "at"))
    owners = files.join(before.select("file_id"), "file_id", "left_anti").select(F.col("file_id").alias("owner"), F.xxhash64("filepath").alias("file_id"))
    rows = chunks.join(owners, "file_id").select(F.col("owner").alias("file_id"), "start_line", "end_line", "code", F.lit(False).alias("processed"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"), F.struct("owner", "chunk_no").alias("at"))
    store.stage("snippets", dml.insert(store.read("snippets"), rows, "snippet_id", "at"))
    store.commit()


def pending_prompts(store: Store, per_prompt: int) -> DataFrame:
    rows = relational.pending_snippets_with_meta(store.read("snippets"), store.read("files"))
    return prompts.prompt_batches(prompts.snippet_blocks(rows), per_prompt)


def store_annotations(store: Store, annotations: DataFrame) -> None:
    """New functionalities, then processed flags up to the repositories, committed together. Doing it twice changes nothing."""
    snippets = store.read("snippets")
    found = annotate.new_functionalities(annotations, snippets, normalize=code.mapped(code.normalize_tag, "string")).withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "at": F.struct("snippet_id", "ordinal")}).drop("ordinal")
    store.stage("functionalities", dml.insert(store.read("functionalities"), found, "functionality_id", "at"))
    done = annotate.mark_processed(snippets, annotations)
    files, repositories = rollup.backfill(store.read("repositories"), store.read("files"), done)
    store.stage("snippets", done)
    store.stage("files", files)
    store.stage("repositories", repositories)
    store.commit()


def split(store: Store, test: float) -> None:
    """Embeds all functionalities, splits repositories by label, and tells the vectors."""
    owned = relational.functionalities_by_repository(store.read("functionalities"), store.read("snippets"), store.read("files"))
    embedded = vectors.embed(owned.select(F.col("functionality_id").alias("id"), "tag"))
    payload = owned.select(F.col("functionality_id").cast("long").alias("id"), F.struct("repository_id", F.lit("full").alias("split"), "tag").alias("payload"))
    fresh = vectors.l2_normalized(embedded).withColumn("vector", F.col("vector").cast("array<float>")).join(payload, "id")
    parts = splits.stratified_split(store.read("repositories").drop("split"), "repository_id", "label", test)
    store.stage("vectors", splits.propagate_split(store.stage("repositories", parts), dml.upsert(store.read("vectors"), fresh, "id")))
    store.commit()


def cluster(store: Store, mode: str, k: int | None) -> None:
    place = str(store.folder / "kmeans")
    rows = store.read("vectors")
    if mode == "search":
        print(vectors.run_clustering(rows, "search")[0])
        return
    model, assigned = vectors.run_clustering(rows, mode, k, sources.load_kmeans(place) if mode == "test" else None)
    if mode == "train":
        sources.save_model(model, place)
    update = assigned.select(F.col("id").cast("int").alias("functionality_id"), F.col("cluster").alias("cluster_id"))
    store.write("functionalities", dml.merge_update(store.read("functionalities"), update, "functionality_id", "updated_at"))


def classify_repositories(store: Store, mode: str, k: int) -> None:
    place = str(store.folder / "classifier")
    counts = relational.cluster_counts(store.read("functionalities"), store.read("snippets"), store.read("files"))
    rows = relational.with_binary_label(store.read("repositories").filter("processed").select("repository_id", "label", "split"))
    shares = encode.frobenius_scaled(encode.percentages(encode.validated(counts, k)))
    features = encode.sparse_features(rows.withColumn("y", encode.label_index(F.col("label")).cast("double")), shares, k)
    if mode == "train":
        sources.save_model(classify.fit(features.filter("split = 'train'")), place)
        return
    said = classify.predict(sources.load_classifier(place), features.filter("split = 'test'"))
    judged = said.select(encode.label_index(F.col("label")).alias("truth"), encode.label_index(F.col("prediction")).alias("pred"), "score")
    sources.write_json(said, str(store.folder / "predictions"))
    for name, part in classify.evaluate(judged, score="score").items():
        sources.write_json(part, str(store.folder / "metrics" / name))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in {"load": ["root", "work"], "prompts": ["work", "out"], "annotate": ["work"], "ingest": ["work", "folder"], "load-cache": ["work", "folder"], "split": ["work"], "cluster": ["work", "mode"], "classify": ["work", "mode"], "train": ["work"], "test": ["work"]}.items():
        command = commands.add_parser(name)
        for x in extra:
            command.add_argument(x)
        command.add_argument("-k", type=int, default=10)
        command.add_argument("--test", type=float, default=0.3)
        command.add_argument("--model", default="model")
    given = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, given.work)
    store.folder.mkdir(parents=True, exist_ok=True)
    match given.command:
        case "load":
            load(spark, given.root, store)
        case "prompts":
            prompts.write_requests(prompts.request_lines(pending_prompts(store, prompts.SNIPPETS_PER_PROMPT), given.model), given.out)
        case "annotate":
            made = pending_prompts(store, prompts.LIVE_BATCH).withColumn("prompt_no", F.col("file_no") * prompts.PROMPTS_PER_FILE + F.col("custom_no"))
            said = annotate.annotate(made, annotate.with_retry(annotate.rule_annotator)).filter("error is null")
            store_annotations(store, annotate.parsed(said, order=["prompt_no"]))
        case "ingest":
            store_annotations(store, annotate.parsed(sources.response_texts(sources.read_jsonl(spark, given.folder))[0], order=["path"]))
        case "load-cache":
            store_annotations(store, sources.cached_annotations(spark, given.folder))
        case "split":
            split(store, given.test)
        case "cluster":
            cluster(store, given.mode, given.k)
        case "classify":
            classify_repositories(store, given.mode, given.k)
        case _:
            cluster(store, given.command, given.k)
            classify_repositories(store, given.command, given.k)


if __name__ == "__main__":
    main()
