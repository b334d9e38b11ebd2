"""Sources and sinks of the engine: source trees, annotator outputs, requests, caches, models."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.code import SUFFIXES, ascii_literals
from corpuslens.functions.text import normalize_eol, repository_and_label


def list_tree(root: str, suffixes: set[str] | None = None) -> Iterator[str]:
    """Relative paths of files with a known suffix (case-sensitive), without `._*` files; hidden and `_*` names count."""
    wanted = tuple(f".{s}" for s in (SUFFIXES if suffixes is None else suffixes))
    for folder, _, names in os.walk(root):
        for name in sorted(names):
            if name.endswith(wanted) and not name.startswith("._"):
                yield os.path.relpath(os.path.join(folder, name), root)


def decode(data: bytes) -> str:
    """UTF-8 where valid, else Latin-1; without NULs; literals without characters beyond ASCII."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return ascii_literals(text.replace("\x00", ""))


def scan_sources(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """path, repository, label, language, filename, source, error of a tree on a file system all executors see.

    Paths are listed on the driver (Spark's own listing skips `_*` names); contents are read on the executors.
    """
    import pandas as pd

    paths = spark.createDataFrame([(p,) for p in list_tree(root)], "path string")
    if partitions:
        paths = paths.repartition(partitions)

    def read(batches):
        for pdf in batches:
            sources, errors = [], []
            for p in pdf["path"]:
                try:
                    sources.append(decode(Path(root, p).read_bytes()))
                    errors.append(None)
                except OSError as error:
                    sources.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"path": pdf["path"], "source": sources, "error": errors})

    rows = paths.mapInPandas(read, "path string, source string, error string")
    repository, label = repository_and_label(F.col("path"), os.path.basename(os.path.normpath(root)))
    return with_language(rows.withColumns({"repository": repository, "label": label, "filename": F.substring_index("path", "/", -1), "source": normalize_eol(F.col("source"))}))


def with_language(files: DataFrame) -> DataFrame:
    """files with the language of their lower-cased suffix; others are left out."""
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    suffix = F.lower(F.substring_index("filename", ".", -1))
    return files.withColumn("language", F.try_element_at(known, suffix)).filter(F.col("language").isNotNull())


def read_jsonl(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, value: non-blank lines of *.jsonl files that hold a JSON object."""
    return jsonl_lines(spark, folder, recursive)[0]


def jsonl_lines(spark: SparkSession, folder: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(path, value) of the non-blank lines of *.jsonl files that hold a JSON object, and of those that don't (dead letters)."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower())
    lines = reader.text(folder).select(F.input_file_name().alias("path"), "value").filter(F.trim("value") != "")
    fine = F.get_json_object("value", "$").isNotNull()
    return lines.filter(fine), lines.filter(~fine)


def response_texts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, output) of batch responses, and the lines that hold none (dead letters; they stop nothing)."""
    rows = lines.withColumn("output", F.get_json_object("value", "$.response.body.output[1].content[0].text"))
    return rows.filter("output is not null").select("path", "output"), rows.filter("output is null").select("path", "value")


def cached_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """snippet_id, items (description, tag) of functionalities_<id>.json files; empty arrays count."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "functionalities_*.json").text(folder)
    kind = "array<struct<description:string,tag:string>>"
    return text.select(F.regexp_extract(F.input_file_name(), r"functionalities_(\d+)\.json$", 1).cast("int").alias("snippet_id"), F.coalesce(F.from_json("value", kind), F.array().cast(kind)).alias("items"))


def write_cache(functionalities: DataFrame, path: str) -> None:
    """A JSON array of each snippet's functionalities, in order, partitioned by snippet."""
    rows = functionalities.groupBy("snippet_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "description", "tag"))).alias("f"))
    rows.select("snippet_id", F.to_json(F.transform("f", lambda x: F.struct(x["description"].alias("description"), x["tag"].alias("tag")))).alias("value")).write.partitionBy("snippet_id").text(path)


def appended_functions(functions: DataFrame) -> DataFrame:
    """path, source of a function corpus (repository_name `owner/repo`, func_path, ordinal, code): bodies joined as one file."""
    body = F.concat(normalize_eol(F.col("code")), F.lit("\n\n"))
    path = F.concat_ws("/", F.lit("benign"), F.substring_index("repository_name", "/", -1), F.col("func_path"))
    return functions.select(path.alias("path"), "ordinal", body.alias("body")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "body"))).alias("b")).select("path", F.array_join(F.transform("b", lambda x: x["body"]), "").alias("source"))


def load_config(path: str) -> dict:
    """A YAML (where a reader is installed) or JSON configuration."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text) or {}


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_kmeans(path: str):
    from pyspark.ml.clustering import KMeansModel

    return KMeansModel.load(path)


def load_classifier(path: str):
    from pyspark.ml.classification import LogisticRegressionModel

    return LogisticRegressionModel.load(path)
