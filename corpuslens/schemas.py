"""Schemas of the engine's tables and the binary label rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FloatType, IntegerType, LongType, StringType, StructType, TimestampType

KINDS = {"int": IntegerType, "bigint": LongType, "string": StringType, "boolean": BooleanType, "timestamp": TimestampType}


def struct(text: str, **nested: DataType) -> StructType:
    """A schema of `name kind` fields; `!` marks those that are never null. Needs no session."""
    out = StructType()
    for part in text.split(", "):
        name, kind = part.split(" ")
        out.add(name, KINDS[kind.rstrip("!")](), nullable=not kind.endswith("!"))
    for name, kind in nested.items():
        out.add(name, kind)
    return out


STAMPS = "created_at timestamp, updated_at timestamp"
REPOSITORIES = struct(f"repository_id int!, name string!, label string, processed boolean, split string, {STAMPS}")
FILES = struct(f"file_id int!, repository_id int!, language string, filename string, filepath string, processed boolean, {STAMPS}")
SNIPPETS = struct(f"snippet_id int!, file_id int!, start_line int, end_line int, code string, processed boolean, {STAMPS}")
FUNCTIONALITIES = struct(f"functionality_id int!, snippet_id int!, description string, tag string, cluster_id int, {STAMPS}")
VECTORS = struct("id bigint!", vector=ArrayType(FloatType()), payload=struct("repository_id int, split string, tag string"))
EXTENDED_SNIPPETS = struct("snippet_id int, file_id int, code string, start_line int, end_line int, processed boolean, language string, filename string, filepath string, repository_id int")
CODE_SEARCH_SNIPPETS = struct("repository string, filepath string, start_line int, end_line int, code string, functionality string")
PREDICTIONS = struct("repository_id int, method string, classification string, justification string", flags_json=ArrayType(StringType()))
#: parent table -> (child table, foreign key, child key), from the root down.
TREE = (("repositories", "files", "repository_id", "file_id"), ("files", "snippets", "file_id", "snippet_id"), ("snippets", "functionalities", "snippet_id", "functionality_id"))
#: The binary classes by index.
LABELS = {0: "benign", 1: "malicious"}


def label_map(config=None) -> dict[int, str]:
    """{index: name} from a dict or a list of one-key dicts; anything unusable gives the fixed classes."""
    try:
        pairs = config.items() if isinstance(config, dict) else [next(iter(x.items())) for x in config]
        return {int(k): str(v) for k, v in pairs} or dict(LABELS)
    except (AttributeError, TypeError, ValueError, StopIteration):
        return dict(LABELS)


def binary_label(label: Column) -> Column:
    """benign stays benign; everything else, null too, is malicious."""
    return F.when(label.eqNullSafe(F.lit("benign")), F.lit("benign")).otherwise(F.lit("malicious"))
