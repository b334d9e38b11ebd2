"""Annotators (any function from a prompt to `id: a; b` lines), retries, and storing what they say."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.functions.text import parsed_annotations

Annotator = Callable[[str], str]


def rule_annotator(prompt: str) -> str:
    """An offline annotator: names what a snippet's calls suggest."""
    known = {"open": "Open file", "read": "Read data", "write": "Write data", "connect": "Connect to server", "send": "Send data", "exec": "Run command", "system": "Run command", "encrypt": "Encrypt data", "decrypt": "Decrypt data"}
    out = []
    for block in re.split(r"(?m)^(?=Snippet ID: )", prompt):
        found = re.match(r"Snippet ID: (\d+)", block)
        if found:
            said = [v for k, v in known.items() if re.search(rf"\b\w*{k}\w*\b", block.split("--- Begin Code ---")[-1])]
            out.append(f"{found[1]}: {'; '.join(dict.fromkeys(said)) or 'None'}")
    return "\n".join(out)


def chat_annotator(post: Callable[[dict], dict], model: str) -> Annotator:
    """An annotator behind a chat endpoint; post sends a request body and returns the answer."""

    def ask(prompt: str) -> str:
        answer = post({"model": model, "messages": [{"role": "user", "content": prompt}]})
        choices = answer.get("choices")
        return choices[0]["message"]["content"] if choices else str(answer)

    return ask


def annotator(provider: str, model: str = "", post: Callable[[dict], dict] | None = None) -> Annotator:
    """By provider: rules (offline), or any endpoint for which a post function is given."""
    if provider == "rules":
        return rule_annotator
    if post is None:
        raise ValueError(f"provider {provider} needs a post function")
    return chat_annotator(post, model)


def delays(first: float = 1.0, backoff: float = 1.5, most: float = 60.0, jitter: float = 0.1, draw: Callable[[], float] = random.random) -> Iterator[float]:
    """Waiting times: capped, with jitter, each 1.5 times the last."""
    now = first
    while True:
        yield min(now, most) * (1 + jitter * (2 * draw() - 1))
        now = min(now * backoff, most)


def with_retry(call: Callable[[str], str], attempts: int = 10, sleep: Callable[[float], None] = time.sleep, **options) -> Callable[[str], str]:
    def retried(prompt: str) -> str:
        for n, wait in enumerate(delays(**options), 1):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001  any failure of the endpoint is tried again
                if n >= attempts:
                    raise
                sleep(wait)
        raise AssertionError

    return retried


def annotate(prompts: DataFrame, call: Annotator, key: str = "prompt_no") -> DataFrame:
    """key, output, error: what the annotator says to each prompt; a failure fills error and stops no other batch."""

    def run(batches):
        for pdf in batches:
            said, errors = [], []
            for prompt in pdf["prompt"]:
                try:
                    said.append(call(prompt))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  kept as the batch's status
                    said.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pdf[[key]].assign(output=said, error=errors)

    return prompts.select(F.col(key).cast("long").alias(key), "prompt").mapInPandas(run, f"{key} long, output string, error string")


def parsed(outputs: DataFrame, column: str = "output", order: list[str] | None = None) -> DataFrame:
    """snippet_id, items of annotator outputs; of several lines with an id, the last wins (in the order of `order`, then lines)."""
    lines = outputs.select(*(order or []), F.explode(parsed_annotations(F.col(column))).alias("x"))
    at = F.struct(*[F.col(c) for c in order or []], F.col("x.pos"))
    return lines.groupBy(F.col("x.snippet_id").alias("snippet_id")).agg(F.max_by("x.items", at).alias("items"))


def new_functionalities(annotations: DataFrame, snippets: DataFrame, skip_processed: bool = True, normalize=None) -> DataFrame:
    """snippet_id, ordinal, description, tag: distinct items in the order they came; known snippets only.

    Items are descriptions, or structs (description, tag) whose tags are kept;
    tags that are missing come from normalize (lower case without one).
    skip_processed makes storing the same answers twice change nothing.
    """
    open_ones = snippets.filter(~F.col("processed")) if skip_processed else snippets
    rows = annotations.join(open_ones.select("snippet_id"), "snippet_id", "left_semi")
    out = rows.select("snippet_id", F.posexplode(F.array_distinct("items")).alias("ordinal", "item"))
    tagged = isinstance(annotations.schema["items"].dataType.elementType, StructType)
    out = out.select("snippet_id", "ordinal", F.col("item.description" if tagged else "item").alias("description"), (F.col("item.tag") if tagged else F.lit(None).cast("string")).alias("_tag"))
    made = F.lower("description") if normalize is None else normalize(F.col("description"))
    return out.select("snippet_id", "ordinal", "description", F.coalesce("_tag", made).alias("tag"))


def mark_processed(snippets: DataFrame, annotations: DataFrame) -> DataFrame:
    """snippets with processed set for every annotated id, also for those without items."""
    done = annotations.select("snippet_id", F.lit(True).alias("_done")).distinct()
    return snippets.join(done, "snippet_id", "left").withColumn("processed", F.coalesce("_done", "processed")).select(*snippets.columns)
