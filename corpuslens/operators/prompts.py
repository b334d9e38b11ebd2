"""Prompts for annotators: snippet blocks, two-level batches, request files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpuslens.functions.code import SPECS, syntax_elements
from corpuslens.functions.text import prompt_block
from corpuslens.operators.relational import numbered

#: Sizes and names of request batches.
SNIPPETS_PER_PROMPT, PROMPTS_PER_FILE, LIVE_BATCH = 20, 500, 50
REQUEST_URL, CACHE_KEY = "/v1/responses", "functionality_analysis_v1"

TEMPLATE = """Describe what each of the code snippets below does.

Give one line for each snippet: its id, a colon, and short goal-oriented actions separated by semicolons.
Write None if a snippet does nothing of note.

Format:
<snippet_id>: <functionality 1>; <functionality 2>

${code_snippets}
"""


def syntax_columns(rows: DataFrame) -> DataFrame:
    """rows (code, language) with calls and controls, by an Arrow function; unknown languages are left out."""

    @pandas_udf("calls array<string>, controls array<string>")
    def elements(code: pd.Series, language: pd.Series) -> pd.DataFrame:
        found = [syntax_elements(c or "", x)[:2] for c, x in zip(code, language, strict=True)]
        return pd.DataFrame({"calls": [f[0] for f in found], "controls": [f[1] for f in found]})

    known = rows.filter(F.col("language").isin(list(SPECS)))
    return known.withColumn("_e", elements("code", "language")).withColumns({"calls": F.col("_e.calls"), "controls": F.col("_e.controls")}).drop("_e")


def prompt_batches(blocks: DataFrame, per_prompt: int = SNIPPETS_PER_PROMPT, per_file: int = PROMPTS_PER_FILE, template: str = TEMPLATE) -> DataFrame:
    """file_no, custom_no (restarts at 1 in each file), prompt, snippet_ids of blocks (snippet_id, block), in id order."""
    placed = numbered(blocks, "snippet_id").withColumn("prompt_no", F.floor((F.col("row_no") - 1) / per_prompt))
    joined = placed.groupBy("prompt_no").agg(F.array_sort(F.collect_list(F.struct("snippet_id", "block"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    prompt = text
    for mark in ("${code_snippets}", "{code_snippets}"):
        if mark in template:
            before, after = template.split(mark, 1)
            prompt = F.concat(F.lit(before), text, F.lit(after))
            break
    return joined.select(F.floor(F.col("prompt_no") / per_file).cast("int").alias("file_no"), (F.col("prompt_no") % per_file + 1).cast("int").alias("custom_no"), prompt.alias("prompt"), F.transform("b", lambda x: x["snippet_id"]).alias("snippet_ids"))


def request_lines(prompts: DataFrame, model: str) -> DataFrame:
    """file_no, custom_no, value: one JSON request a prompt."""
    body = F.struct(F.lit(model).alias("model"), F.col("prompt").alias("input"), F.lit(CACHE_KEY).alias("prompt_cache_key"))
    record = F.struct(F.concat(F.lit("snippets_batch_"), F.col("custom_no").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit(REQUEST_URL).alias("url"), body.alias("body"))
    return prompts.select("file_no", "custom_no", F.to_json(record).alias("value"))


def write_requests(lines: DataFrame, path: str) -> None:
    """A folder for each file number with its requests in order."""
    lines.repartition("file_no").sortWithinPartitions("file_no", "custom_no").select("file_no", "value").write.partitionBy("file_no").text(path)


def snippet_blocks(snippets: DataFrame) -> DataFrame:
    """snippet_id, block of extended snippets (snippet_id, filepath, language, code)."""
    rows = syntax_columns(snippets)
    return rows.select("snippet_id", prompt_block(F.col("snippet_id"), F.col("filepath"), F.col("language"), F.col("code"), F.col("calls"), F.col("controls")).alias("block"))
