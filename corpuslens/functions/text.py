"""Text functions as column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest snippet shown in a prompt, in lines.
MAX_LINES = 400


def normalize_eol(text: Column) -> Column:
    """CRLF and CR become LF; the text ends with LF."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(lf.endswith("\n"), lf).otherwise(F.concat(lf, F.lit("\n")))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space (of any script) become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def drop_blank_lines(text: Column) -> Column:
    kept = F.filter(F.split(text, "\r\n|[\n\r\x0b\x0c]"), lambda x: F.trim(F.regexp_replace(x, "(?U)\\s+", " ")) != "")
    return F.regexp_replace(F.array_join(kept, "\n"), "(?U)^\\s+|\\s+$", "")


def remove_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x00-\\x7F]+", "")


def truncate_lines(text: Column, most: int = MAX_LINES) -> Column:
    """The first `most` lines and a marker with the number of all lines."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    marker = F.concat(F.lit("\n... [truncated, total lines: "), F.size(lines).cast("string"), F.lit("]"))
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), marker)).otherwise(text)


def function_name(code: Column) -> Column:
    """The first name followed by a parameter list and a brace, else unknown."""
    name = F.regexp_extract(code, r"\b([a-zA-Z_]\w*)\s*\([^;{]*\)\s*\{", 1)
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def decode_bytes(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1; without NULs."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return remove_nul(text)


def collection_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def snippet_id_of_file(path: Column) -> Column:
    """The id in .../functionalities_<id>.json."""
    return F.regexp_extract(path, r"functionalities_(\d+)\.json$", 1).try_cast("int")


def repository_and_label(relative: Column, root_name: str) -> tuple[Column, Column]:
    """(repository, label) of a path: label/repository/...; shorter paths take the root's name twice."""
    parts = F.filter(F.split(relative, "/"), lambda p: p != "")
    deep = F.size(parts) >= 2
    return F.when(deep, F.get(parts, F.lit(1))).otherwise(F.lit(root_name)), F.when(deep, F.get(parts, F.lit(0))).otherwise(F.lit(root_name))


def parsed_annotations(output: Column) -> Column:
    """array<struct<pos, snippet_id, items>> of `id: a; b` lines; bad lines are left out; a lone none gives no items."""
    lines = F.transform(F.split(output, "\r\n|[\n\r]"), lambda line, i: F.struct(i.alias("pos"), F.trim(line).alias("line")))
    good = F.filter(lines, lambda x: F.regexp_like(x["line"], F.lit(r"^\s*[+-]?\d{1,9}\s*:")))

    def parse(x: Column) -> Column:
        items = F.filter(F.transform(F.split(F.regexp_replace(x["line"], "^[^:]*:", ""), ";"), lambda i: F.trim(i)), lambda i: i != "")
        lone = (F.size(items) == 1) & (F.lower(F.get(items, F.lit(0))) == "none")
        return F.struct(x["pos"].alias("pos"), F.trim(F.substring_index(x["line"], ":", 1)).cast("int").alias("snippet_id"), F.when(lone, F.array().cast("array<string>")).otherwise(items).alias("items"))

    return F.transform(good, parse)


def report_sections(text: Column) -> Column:
    """array<struct<chunk, sentences>> of an older report: `**Chunk N**` sections with sentences after `Functionalities:`."""
    sections = F.regexp_extract_all(text, F.lit(r"(?s)\*\*Chunk \d+\*\*.*?(?=\*\*Chunk \d+\*\*|$)"), F.lit(0))

    def parse(s: Column) -> Column:
        said = F.trim(F.regexp_extract(s, r"(?s)Functionalities:\s*(.+)", 1))
        return F.struct(F.concat(F.lit("Chunk "), F.regexp_extract(s, r"\*\*Chunk (\d+)\*\*", 1)).alias("chunk"), F.filter(F.split(said, r"(?<=[.!?])\s+"), lambda x: x != "").alias("sentences"))

    return F.transform(sections, parse)


def list_line(label: str, items: Column) -> Column:
    return F.concat(F.lit(f"  - {label}: "), F.when(F.size(items) == 0, F.lit("None")).otherwise(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))))


def prompt_block(snippet_id: Column, path: Column, language: Column, code: Column, calls: Column, controls: Column) -> Column:
    """A snippet's block of a prompt. Its headings."""
    shown = F.regexp_replace(truncate_lines(strip_non_ascii(code)), "^\\s+|\\s+$", "")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Snippet ID: "), snippet_id.cast("string")),
        F.concat(F.lit("File: "), path),
        F.concat(F.lit("Function: "), function_name(code)),
        F.concat(F.lit("Language: "), language),
        F.lit("AST Elements:"),
        list_line("Function Calls", calls),
        list_line("Control Structures", controls),
        F.lit(""),
        F.lit("--- Begin Code ---"),
        shown,
        F.lit("--- End Code ---"),
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Zero-based place of the greatest value; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
