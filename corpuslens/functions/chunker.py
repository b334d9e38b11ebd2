"""Token-budgeted chunks of source code that end before definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from corpuslens.functions.code import count_tokens, important_lines, scrub_blobs, strip_comments

LineAnalyzer = Callable[[str, str], tuple[list[int], list[int]]]


def cut_rows(definitions: list[int], comments: list[int]) -> list[int]:
    """Rows before which a chunk may end: definitions, moved above the comments that precede them (to row 1 at most); never row 0."""
    above = set(comments)
    out = set()
    for row in definitions:
        while row >= 2 and row - 1 in above:
            row -= 1
        out.add(row)
    return sorted(r for r in out if r > 0)


def chunk_code(code: str, language: str, max_tokens: int = 100, remove_comments: bool = True, counter: Callable[[str], int] = count_tokens, analyzer: LineAnalyzer = important_lines) -> Iterator[tuple[int, str, int, int]]:
    """(number from 0, code, first line, last line), lines counted from 1.

    Lines join the chunk while the budget lasts. When a line does not fit, the
    chunk ends before the last cut row at or above it; without one, the line is
    taken anyway. Lines between that row and the line go into the next chunk
    without being counted.
    """
    lines = code.split("\n")
    cuts = cut_rows(*analyzer(code, language))
    state = {"no": -1}

    def emit(a: int, b: int):
        text = "\n".join(lines[a:b])
        if remove_comments:
            text = strip_comments(text, language)
        text = "\n".join(x for x in text.splitlines() if x.strip()).strip()
        if text:
            state["no"] += 1
            yield state["no"], text, a + 1, b

    start = budget = at = 0
    for i in range(len(lines)):
        lines[i] = scrub_blobs(lines[i])
        tokens = counter(lines[i])
        if budget + tokens > max_tokens:
            while at < len(cuts) and cuts[at] <= i + 1:
                at += 1
            if at and cuts[at - 1] > start:
                yield from emit(start, cuts[at - 1])
                start, budget = cuts[at - 1], 0
        # a line that no cut makes room for is taken anyway
        budget += tokens
    last = next((k for k in range(len(lines) - 1, -1, -1) if lines[k].strip()), len(lines) - 1)
    if start <= last:
        yield from emit(start, last + 1)


def chunk_udtf(**options):
    """A table function (code, language) -> chunk_no, code, start_line, end_line, for lateral joins."""
    from pyspark.sql.functions import udtf

    class Chunks:
        def eval(self, code: str, language: str):
            if code is not None and language is not None:
                yield from chunk_code(code, language, **options)

    return udtf(Chunks, returnType="chunk_no int, code string, start_line int, end_line int")


def chunk_files(files, max_tokens: int = 100, key: str = "file_id", partitions: int | None = None):
    """(chunks, failed): chunks of files (key, language, source), and files whose chunking failed, with the error.

    A failed file gives no chunk at all. The two results are filters of one plan:
    write it first where both are wanted. partitions: deals the files out anew,
    for a few large input files that would make as many tasks.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for k, language, source in zip(pdf[key], pdf["language"], pdf["source"], strict=True):
                try:
                    rows += [(k, *c, None) for c in chunk_code(source or "", language, max_tokens)]
                except Exception as error:  # noqa: BLE001  the dead-letter column names it
                    rows.append((k, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "code", "start_line", "end_line", "error"])

    rows = files.select(key, "language", "source")
    out = (rows.repartition(partitions, key) if partitions else rows).mapInPandas(run, f"{key} long, chunk_no int, code string, start_line int, end_line int, error string")
    return out.filter("error is null").drop("error"), out.filter("error is not null").select(key, "error")
