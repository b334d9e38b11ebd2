"""Substring dedup by repeated-phrase automata.

Recurring passages are confirmed word by word within the shards that the
repeat finder deals out: a span that comes twice as a whole, or a window of
which the shard holds two. Each shard compiles its confirmed phrases into an
Aho-Corasick automaton and streams its documents' spans through it; a shard
gets every span of any document that could hold one of its phrases, and no
other. Automata stay bounded by the shard size.

Defined results: null and empty texts have no words and keep the empty text;
texts shorter than a window lose nothing; repeated rows are copies and lose
all their windows; ties do not matter, as all copies go; an empty table gives
an empty table; further columns are kept (a clash with n_words, n_removed or
kept_text is overwritten).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .repeats import Kind, Span, removed_ranges, with_ranges

WINDOW = 35


def kind(window: int = WINDOW) -> Kind:
    return Kind("word", window, max(2, min(6, window // 3)))


def confirmed(spans: list[Span], window: int) -> set[bytes]:
    """The recurring phrases: whole spans with copies, and windows of which there are two."""
    phrases = {s[6] for s in spans if s[5] > 1}
    single: dict[tuple, list[Span]] = {}
    for s in spans:
        single.setdefault(s[:2], []).append(s)
    seen: Counter[bytes] = Counter()
    for group in single.values():
        if all(s[5] > 1 for s in group):
            continue
        for s in group:
            words = s[6].split(b" ")
            for i in range(s[4]):
                seen[b" ".join(words[i : i + window])] += min(2, s[5])
    phrases.update(w for w, n in seen.items() if n > 1)
    return phrases


def automaton(phrases: set[bytes]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(f" {p.decode('latin-1')} ", len(p))
    found.make_automaton()
    return found


def locate(spans: list[Span], window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """The word ranges of each span that some phrase covers."""
    phrases = confirmed(spans, window)
    if not phrases:
        return
    machine = automaton(phrases)
    for key, _, _, h, _, _, content in spans:
        text = f" {content.decode('latin-1')} "
        ranges = sorted((end - size, end) for end, size in machine.iter(text))
        merged: list[list[int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:  # a: the first character of a word; b: the blank after one
            first = text.count(" ", 0, a) - 1
            yield key, h, first, first + text.count(" ", a, b) + 1


KEPT = pa.schema([("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def drop_words(text: str | None, cut: list[int] | None) -> tuple[str, int, int]:
    """The kept words joined by one blank, how many words there were, how many went."""
    words = (text or "").encode().split()
    kept, at = [], 0
    for a, b in zip((cut or [])[::2], (cut or [])[1::2], strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return b" ".join(kept).decode(), len(words), len(words) - len(kept)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text."""
    return _apply(docs, window, id_col, text_col, False)


def _apply(docs: DataFrame, window: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    marked = with_ranges(docs, removed_ranges(docs, kind(window), lambda spans: locate(spans, window), id_col, text_col), id_col, text_col)
    last = "kept_sha256" if digest else "kept_text"
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", last) and not (digest and c == text_col)]

    def apply(batches):
        for batch in batches:
            done = [drop_words(t, cut) for t, cut in zip(batch.column(text_col).to_pylist(), batch.column("_cut").to_pylist(), strict=True)]
            kept = [hashlib.sha256(x[0].encode()).hexdigest() if digest else x[0] for x in done]
            columns = [*[batch.column(c) for c in others], pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "n_words", "n_removed", last])

    schema = marked.select(*others).schema.add("n_words", "long").add("n_removed", "long").add(last, "string")
    return marked.select(*dict.fromkeys([*others, text_col, "_cut"])).mapInArrow(apply, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _apply(docs, WINDOW, "doc_id", "text", True)
