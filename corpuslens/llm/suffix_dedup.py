"""Suffix-array dedup by bucket-pointer refinement.

Within a shard of spans that share a key, positions start in buckets of equal
q-grams, in the order of their bytes; a bucket's identifier is the rank of its
first member. A bucket of several positions is refined by sorting its members on
the bucket identifiers of a later offset; the refined identifiers take the
place of the old ones, so the next step reuses them and doubles the depth.
Positions alone in their bucket are left out of all further steps. At the
window's depth, identifiers order a shard's positions as their windows' bytes
do, and positions in one bucket start the same window. All spans of a shard are
refined, whatever their counts.

Defined results: null and empty texts have no bytes and keep the empty text;
texts shorter than a window lose nothing; repeated rows are copies and lose
all their windows; an empty table gives an empty table; further columns are
kept (a clash with n_bytes, n_removed, n_spans or kept is overwritten).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .hashing import U
from .repeats import Kind, Span, removed_ranges, with_ranges

WINDOW = 200
#: Bytes of the initial buckets; so many fit a 64-bit number.
GRAM = 8


def kind(window: int = WINDOW) -> Kind:
    return Kind("byte", window, max(2, min(32, window // 3)))


def refine(ids: np.ndarray, more: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """One step: sorts the positions `more` (whole buckets) on (own bucket, bucket at offset); new ids, and the positions still not alone."""
    at = np.minimum(more + offset, len(ids) - 1)
    order = np.lexsort((ids[at], ids[more]))
    place = more[order]
    a, b = ids[place], ids[at[order]]
    bucket, part = np.ones(len(more), bool), np.ones(len(more), bool)
    np.not_equal(a[1:], a[:-1], out=bucket[1:])
    part[1:] = bucket[1:] | (b[1:] != b[:-1])
    turn = np.arange(len(more))
    first = np.maximum.accumulate(np.where(part, turn, 0))
    out = ids.copy()
    out[place] = a + first - np.maximum.accumulate(np.where(bucket, turn, 0))
    alone = part & np.append(part[1:], True)
    return out, np.sort(place[~alone])


def initial_buckets(data: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of buckets of equal q-grams (q <= 8) in the order of their bytes, and the positions not alone. The last q - 1 positions begin no gram: each is alone, after all others."""
    n = max(0, len(data) - q + 1)
    value = np.zeros(n, np.uint64)
    for j in range(q):
        value = (value << U(8)) | data[j : j + n]
    _, rank, sizes = np.unique(value, return_inverse=True, return_counts=True)
    ids = np.concatenate([(np.cumsum(sizes) - sizes)[rank], np.arange(n, len(data))]).astype(np.int64)
    return ids, np.flatnonzero(sizes[rank] > 1)


def buckets(data: np.ndarray, window: int) -> np.ndarray:
    """By position, an identifier that orders windows by their bytes; two windows share it only if they are equal."""
    depth = min(GRAM, window)
    ids, more = initial_buckets(data, depth)
    while depth < window and len(more):
        step = min(depth, window - depth)
        ids, more = refine(ids, more, step)
        depth += step
    return ids


def repeated_windows(spans: list[Span], window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """The byte ranges of each span that windows which come twice cover."""
    data = np.frombuffer(b"".join(s[6] for s in spans), np.uint8)
    ids = buckets(data, window)
    sizes = np.array([len(s[6]) for s in spans])
    begin = np.cumsum(sizes) - sizes
    counts = np.array([s[4] for s in spans])
    owner = np.repeat(np.arange(len(spans)), counts)
    first = np.cumsum(counts) - counts
    within = np.arange(len(owner)) - first[owner]
    _, bucket = np.unique(ids[begin[owner] + within], return_inverse=True)
    weight = np.minimum(2, np.array([s[5] for s in spans]))[owner]
    twice = np.bincount(bucket, weight)[bucket] > 1
    # runs of repeated windows, by span
    edge = np.ones(len(owner), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (twice[1:] != twice[:-1])
    starts = np.flatnonzero(edge)
    stops = np.append(starts[1:], len(owner))
    for a, b in zip(starts[twice[starts]], stops[twice[starts]], strict=True):
        s = spans[owner[a]]
        yield s[0], s[3], int(within[a]), int(within[b - 1]) + window


def drop_bytes(text: str | None, cut: list[int] | None) -> tuple[bytes, int, int, int]:
    """The kept bytes, how many there were, how many went, in how many runs."""
    data, kept, at = (text or "").encode(), [], 0
    for a, b in zip((cut or [])[::2], (cut or [])[1::2], strict=True):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    out = b"".join(kept)
    return out, len(data), len(data) - len(out), len(cut or []) // 2


def suffix_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary: a cut may split a character)."""
    return _apply(docs, window, id_col, text_col, False)


def _apply(docs: DataFrame, window: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    marked = with_ranges(docs, removed_ranges(docs, kind(window), lambda spans: repeated_windows(spans, window), id_col, text_col), id_col, text_col)
    last = "kept_sha256" if digest else "kept"
    others = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", last) and not (digest and c == text_col)]

    def apply(batches):
        for batch in batches:
            done = [drop_bytes(t, cut) for t, cut in zip(batch.column(text_col).to_pylist(), batch.column("_cut").to_pylist(), strict=True)]
            kept = pa.array([hashlib.sha256(x[0]).hexdigest() for x in done], pa.string()) if digest else pa.array([x[0] for x in done], pa.binary())
            columns = [*[batch.column(c) for c in others], *[pa.array([x[i] for x in done], pa.int64()) for i in (1, 2, 3)], kept]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "n_bytes", "n_removed", "n_spans", last])

    schema = marked.select(*others).schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long")
    return marked.select(*dict.fromkeys([*others, text_col, "_cut"])).mapInArrow(apply, schema.add(last, "string" if digest else "binary"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _apply(docs, WINDOW, "doc_id", "text", True)
