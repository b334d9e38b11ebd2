"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities.

Each document (its ids, then an end id) is cut at multiples of the sequence
length; full pieces are sequences of their own. The remainders are packed in
groups that a seeded hash deals out evenly, whatever key or source is hot, so
groups pack in parallel and each holds about `group_docs` documents. Within a
group, remainders in decreasing length go into the first bin with room; a
tournament tree over the bins' free room finds it in O(log n). Only piece
metadata is shuffled, never ids.

Defined results: null and empty texts hold only the end id; repeated rows, rows
that share an id and rows without an id are packed each; ties in length go by
id, then text hash; a very long text is many pieces, of which at most one
shares a sequence; an empty table gives no piece; further columns are left out,
whatever they are called. A sequence is padded to `length`, except at a power
of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoded

PIECES = "doc_id long, tk long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """The largest free room below each node; leaves are bins in the order they were opened."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Puts an item into the first bin with room; returns the bin and the room it had."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        had = room[node]
        room[node] = had - need
        at = node >> 1
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at >>= 1
        return node - self.size, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; lengths must not exceed capacity."""
    tree, out = Tournament(max(1, len(lengths)), capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        where, had = tree.place(lengths[i])
        out[i] = (where, capacity - had)
    return out


def pieces_of(docs: DataFrame, length: int, end_id: int, tokenizer: str | None, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("tk", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    schema = pa.schema(fields)

    def cut(batches):
        for batch in batches:
            for first, ids, begins in encoded(batch.column("text"), end_id, tokenizer):
                sizes = np.diff(begins)
                pieces = -(-sizes // length)
                row = np.repeat(np.arange(len(sizes)), pieces)
                start = length * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                size = np.minimum(length, sizes[row] - start)
                at = begins[row] + start
                raw = memoryview(ids).cast("B")
                cuts = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                data = [batch.column(c).take(pa.array(first + row)) for c in ("id", "tk")]
                data += [pa.array(x, pa.int64()) for x in (start, size, [zlib.crc32(x) for x in cuts], sizes[row])]
                yield pa.RecordBatch.from_arrays(data + [pa.array(cuts, pa.binary())] * with_ids, schema=schema)

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), C.text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 7, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids)."""
    C.small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    pieces = pieces_of(docs, length, end_id, tokenizer, id_col, text_col, with_ids)
    deal = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tk", "start"), F.lit(groups)).cast("int")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    out_schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in cols] + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())])

    def place(batches):
        for group, table in _runs(batches):
            lengths = table.column("length").to_pylist()
            found = first_fit_decreasing(lengths, length)
            used: dict[int, int] = {}
            for (b, _), n in zip(found, lengths, strict=True):
                used[b] = used.get(b, 0) + n
            padded = [used[b] if used[b] & (used[b] - 1) == 0 else length for b, _ in found]
            data = [table.column(c).combine_chunks() for c in cols]
            data += [pa.array([(group << 32) + b for b, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64()), pa.array(padded, pa.int64())]
            yield from pa.Table.from_arrays(data, schema=out_schema).to_batches()

    dealt = pieces.withColumn("g", deal).repartition(groups, "g").sortWithinPartitions("g", F.desc("length"), "doc_id", "tk", "start")
    return dealt.mapInArrow(place, "".join(f"{c} {'binary' if c == 'ids' else 'long'}, " for c in cols) + "sequence_id long, offset long, padded_length long")


def _runs(batches):
    """Yields (g, table) for each run of equal g over sorted batches."""
    held, group = [], None
    for batch in batches:
        g = batch.column("g").to_numpy()
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and g[a] != group:
                yield group, pa.Table.from_batches(held)
                held = []
            group = int(g[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield group, pa.Table.from_batches(held)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
