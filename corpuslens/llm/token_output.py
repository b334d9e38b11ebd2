"""Token ids in a binary format of patched frame-of-reference blocks.

A file set is a table in the shared folder with one row per segment (so that
Spark's writer commits whole files, also when an executor is lost):

    shard int, segment int, doc_ids array<long>, counts array<long>, total long, payload binary

payload: "PFR1", n_values u64, n_blocks u32, then n_blocks+1 byte starts u64
(the index: any block can be read alone), then the blocks. A block holds 4096
values (the last fewer): n u32, minimum u32, width u8, n_exceptions u32, then
the packed residuals (64 values fill `width` 64-bit words), then exception
positions u16 and residuals u32. The width is that of the `percentile`
residual; larger residuals are exceptions and packed as 0.

Segments hold whole documents in ascending id; shards are ranges of ids, and
their starts are running sums over the shards' totals, taken in Spark.

Defined results: null and empty texts hold only the end id; null ids come last;
repeated rows, and rows that share an id, are stored each, in the order of
their texts' hashes; an empty table gives no segment; further columns are not
stored, whatever they are called. A very long text is one segment; its ids must
fit a cell (2 GB: 500 million ids read back, about 1 billion stored).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.operators.metrics import running

from . import common as C
from .tokens import encoded

MAGIC, BLOCK = b"PFR1", 4096
SEGMENT_SCHEMA = "shard int, segment int, doc_ids array<long>, counts array<long>, total long, payload binary"


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    for lane in range(64):
        yield lane, lane * width >> 6, lane * width & 63


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """rows: uint64 (n, BLOCK) below 2**width -> (n, BLOCK // 64, width) words."""
    v = rows.reshape(len(rows), -1, 64)
    out = np.zeros((len(rows), v.shape[1], width), np.uint64)
    for lane, word, shift in _lanes(width) if width else ():
        out[:, :, word] |= v[:, :, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= v[:, :, lane] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    out = np.zeros((n, BLOCK // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane, word, shift in _lanes(width) if width else ():
        v = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, lane] = v & mask
    return out.reshape(n, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 0.95) -> bytes:
    """ids: uint32 -> a payload."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    rows = padded.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    rest = rows - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    pivot = np.partition(rest, at, axis=1)[:, at] if n_blocks else low
    widths = np.array([int(x).bit_length() for x in pivot], np.int64)
    large = rest >> widths[:, None].astype(np.uint64) > 0
    small = np.where(large, 0, rest)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(widths):
        who = np.flatnonzero(widths == w)
        for i, words in zip(who, pack(small[who], int(w)), strict=True):
            packed[i] = words.astype("<u8").tobytes()
    blocks = []
    for i in range(n_blocks):
        n = min(BLOCK, len(ids) - i * BLOCK)
        where = np.flatnonzero(large[i, :n])
        blocks.append(struct.pack("<IIBI", n, int(low[i]), int(widths[i]), len(where)) + packed[i] + where.astype("<u2").tobytes() + rest[i, where].astype("<u4").tobytes())
    starts = np.zeros(n_blocks + 1, "<u8")
    starts[1:] = np.cumsum([len(b) for b in blocks])
    return MAGIC + struct.pack("<QI", len(ids), n_blocks) + starts.tobytes() + b"".join(blocks)


def decode_blocks(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first..last-1 (all by default); reads only these blocks' bytes."""
    if payload[:4] != MAGIC:
        raise ValueError("not a PFR1 payload")
    _, n_blocks = struct.unpack_from("<QI", payload, 4)
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, 16).astype(np.int64) + 16 + 8 * (n_blocks + 1)
    last = n_blocks if last is None else min(last, n_blocks)
    heads = [struct.unpack_from("<IIBI", payload, starts[i]) for i in range(first, last)]
    out = np.zeros((max(0, last - first), BLOCK), np.uint64)
    widths = np.array([h[2] for h in heads], np.int64)
    for w in np.unique(widths):
        who = np.flatnonzero(widths == w)
        words = np.stack([np.frombuffer(payload, "<u8", BLOCK // 64 * w, starts[first + i] + 13) for i in who]).reshape(len(who), BLOCK // 64, w)
        out[who] = unpack(words.astype(np.uint64), int(w))
    values = []
    for i, (n, low, w, odd) in enumerate(heads):
        if odd:
            at = starts[first + i] + 13 + BLOCK // 64 * w * 8
            out[i, np.frombuffer(payload, "<u2", odd, at)] = np.frombuffer(payload, "<u4", odd, at + 2 * odd)
        values.append((out[i, :n] + np.uint64(low)).astype("<u4"))
    return np.concatenate(values) if values else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_ids: int = 1 << 18, rows_per_shard: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes the file set at path."""
    C.small_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // rows_per_shard))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(C.MAX_LONG)).alias("ord"), F.col(text_col).alias("text"), C.text_key(F.col(text_col)).alias("tk"))
    ordered = keyed.repartitionByRange(shards, "ord", "tk").sortWithinPartitions("ord", "tk").select(F.spark_partition_id().alias("shard"), "id", "text")
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("total", pa.int64()), ("payload", pa.binary())])

    def encode(batches):
        shard, segment, names, counts, held, size = None, 0, [], [], [], 0

        def close():
            row = {"shard": shard, "segment": segment, "doc_ids": pa.concat_arrays(names).to_pylist(), "counts": np.concatenate(counts).tolist(), "total": size, "payload": encode_blocks(np.concatenate(held))}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py()
            for first, ids, begins in encoded(batch.column("text"), end_id, tokenizer):
                a, n = 0, len(begins) - 1
                while a < n:  # documents up to the one that fills the segment
                    b = min(n, int(np.searchsorted(begins, begins[a] + segment_ids - size)))
                    names.append(batch.column("id").slice(first + a, b - a))
                    counts.append(np.diff(begins[a : b + 1]))
                    held.append(ids[begins[a] : begins[b]])
                    size += len(held[-1])
                    a = b
                    if size >= segment_ids:
                        yield close()
                        segment, names, counts, held, size = segment + 1, [], [], [], 0
        if names:
            yield close()

    ordered.mapInArrow(encode, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids (binary, u32)."""
    return _read(spark, path, True)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    heads = segments.groupBy("shard").agg(F.sum("total").alias("total"))
    sizes = running(heads, "shard", ["total"]).select("shard", F.col("total_before").alias("base"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = segments.select("shard", "segment", "total").withColumn("within", before).join(sizes, "shard").select("shard", "segment", (F.col("within") + F.col("base")).alias("begin"))
    rows = segments.join(F.broadcast(starts) if starts.count() <= C.BROADCAST_BYTES // 64 else starts, ["shard", "segment"]).select("begin", "doc_ids", "counts", "payload")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = decode_blocks(batch.column("payload")[row].as_buffer().to_pybytes()).tobytes()
                counts, names = batch.column("counts")[row].as_py(), batch.column("doc_ids")[row].as_py()
                ends = np.cumsum(counts)
                begins, base = ends - counts, batch.column("begin")[row].as_py()
                cut = [raw[4 * b : 4 * e] for b, e in zip(begins, ends, strict=True)]
                data = [pa.array(names, pa.int64()), pa.array(begins + base, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(data + ([pa.array(cut, pa.binary())] if with_ids else []), schema=pa.schema(fields))

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.scratch(spark, "token-ids")
    write_ids(C.table(spark, sf_dir, "documents"), path)
    return _read(spark, path, False)
