"""Finding every window of W symbols that also starts elsewhere, without comparing pairs.

A window's key is the least hash of the K-symbol grams in it, so equal windows
have equal keys. Consecutive windows with the same key form a span.

1. keys: each span gives its key (twice if it may hold equal windows itself);
   keys that come once are done with. The others set bits of a bitmap of fixed
   size, the only thing that is broadcast; a full bitmap only filters less.
2. spans: each span whose key is in the bitmap sends its content once per task
   (with a count) to its key's shard. Keys with more than a bounded share of
   all spans are salted by window hash, so that no shard holds a hot key alone.
   A resolver (given by the operator) marks the repeated windows of each
   distinct span.
3. documents: each occurrence of a marked span gives ranges to remove, merged
   by document and applied to its text.

Documents are read three times and never shuffled, unless the ranges exceed
the limit of a broadcast. Windows never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .hashing import A1, A2, U, grams, join_texts, mix, sliced, sliding_min, word_bounds, word_hashes

BITS = 27
#: At most so many keys are hot, whatever the corpus.
MOST_HOT = 50_000
HOT_SPANS = 4_000
FLUSH_BYTES = 12 << 20
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * A1)


@dataclass(frozen=True)
class Kind:
    """What a symbol is ("word" or "byte"), the window length W and the gram length K in symbols."""

    symbol: str
    window: int
    gram: int

    @property
    def per_window(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Chunk:
    """Symbols of some documents: hashes x, each document's first symbol (and the end), and where symbols lie in data."""

    x: np.ndarray
    begins: np.ndarray
    data: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None

    def content(self, a: int, b: int) -> bytes:
        """Symbols a..b-1 of this chunk; words are joined by one blank."""
        if self.starts is None:
            return self.data[a:b].tobytes()
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split())


def chunk_of(texts: list[bytes], kind: Kind) -> Chunk:
    data, begins = join_texts(texts)
    if kind.symbol == "byte":
        begins = begins.copy()
        return Chunk(BYTE_HASH[data], begins, data, None, None)
    starts, ends = word_bounds(data)
    return Chunk(word_hashes(data, starts, ends), np.searchsorted(starts, begins), data, starts, ends)


@dataclass
class Spans:
    """By span: its document (in the chunk), first symbol, number of windows, key, and 2 if it may repeat itself; all grams."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    weight: np.ndarray
    grams: np.ndarray

    def content_hash(self, who: np.ndarray, kind: Kind) -> np.ndarray:
        """A hash of all symbols of each span in who."""
        return cover(self.grams, self.start[who], self.n[who] + kind.window - 1, kind)


def spans_of(chunk: Chunk, kind: Kind) -> Spans | None:
    w, size, x = kind.per_window, kind.window, chunk.x
    # A byte document is followed by a blank of its own, which belongs to no window.
    last = chunk.begins[1:] - (kind.symbol == "byte") - size + 1
    first = chunk.begins[:-1]
    some = last > first
    if not some.any():
        return None
    g = grams(x, kind.gram)
    low = sliding_min(g, w)
    valid = np.zeros(len(low) + 1, np.int8)
    np.add.at(valid, first[some], 1)
    np.add.at(valid, last[some], -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    edge = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=edge[1:])
    edge[first[some]] = True
    start = np.flatnonzero(edge & valid)
    doc = np.searchsorted(first, start, "right") - 1
    # several empty documents may begin at one symbol; the one that has it is the last
    stop = np.minimum(np.append(start[1:], len(low)), last[doc])
    twin = np.zeros(len(low), bool)
    twin[:-1] = (g[: len(low) - 1] == low[:-1]) & (low[1:] == low[:-1])
    weight = np.where(np.logical_or.reduceat(twin, start) | (stop - start > w), 2, 1)
    if (stop - start > w).any():  # long runs of one key are cut, so that contents stay short
        parts = -(-(stop - start) // w)
        which = np.repeat(np.arange(len(start)), parts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = start[which] + within * w
        stop, start, doc, weight = np.minimum(begin + w, stop[which]), begin, doc[which], weight[which]
    n = stop - start
    return Spans(doc, start, n, mix(low[start] ^ A2), weight, g)


def cover(found: np.ndarray, start: np.ndarray, length: np.ndarray, kind: Kind) -> np.ndarray:
    """A hash of length symbols from each start, by the grams that cover them."""
    h = length.astype(np.uint64) * A1
    most = int(length.max()) if len(length) else 0
    for at in range(0, most, kind.gram):
        h = mix(h * A1 + found[start + np.minimum(at, length - kind.gram)])
    return h


def window_hashes(s: Spans, i: int, kind: Kind) -> np.ndarray:
    """A hash of each window of span i."""
    at = np.arange(s.start[i], s.start[i] + s.n[i])
    return cover(s.grams, at, np.full(len(at), kind.window), kind)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.MAX_LONG)).alias("ord"), C.text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))


def pieces(text: bytes, kind: Kind, most: int) -> Iterator[tuple[int, bytes]]:
    """A long text as pieces that overlap by a window less one symbol, so that each window starts in one piece, with its first symbol."""
    if kind.symbol == "byte":
        for base in range(0, max(1, len(text) - kind.window + 1), most):
            yield base, text[base : base + most + kind.window - 1]
        return
    starts, ends = word_bounds(np.frombuffer(text + b" ", np.uint8))
    step = max(1, most * len(starts) // max(1, len(text)))
    for base in range(0, max(1, len(starts) - kind.window + 1), step):
        stop = min(len(starts), base + step + kind.window - 1)
        if stop > base:
            yield base, text[starts[base] : ends[stop - 1]]


def chunks(batches, kind: Kind, most: int = 250_000) -> Iterator[tuple[pa.RecordBatch, Chunk, Spans, int]]:
    """Parts of the batches, their symbols and spans, and the first symbol's place in its document (not 0 only for long texts)."""
    for batch in batches:
        for part, texts in sliced(batch, most):
            several = pieces(texts[0], kind, most) if len(texts) == 1 else [(0, None)]
            for base, piece in several:
                chunk = chunk_of(texts if piece is None else [piece], kind)
                if (found := spans_of(chunk, kind)) is not None:
                    yield part, chunk, found, base


def recurring_keys(rows: DataFrame, kind: Kind) -> tuple[DataFrame, int]:
    """key, n of keys that come more than once (as a table), and how many spans there are."""

    def emit(batches):
        for _, _, s, _ in chunks(batches, kind):
            yield pa.RecordBatch.from_arrays([pa.array(s.key.view(np.int64)), pa.array(s.weight, pa.int64())], names=["key", "n"])

    counts = rows.select("text").mapInArrow(emit, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    path_rows = C.written(counts.filter("n > 1"), "recurring-keys")
    return path_rows, path_rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def bitmap(keys: DataFrame) -> bytes:
    """2**BITS bits; set for the leading bits of each key."""
    slots = keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("slot")).distinct().withColumn("block", F.shiftright("slot", 20).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 20, bool)
        bits[table.column("slot").to_numpy() & ((1 << 20) - 1)] = True
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(1 << (BITS - 3))
    for block, bits in slots.groupBy("block").applyInArrow(build, "block int, bits binary").toLocalIterator():  # 2**(BITS-20) rows
        out[block << 17 : (block + 1) << 17] = bits
    return bytes(out)


def in_bitmap(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key >> U(64 - BITS)
    return (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 > 0


SPAN_FIELDS = [("key", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("hash", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()), ("content", pa.binary())]
SPAN_DDL = "key long, salt int, salts int, hash long, n int, copies long, content binary"


def send_spans(rows: DataFrame, kind: Kind, bits, hot) -> DataFrame:
    """Distinct spans per task, with contents; hot keys' spans go to each salt that one of their windows has."""

    def emit(batches):
        table, few = np.frombuffer(bits.value, np.uint8), hot.value
        held: dict[tuple[int, int, int], list] = {}
        size = 0

        def flush():
            data = list(zip(*[(k, s, v[0], h, v[1], v[2], v[3]) for (k, s, h), v in held.items()], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(data, SPAN_FIELDS, strict=True)], names=[n for n, _ in SPAN_FIELDS])

        for _, chunk, s, _ in chunks(batches, kind):
            who = np.flatnonzero(in_bitmap(table, s.key))
            key, h = s.key[who].view(np.int64).tolist(), s.content_hash(who, kind).view(np.int64).tolist()
            for k, x, i in zip(key, h, who.tolist(), strict=True):
                salts = few.get(k, 1)
                mine = (0,) if salts == 1 else np.unique(window_hashes(s, i, kind) % U(salts)).tolist()
                for salt in mine:
                    if (old := held.get((k, salt, x))) is not None:
                        old[2] += 1
                        continue
                    content = chunk.content(s.start[i], s.start[i] + s.n[i] + kind.window - 1)
                    held[k, salt, x] = [salts, int(s.n[i]), 1, content]
                    size += len(content) + 400
                if size > FLUSH_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return rows.select("text").mapInArrow(emit, SPAN_DDL)


MARK_DDL = "key long, hash long, a int, b int"
#: A resolver's input: (key, salt, salts, hash, n, copies, content) of distinct spans, whole keys together.
Span = tuple[int, int, int, int, int, int, bytes]
#: It yields (key, hash, a, b): symbols a..b-1 of that span are to go.
Resolver = Callable[[list[Span]], Iterator[tuple[int, int, int, int]]]


def resolve(sent: DataFrame, resolver: Resolver, shard_bytes: int = 1 << 20) -> DataFrame:
    """Runs the resolver on shards of whole (key, salt) groups of about shard_bytes."""

    def run(batches):
        group: list[list] = []
        shard: list[Span] = []
        size, at = 0, None

        def marks(spans):
            # A salted span comes once for each of its salts, so these groups are judged one by one.
            alone: dict[tuple[int, int], list[Span]] = {}
            for s in spans:
                if s[2] > 1:
                    alone.setdefault(s[:2], []).append(s)
            sets = [[s for s in spans if s[2] == 1], *alone.values()]
            found = list(zip(*(m for part in sets if part for m in resolver(part)), strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int32())], names=["key", "hash", "a", "b"])

        def close():
            nonlocal group
            shard.extend(tuple(x) for x in group)
            group = []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != row[:2]:
                    close()
                    at = row[:2]
                    if size > shard_bytes:
                        yield marks(shard)
                        shard, size = [], 0
                if group and group[-1][3] == row[3]:
                    group[-1][5] += row[5]
                else:
                    group.append(list(row))
                    size += len(row[6])
        close()
        if shard:
            yield marks(shard)

    return sent.repartition("key", "salt").sortWithinPartitions("key", "salt", "hash").mapInArrow(run, MARK_DDL)


def removed_ranges(docs: DataFrame, kind: Kind, resolver: Resolver, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ord, tk, cut: by document with repeats, the sorted disjoint symbol ranges to remove (start, end, start, end, ...)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    keys, total = recurring_keys(rows, kind)
    bits = spark.sparkContext.broadcast(bitmap(keys))
    bound = max(HOT_SPANS, total // MOST_HOT)
    hot = spark.sparkContext.broadcast({k: -(-n // bound) for k, n in keys.filter(F.col("n") > bound).collect()})  # fewer than MOST_HOT rows
    marks = C.written(resolve(send_spans(rows, kind, bits, hot), resolver), "marks")

    def occurrences(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for part, chunk, s, base in chunks(batches, kind):
            who = np.flatnonzero(in_bitmap(table, s.key))
            doc = s.doc[who]
            ids = [part.column(c).to_numpy()[doc] for c in ("ord", "tk")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(s.key[who].view(np.int64)), pa.array(s.content_hash(who, kind).view(np.int64)), pa.array((s.start[who] - chunk.begins[doc] + base).astype(np.int64))], names=["ord", "tk", "key", "hash", "start"])

    found = rows.mapInArrow(occurrences, "ord long, tk long, key long, hash long, start long").join(marks, ["key", "hash"]).select("ord", "tk", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))

    def merge(batches):
        doc, cut = None, []
        names = ["ord", "tk", "cut"]
        schema = pa.schema([("ord", pa.int64()), ("tk", pa.int64()), ("cut", pa.list_(pa.int64()))])
        for batch in batches:
            out: list[tuple] = []
            for o, t, a, b in zip(*[batch.column(c).to_pylist() for c in ("ord", "tk", "a", "b")], strict=True):
                if doc != (o, t):
                    if cut:
                        out.append((*doc, cut))
                    doc, cut = (o, t), [a, b]
                elif a <= cut[-1]:
                    cut[-1] = max(cut[-1], b)
                else:
                    cut += [a, b]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*out, strict=True) if out else [[], [], []], schema, strict=True)], names=names)
        if cut:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*doc, cut), strict=True))], schema)

    return C.written(found.repartition("ord", "tk").sortWithinPartitions("ord", "tk", "a", "b").mapInArrow(merge, "ord long, tk long, cut array<long>"), "removed-ranges")


def with_ranges(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _cut: the ranges to remove, null where there are none."""
    side = C.checked_broadcast(ranges.select(F.col("ord").alias("_ord"), F.col("tk").alias("_tk"), F.col("cut").alias("_cut")), 48, "_cut")
    out = docs.withColumns({"_ord": F.coalesce(F.col(id_col).cast("long"), F.lit(C.MAX_LONG)), "_tk": C.text_key(F.col(text_col))})
    return out.join(side, ["_ord", "_tk"], "left").drop("_ord", "_tk")
