"""Benchmark decontamination with a hash set of normalised test n-grams (DataFrame operations only).

Benchmark items become windows of `window` words (an item with fewer words is
one window of its own length). The hash set holds the first one, two or four
words of each window (as many as fit); it is broadcast with the windows if their
counted bytes are under the limit, else joined by a shuffle. Documents are
scanned once: every word position is probed, whatever lengths the windows have,
and the window's words are compared with the document's there.

Defined results: null texts have no words and hit nothing; items without words
match nothing; a null item id counts as the id "null"; items that share an id
count once; rows that share an id and a text get the same result, each in its
own row; very long texts are scanned whole; empty tables give empty (or clean)
results; further columns are kept (a clash with `n_words`, `n_hit`, `items` or
`contaminated` is overwritten, but for the action "drop", which adds none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OUTPUT = ("n_words", "n_hit", "items", "contaminated")
#: How many of a window's first words are hashed, at most.
LEADS = (4, 2, 1)


def words_of(text: Column) -> Column:
    """Lower-cased words: letters, digits and everything beyond ASCII."""

    def inner(parts: Column) -> Column:
        """Without the empty parts before a leading and after a trailing break."""
        first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))

    return C.let(F.split(C.lower_ascii(C.no_nul(text)), BREAK), inner)


def word_count(text: Column) -> Column:
    def count(parts: Column) -> Column:
        empty = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return (F.size(parts) - empty).cast("long")

    return C.let(F.split(C.lower_ascii(C.no_nul(text)), BREAK), count)


def lead_hashes(hashes: Column, lead: int) -> Column:
    """The hash of each `lead` consecutive word hashes, by position. hashes: a column or variable, as it is used several times."""
    if lead == 1:
        return hashes
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (lead - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, lead)]))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, k, gram, lead, hash: each item's windows, each once, and the hash of the first `lead` words."""
    items = benchmark.select(F.coalesce(C.quoted(id_col).cast("string"), F.lit("null")).alias("item"), words_of(C.quoted(text_col)).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(window)))
    grams = items.select("item", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.slice("w", i, F.col("k")))).alias("g")).distinct()
    lead, value = F.lit(None).cast("int"), F.lit(None).cast("long")
    for n in sorted(LEADS):
        first = [F.xxhash64(F.get("g", F.lit(j))) for j in range(n)]
        lead = F.when(F.col("k") >= n, n).otherwise(lead)
        value = F.when(F.col("k") >= n, first[0] if n == 1 else F.xxhash64(*first)).otherwise(value)
    return grams.select("item", "k", F.array_join("g", " ").alias("gram"), lead.alias("lead"), value.alias("hash"))


def probed(rows: DataFrame, leads: list[int]) -> DataFrame:
    """rows (with words w) by position and lead in use: lead, hash, pos (null for rows without words). The lists of all leads are exploded as one.

    An outer explode: for an inner one, a filter on the lists would compute them twice.
    """
    lists = C.let(word_hashes(F.col("w")), lambda h: F.concat(*[lead_hashes(h, n) for n in leads]))
    flat = rows.withColumn("_p", lists).select(*rows.columns, F.posexplode_outer("_p").alias("_at", "hash"))
    before, lead, pos = F.lit(0), F.lit(leads[0]), F.col("_at")
    for earlier, n in zip(leads, leads[1:], strict=False):
        before = before + F.greatest(F.size("w") - (earlier - 1), F.lit(0))
        lead, pos = F.when(F.col("_at") >= before, n).otherwise(lead), F.when(F.col("_at") >= before, F.col("_at") - before).otherwise(pos)
    return flat.select(*rows.columns, lead.alias("lead"), "hash", pos.alias("pos"))


def identity(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(C.quoted(id_col).cast("long"), F.lit(C.MAX_LONG)).alias("_dc_ord"), C.text_key(C.quoted(text_col)).alias("_dc_tk")]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, limit: int = C.BROADCAST_BYTES) -> DataFrame:
    """A row for each document with hits: _dc_ord, _dc_tk, _dc_hit (sorted word positions), _dc_items."""
    grams = C.written(benchmark_windows(benchmark, window), "benchmark-windows")
    leads = sorted(r[0] for r in grams.select("lead").distinct().collect())  # at most three values
    key = ["_dc_ord", "_dc_tk"]
    if not leads:
        return docs.sparkSession.createDataFrame([], "_dc_ord long, _dc_tk long, _dc_hit array<int>, _dc_items array<string>")
    mine = C.written(grams.select("lead", "hash", "k", "gram").distinct(), "window-set")
    few = mine.agg(F.sum(F.octet_length("gram") + 64)).first()[0] <= limit
    rows = docs.select(*identity(id_col, text_col), words_of(C.quoted(text_col)).alias("w"))
    found = probed(rows, leads)
    if not few:  # positions first, so that no words are shuffled with them
        at = found.drop("w").join(mine.select("lead", "hash").distinct(), ["lead", "hash"]).groupBy(*key).agg(F.collect_set(F.struct("lead", "hash", "pos")).alias("at"))
        found = rows.join(C.written(at, "probed"), key).select(*key, "w", F.explode("at").alias("p")).select(*key, "w", "p.*")
    found = found.join(F.broadcast(mine) if few else mine, ["lead", "hash"])
    found = found.filter(F.array_join(F.slice("w", F.col("pos") + 1, F.col("k")), " ") == F.col("gram")).select(*key, "pos", "k", "gram")
    found = C.written(found.distinct(), "window-hits")
    spans = F.collect_set(F.struct("pos", "k"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["pos"], x["pos"] + x["k"] - 1)))))
    covered = found.groupBy(*key).agg(hit.alias("_dc_hit"))
    owners = C.written(grams.select("gram", "item").distinct(), "window-items")
    small = owners.agg(F.sum(F.octet_length("gram") + F.octet_length("item") + 64)).first()[0] <= limit
    items = found.select(*key, "gram").distinct().join(F.broadcast(owners) if small else owners, "gram").groupBy(*key).agg(F.collect_set("item").alias("_dc_items"))
    return C.written(covered.join(items, key), "document-hits")


def cut_words(text: Column, hit: Column) -> Column:
    """text without the words at the positions `hit` and the breaks between two of them."""
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    parts = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    gaps = F.split(text, word)
    flags = F.transform(parts, lambda w, i: F.array_contains(hit, i))

    def piece(f: Column):
        return lambda g, i: F.concat(F.when((i > 0) & F.get(f, i) & F.get(f, i - 1), F.lit("")).otherwise(g), F.when(F.coalesce(F.get(f, i), F.lit(True)), F.lit("")).otherwise(F.get(parts, i)))

    return C.let(flags, lambda f: F.array_join(F.transform(gaps, piece(f)), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, action: str = "flag", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids) and contaminated.

    action: "flag" keeps all rows; "drop" leaves out contaminated documents; "cut" takes the hit words out of their texts.
    """
    hits = find_hits(docs, benchmark, window, id_col, text_col)
    key = ["_dc_ord", "_dc_tk"]
    if action == "drop":
        keyed = docs.select("*", *identity(id_col, text_col))
        return keyed.join(C.checked_broadcast(hits.select(*key), 16), key, "left_anti").drop(*key)
    kept = C.others(docs, *OUTPUT)
    size = hits.agg(F.sum(8 * F.size("_dc_hit") + F.aggregate("_dc_items", F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x) + 16))).first()[0]
    keyed = docs.select(*map(C.quoted, kept), *identity(id_col, text_col), C.quoted(text_col).alias("_dc_text"))
    out = keyed.join(F.broadcast(hits) if (size or 0) <= C.BROADCAST_BYTES else hits, key, "left")
    contaminated = F.col("_dc_hit").isNotNull()
    new = [
        word_count(F.col("_dc_text")).alias("n_words"),
        F.when(contaminated, F.size("_dc_hit")).otherwise(0).cast("long").alias("n_hit"),
        F.array_sort(F.coalesce("_dc_items", F.array().cast("array<string>"))).alias("items"),
        contaminated.alias("contaminated"),
    ]
    text = F.when(contaminated, cut_words(F.col("_dc_text"), F.col("_dc_hit"))).otherwise(F.col("_dc_text")) if action == "cut" else None
    return out.select(*[text.alias(c) if text is not None and c == text_col else C.quoted(c) for c in kept], *new)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM
       (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM
       (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, p.k, i, item FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
