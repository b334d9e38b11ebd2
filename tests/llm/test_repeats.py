"""Substring and suffix dedup, and the n-gram join, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import common as C
from corpuslens.llm import hashing, ngram_join, repeats, suffix_dedup
from corpuslens.llm.components import components
from corpuslens.llm.substring_dedup import substring_dedup
from corpuslens.llm.suffix_dedup import suffix_dedup as suffix_dedup_docs

LOWER = bytes(range(256)).lower()
RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in ("the", "une", "Ärz", "x", "longerword", "q") for b in range(40)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 1)
TEXTS = [
    None, "", " \n ", "short", prose(300, 2), prose(300, 2), prose(120, 3) + " " + PASSAGE + " " + prose(50, 4),
    PASSAGE.replace(" ", "\n", 7) + "  " + prose(80, 6), "a " * 400, "x" * 500, "ab" * 300, "x" * 500 + " tail",
    " ".join(map(str, range(100))), " ".join(map(str, range(50, 160))), "q" * 199, "q" * 200, "z" * 205, "z" * 1500 + prose(20, 8),
    "é" * 300, prose(34, 9), prose(34, 9), prose(35, 10), prose(35, 10), prose(5000, 11) + PASSAGE,
    prose(60_000, 12) + " " + PASSAGE + " " + prose(9000, 13), prose(300, 14) + " " + prose(60_000, 12)[250_000:262_000],
]


def brute(texts, window, words):
    seqs = [(t or "").encode().split() if words else (t or "").encode() for t in texts]
    key = (lambda s, i: tuple(s[i : i + window])) if words else (lambda s, i: s[i : i + window])
    n = Counter(key(s, i) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if n[key(s, i)] > 1:
                gone[i : i + window] = True
        kept = [x for x, g in zip(s, gone, strict=True) if not g]
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(s) else 0
        out.append((len(s), int(gone.sum()), runs, b" ".join(kept).decode() if words else bytes(kept)))
    return out


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, kept int")


@pytest.mark.parametrize("hot", [4000, 1])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_SPANS", hot)  # 1: every recurring key is salted
    got = substring_dedup(docs_of(spark, TEXTS)).orderBy("doc_id").select("n_words", "n_removed", "kept_text").collect()
    assert [tuple(r) for r in got] == [(a, b, d) for a, b, _, d in brute(TEXTS, 35, True)]


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_SPANS", hot)
    got = suffix_dedup_docs(docs_of(spark, TEXTS)).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept").collect()
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == brute(TEXTS, 200, False)


@pytest.mark.parametrize("kind", [repeats.Kind("word", 35, 6), repeats.Kind("byte", 200, 32)])
def test_pieces_of_long_texts_hold_each_window_once(kind):
    text = prose(3000, 77).encode()
    symbols = text.split() if kind.symbol == "word" else text
    found = []
    for base, piece in repeats.pieces(text, kind, 700):
        mine = piece.split() if kind.symbol == "word" else piece
        for i in range(len(mine) - kind.window + 1):
            assert mine[i : i + kind.window] == symbols[base + i : base + i + kind.window]
            found.append(base + i)
    assert found == list(range(len(symbols) - kind.window + 1))


def test_dedup_of_an_empty_table(spark):
    empty = docs_of(spark, [])
    assert substring_dedup(empty).count() == 0
    assert suffix_dedup_docs(empty).count() == 0


def test_bucket_refinement_tells_windows_apart():
    data = np.frombuffer((b"abcdefgh" * 40 + b"Z" + b"abcdefgh" * 40), np.uint8)
    ids = suffix_dedup.buckets(data, 64)
    windows = [data[i : i + 64].tobytes() for i in range(len(data) - 63)]
    assert all((windows[i] == windows[j]) == (ids[i] == ids[j]) for i in range(0, 300, 7) for j in range(0, len(windows), 5))


@pytest.mark.parametrize("window", [3, 8, 20, 64])
def test_buckets_order_positions_as_the_bytes_of_their_windows(window):
    data = np.frombuffer((prose(200, 31) + prose(200, 31) + "ab" * 90 + "\xff\x00").encode("latin-1", "replace"), np.uint8)
    ids = suffix_dedup.buckets(data, window)
    windows = [data[i : i + window].tobytes() for i in range(len(data) - window + 1)]
    order = sorted(range(len(windows)), key=windows.__getitem__)
    for i, j in zip(order, order[1:], strict=False):
        assert (ids[i] == ids[j]) if windows[i] == windows[j] else (ids[i] < ids[j])


def test_word_hashes_depend_on_the_word_only():
    data, _ = hashing.join_texts([b"one  two\tthree one", b"averyveryverylongword two", b"averyveryverylongworD"])
    starts, ends = hashing.word_bounds(data)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    h = hashing.word_hashes(data, starts, ends)
    assert all((words[i] == words[j]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in owners[g])
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            owners[g].append(i)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), 10**18), ids[i])
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(ids))]


def near_texts():
    r = random.Random(3)
    out = list(TEXTS)
    for family in range(4):
        base = prose(150, 100 + family).split()
        for _ in range(60 if family == 0 else 8):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            out.append(" ".join(copy[: r.choice([150, 150, 140, 125])]))
    common = prose(40, 200)
    out += [f"{prose(r.randint(10, 90), 300 + i)} {common} {prose(30, 400 + i)}" for i in range(60)]
    out += ["One TWO three", "one two Three", "one two", "five words are right here", "FIVE words are right here"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"heavy": 0, "short": 2}, {"heavy": 50, "short": 3, "block_tokens": 600, "block_sets": 7}])
def test_near_duplicates_match_brute_force(spark, options):
    texts = near_texts()
    got = ngram_join.near_duplicates(docs_of(spark, texts), **options).orderBy("ord").select("ord", "n", "component").collect()
    assert [tuple(r) for r in got] == brute_components(list(range(len(texts))), texts)


def test_near_duplicates_odd_tables(spark):
    assert ngram_join.near_duplicates(docs_of(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r["ord"], r["component"]) for r in ngram_join.near_duplicates(rows).collect())
    assert got == [(4, 4), (4, 4), (9, 9), (2**63 - 1, 4)]
    assert sorted((r["doc_id"] for r in ngram_join.keep_first(rows).collect())) == [4, 4, 9]


def test_near_duplicates_tell_texts_apart_that_share_an_id(spark):
    a, b, c, d = prose(60, 900), prose(60, 901), prose(60, 902), prose(60, 903)
    near = lambda t: t + " one more"
    rows = spark.createDataFrame([(None, a), (None, b), (5, near(a)), (None, c), (None, near(c)), (None, d), (None, d), (7, b + " " + a), (7, near(near(c)))], "doc_id long, text string")
    none = 2**63 - 1
    got = ngram_join.near_duplicates(rows).join(rows.withColumn("tk", C.text_key(F.col("text"))).select("tk", "text").distinct(), "tk").collect()
    assert sorted((r["text"], r["ord"], r["component"]) for r in got) == sorted([(a, none, 5), (b, none, none), (near(a), 5, 5), (c, none, 7), (near(c), none, 7), (d, none, none), (d, none, none), (b + " " + a, 7, 7), (near(near(c)), 7, 7)])
    kept = sorted((r["text"], r["doc_id"]) for r in ngram_join.keep_first(rows).collect())
    assert kept == sorted([(b, None), (near(a), 5), (d, None), (b + " " + a, 7), (near(near(c)), 7)], key=lambda x: x[0])
    apart = rows.filter("doc_id is null")
    assert {r["text"] for r in ngram_join.keep_first(apart).collect()} in [{a, b, d, c}, {a, b, d, near(c)}]


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}


def test_near_duplicates_leave_neither_tables_nor_shuffle_files(spark):
    import os
    import time

    from corpuslens.llm import common as C

    folder = C.shared_dir(spark).removeprefix("file://") + "/corpuslens"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}
    had, files = tables(), shuffled()
    C.written(spark.range(1000).repartition(3, "id"), "test-rows")
    for _ in range(50):  # they go in the background
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert not shuffled() - files
    ngram_join.keep_first(docs_of(spark, near_texts()[:40]))
    assert sorted(name.rsplit("-", 1)[0] for name in tables() - had) == ["near-copies", "repeats-without-id", "test-rows"]


def test_shared_shingles_beyond_the_heavy_ones_go_last(spark):
    common = prose(40, 200)
    texts = [f"{prose(30, 300 + i)} {common}" for i in range(60)]
    heavy, levels = ngram_join.shared_shingles(docs_of(spark, texts), 5, 0)
    order = ngram_join.Order(heavy, levels)
    shared = ngram_join.shingle_sets([common.encode()])[0]
    alone = np.setdiff1d(ngram_join.shingle_sets([t.encode() for t in texts])[0], shared)
    assert not len(heavy) and (order.of(shared) >> np.uint64(42)).min() >= 9  # 60 of each
    assert np.mean(order.of(alone) < order.of(shared).min()) > 0.95  # but for those that share a cell
