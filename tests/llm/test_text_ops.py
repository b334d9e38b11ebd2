"""Line dedup, decontamination and quality rules against plain Python, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import decontaminate as dec
from corpuslens.llm import line_dedup as ld
from corpuslens.llm import quality as q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


LINES = [
    "same line here!\nown\nother",
    "  SAME line HERE!\t\nown\nshort\nsame line here!",
    None,
    "",
    "\n\n",
    "same line here!",
    "same line here!",
    "tiny\ntiny\nunique words of this one",
    "x" * 20_000 + "\nunique words of this one",
    "trailing newline is a line\n",
]


def brute_lines(docs):
    first = {}
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), i)
                first[key(line)] = min(first[key(line)], i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup_matches_brute_force(spark, batches, fanout):
    docs = frame(spark, LINES)
    got = sorted(map(tuple, ld.line_dedup(docs, batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()))
    assert got == brute_lines(list(enumerate(LINES)))


def test_line_dedup_odd_tables(spark):
    empty = frame(spark, [])
    assert ld.line_dedup(empty).count() == 0
    rows = spark.createDataFrame([(None, "same line here!", 1), (3, "same line here!", 2), (3, "same line here!", 2), (3, "another same line\nsame line here!", 3)], "doc_id long, text string, n_lines long")
    got = ld.line_dedup(rows).select("doc_id", "n_lines", "n_dropped").collect()
    # a null id comes last; rows that share an id do not remove each other's lines
    assert sorted((r[0] is None, r[1], r[2]) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 1, 1)]


def brute_decontamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = {}
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1):
            if k:
                grams.setdefault(tuple(w[i : i + k]), set()).add(str(item) if item is not None else "null")
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in grams:
                    hit |= set(range(a, a + k))
                    found |= grams[g]
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [long, "nothing to see", None, "", "Say HELLO, World! and hello world", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 then more", "w3 w4 w5", "été à la été à la", "w0 " * 400 + long, long]
    items = [(1, long), (2, "hello world"), (2, "hello world"), (None, "été à"), (5, None), (6, "?!"), (7, "w3 W4. w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, dec.decontaminate(frame(spark, docs), bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()))
    assert got == brute_decontamination(list(enumerate(docs)), items)


def test_decontamination_actions_and_odd_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = frame(spark, ["x, Alpha beta-gamma; y", "clean", None])
    assert [r[0] for r in dec.decontaminate(docs, bench, action="drop").orderBy("doc_id").select("doc_id").collect()] == [1, 2]
    assert dec.decontaminate(docs, bench, action="cut").orderBy("doc_id").first()["text"] == "x, ; y"
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(docs, none).filter("contaminated").count() == 0
    assert dec.decontaminate(frame(spark, []), bench).count() == 0


def brute_statistics(t):
    t = t or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_quality_statistics_match_brute_force(spark):
    texts = [None, "", " \n\t ", "a b # c\na b # c\n\n", "une é|è <b>", "one two three four five six seven eight " * 3 + "nine", " ".join(map(str, range(400))), "a " * 3000, "\x0bq\x0cr\r\nq", " ".join(map(str, range(30))) + " x " + " ".join(map(str, range(9)))]
    got = [tuple(r) for r in q.with_statistics(frame(spark, texts)).orderBy("doc_id").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert got == [brute_statistics(t) for t in texts]


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    base = [" ".join(f"word{(i * 7 + j * j) % 997}x" for j in range(40 + 3 * i % 60)) for i in range(120)]
    texts = base + ["sym$$$ bols&&& " * 10 + " ".join(f"a{j}***" for j in range(60))]
    out = q.quality_rules(frame(spark, texts)).orderBy("doc_id").collect()
    assert not out[-1]["kept"] and sum(r["kept"] for r in out[:-1]) >= 118
    assert all(math.isfinite(r["distance"]) for r in out)
    kept = {r["doc_id"] for r in q.keep_good(frame(spark, texts)).collect()}
    assert kept == {r["doc_id"] for r in out if r["kept"]}


def test_quality_judges_documents_of_small_groups(spark):
    clean = lambda i: " ".join(f"word{(i * 7 + j * j) % 997}x" for j in range(40 + 3 * i % 60))
    junk = "sym$$$ bols&&& " * 10 + " ".join(f"a{j}***" for j in range(60))
    # en: three sources too small alone; de: too small as a language
    rows = [(i, clean(i), "en", f"s{i % 3}") for i in range(90)] + [(100 + i, clean(i), "de", "s0") for i in range(8)] + [(200, junk, "en", "s1"), (201, junk, "de", "s0"), (202, junk, None, None), (203, "few words", "fr", "s9")]
    out = {r["doc_id"]: r for r in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r["distance"] is not None for r in out.values())
    assert not any(out[i]["kept"] for i in (200, 201, 202, 203))
    assert sum(r["kept"] for i, r in out.items() if i < 200) >= 96
    # no table is too small
    alone = spark.createDataFrame(rows[:3], "doc_id long, text string, lang string, source string")
    assert [r["kept"] and r["distance"] is not None for r in q.quality_rules(alone).collect()] == [True] * 3


def test_quality_odd_tables(spark):
    assert q.quality_rules(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, 7)] * 2, "doc_id long, text string, lang string, source string, kept int")
    assert [r["kept"] for r in q.quality_rules(rows.drop("kept")).collect()] == [False, False]


def test_sha_of_empty_is_defined():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def brute_quality(rows, keep_share=0.75, steps=8, floor=0.3, cutoff=60.0, min_group=50):
    """kept and distance by id, with numpy; rows: (id, text, lang, source)."""
    z, failed, keys = {}, {}, {}
    for i, t, lang, source in rows:
        words, chars, symbols, dup, rep, failed[i] = brute_statistics(t)
        w, c = max(words, 1), max(chars, 1)
        z[i] = np.array([math.log1p(words), math.log(c / w), math.log1p(100 * symbols / c), math.log1p(100 * dup / w), math.log1p(100 * rep / w)])
        keys[i] = ((2, lang, source), (1, lang), "*")
    low = lambda v, p: sorted(v)[max(0, math.ceil(p * len(v)) - 1)]
    members = {}
    for i in z:
        for k in keys[i]:
            if not failed[i]:
                members.setdefault(k, []).append(z[i])
    ridge = floor**2 * np.eye(5)

    def distance(x, m, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
        return (y * y).sum(axis=0)

    def step(x, m, cov):
        d = distance(x, m, cov)
        near = x[d <= low(d, keep_share)]
        return near.mean(axis=0), np.cov(near.T, bias=True).reshape(5, 5) + ridge

    def estimate(x):
        m = np.array([low(x[:, j], 0.5) for j in range(5)])
        a = np.sqrt([(1.4826 * low(abs(x[:, j] - m[j]), 0.5)) ** 2 + floor**2 for j in range(5)])
        u = (x - m) / a
        tries = [np.diag(a * a)]
        for v in (np.tanh(u), u / np.maximum(1e-9, np.sqrt((u * u).sum(axis=1)))[:, None]):
            p = v.T @ v / len(v)
            both = np.sqrt(np.outer(np.diag(p), np.diag(p)))
            r = np.divide(0.9 * p, both, out=np.zeros((5, 5)), where=both > 0)
            np.fill_diagonal(r, 1)
            tries.append(r * np.outer(a, a))
        found = []
        for cov in tries:
            now = (m, cov)
            for _ in range(2):
                now = step(x, *now)
            found.append(now)
        now = min(found, key=lambda e: np.linalg.slogdet(e[1])[1])
        for _ in range(steps - 2):
            before, now = now, step(x, *now)
            if abs(np.linalg.slogdet(before[1])[1] - np.linalg.slogdet(now[1])[1]) < 1e-6:
                break
        return *now, low(distance(x, *now), 0.5) / q.CHI2_MEDIAN_5

    made, out = {}, {}
    for i in z:
        size = [len(members.get(k, [])) for k in keys[i]]
        key = next((k for k, n in zip(keys[i][:2], size, strict=False) if n >= min_group), "*")
        if key not in made:
            made[key] = estimate(np.array(members[key]))
        m, cov, scale = made[key]
        d = float(distance(z[i][None, :], m, cov)[0]) / max(1.0, scale)
        out[i] = (not failed[i] and d <= cutoff, d)
    return out


def test_quality_verdicts_match_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" * (1 + i % 3) for i in range(300)]

    def text(i):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 14))) + r.choice(["", "", " # $", " & | *"]) for _ in range(r.randint(2, 12))]
        return "\n".join(lines + lines[:1] * (i % 5 == 0) + ["$$ ## ||" * 30] * (i % 29 == 0))

    rows = [(i, text(i), ["en", "de", None][i % 7 % 3], ["a", "b", None][i % 3]) for i in range(420)]
    rows += [(1000 + i, " ".join("###" for _ in range(60)), "en", "a") for i in range(4)] + [(2000, None, "fr", "c"), (2001, "x " * 9000, "en", "b"), (2002, text(1), "pt", "a")]
    want = brute_quality(rows)
    # columns named like the result's, or like names used inside
    docs = spark.createDataFrame([(*x, 7, "n", 1.5, "c", 0.1, True) for x in rows], "doc_id long, text string, lang string, source string, n_words int, g string, z1 double, `Kept` string, m0 double, `a.b` boolean")
    got = q.quality_rules(docs)
    assert got.columns == ["doc_id", "lang", "source", "g", "z1", "m0", "a.b", *q.STATISTICS, "distance", "kept"]
    found = {x["doc_id"]: x for x in got.collect()}
    assert set(found) == set(want) and all(x["g"] == "n" and x["m0"] == 0.1 and x["n_words"] != 7 for x in found.values())
    assert {i: x["kept"] for i, x in found.items()} == {i: x[0] for i, x in want.items()}
    assert all(found[i]["distance"] == pytest.approx(want[i][1], rel=1e-6) for i in want)
    assert 0 < sum(x[0] for x in want.values()) < len(want)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in want.items() if x[0]}


def test_quality_without_language_and_source(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * 7 + j) % 97}x" for j in range(30 + i))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    out = {x["doc_id"]: x["kept"] for x in q.quality_rules(docs).collect()}
    assert not out[99] and sum(out.values()) >= 58
    assert q.keep_good(docs).columns == ["doc_id", "text"]


def test_line_dedup_keeps_clashing_columns_apart(spark):
    docs = spark.createDataFrame([(1, "a line that comes twice", 5, "p", 7), (2, "a line that comes twice\nmore", 6, "q", 8)], "doc_id long, text string, N_lines int, `a.b` string, _ld_drop int")
    got = ld.line_dedup(docs.drop("_ld_drop"))
    assert got.columns == ["doc_id", "text", "a.b", "n_lines", "n_dropped", "kept_text"]
    assert sorted(map(tuple, got.collect()))[1] == (2, "a line that comes twice\nmore", "q", 2, 1, "more")


def test_merges_move_no_run(spark):
    keys = lambda a, b: spark.range(a, b).selectExpr("xxhash64(id) h1", "id h2", "id lo", "id hi").groupBy("h1", "h2").agg({"lo": "min", "hi": "max"}).toDF("h1", "h2", "lo", "hi")
    runs = ld.LevelledRuns(spark, 2)
    try:
        for a in (0, 500, 900):
            got = runs.add(keys(a, a + 1000))
        assert {r["h2"]: r["first_id"] for r in got.collect()} == {i: i for i in range(900, 1900)} and got.filter("is_new").count() == 400
        assert {k: len(v) for k, v in runs.levels.items()} == {0: 1, 1: 1}
        with ld.sorted_scans(spark):
            batch = keys(5, 50).join(runs._run(runs.levels[1][0], "run0"), ["h1", "h2"], "left").join(runs._run(runs.levels[0][0], "run1"), ["h1", "h2"], "left")
            plan = batch._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    finally:
        runs.drop()


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontamination_of_many_lengths_with_and_without_broadcast(spark, limit):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("ab cd ef gh Ij".split()) + r.choice(["", "", ",", " -"]) for _ in range(n))
    docs = [text(r.randint(0, 60)) for _ in range(60)] + [None, "  ", "..ab", "ab.."]
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 3, 4, 5, 6, 8, 9, 10, 11, 14])] + [(None, "ij"), (40, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = {x["_dc_ord"]: (len(x["_dc_hit"]), sorted(x["_dc_items"])) for x in dec.find_hits(frame(spark, docs), bench, 10, "doc_id", "text", limit).collect()}
    want = {i: (n, found) for i, _, n, found, hit in brute_decontamination(list(enumerate(docs)), items) if hit}
    assert hits == want


def test_decontamination_keeps_clashing_columns_apart(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma", 5, "p", 1.5)] * 2 + [(None, "clean", 6, "q", 2.5)], "doc_id long, text string, ITEMS int, `a.b` string, _hit double")
    got = dec.decontaminate(docs, bench)
    assert got.columns == ["doc_id", "text", "a.b", "_hit", "n_words", "n_hit", "items", "contaminated"]
    assert sorted(map(tuple, got.fillna(0).collect()))[1:] == [(1, "x alpha beta gamma", "p", 1.5, 4, 3, ["1"], True)] * 2
    assert dec.decontaminate(docs, bench, action="drop").columns == docs.columns
    assert dec.decontaminate(docs, bench, action="cut").orderBy("doc_id").collect()[-1]["text"] == "x "
