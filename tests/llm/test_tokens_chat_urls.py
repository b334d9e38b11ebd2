"""Token output, packing, chat formatting and URL filtering: exact round trips and brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from corpuslens.llm import chat, common, packing, token_output, url_filter
from corpuslens.llm.tokens import Encoder

TEXTS = [
    None, "", " ", "\n", "a", "Hello world", "don't I'll 12 3 a's\nnew  line", "  lead", "trail \n", "x\t y", "a\n\nb", "é\n\u00a0ü", "a <|endoftext|> b",
    "word " * 3000 + "end", "plain text, twice.\nand a line", "plain text, twice.\nand a line", "a\x1c b", "日本語 テキスト", "q" * 5000, "Hello, world! Why?! été. İstanbul; ﬁne ª½x x² o'clock. it's", "\nFoo. \nbar,\nBAZ!? naïve… Жук. Ωμέγα: ʰx",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def expected():
    t = Encoder().tokenizer
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for x in TEXTS]


def test_encoder_matches_the_tokenizer(expected):
    e = Encoder(most=3)
    for _ in range(2):
        assert e.encode(TEXTS) == [x.tobytes() for x in expected]


@pytest.mark.parametrize("n", [0, 1, 63, 4095, 4096, 4097, 30_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.integers(2**32 - 5, 2**32, n), np.where(rng.random(n) < 0.01, 2**32 - 1, rng.integers(7, 9, n))):
        ids = ids.astype("<u4")
        payload = token_output.encode_blocks(ids)
        assert (token_output.decode_blocks(payload) == ids).all()
        assert (token_output.decode_blocks(payload, 1, 2) == ids[4096:8192]).all()


def test_token_output_round_trip(spark, expected):
    path = common.scratch(spark, "test-ids")
    token_output.write_ids(docs_of(spark, TEXTS), path, segment_ids=500, rows_per_shard=5)
    start = 0
    for row, ids in zip(token_output.read_ids(spark, path).orderBy("doc_id").collect(), expected, strict=True):
        want = np.append(ids, 2).astype("<u4").tobytes()
        assert (row["start"], row["n_tokens"], row["ids_crc32"], bytes(row["ids"])) == (start, len(want) // 4, zlib.crc32(want), want)
        start += len(want) // 4


def test_token_output_of_an_empty_table(spark):
    path = common.scratch(spark, "test-ids")
    token_output.write_ids(docs_of(spark, []), path)
    assert token_output.read_ids(spark, path).count() == 0


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 200):
        lengths = rng.integers(1, 101, n).tolist()
        bins, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            at = next((b for b, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
            bins += [0] * (at == len(bins))
            want[i] = (at, bins[at])
            bins[at] += lengths[i]
        assert packing.first_fit_decreasing(lengths, 100) == want


def test_packing_places_each_id_once(spark, expected):
    rows = packing.pack(docs_of(spark, TEXTS), length=64, group_docs=6, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, ids in enumerate(expected):
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == np.append(ids, 1).astype("<u4").tobytes()
        assert [p["start"] for p in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert {p["doc_tokens"] for p in pieces} == {len(ids) + 1}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(p["length"] for p in pieces)
        assert [p["offset"] for p in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert {p["padded_length"] for p in pieces} == {total if total & (total - 1) == 0 else 64}
    assert packing.pack(docs_of(spark, [])).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "first\n### x: <b> \\ \\\\"),
    (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, None, "system", "no turn"), (3, 0, None, "no role"), (None, 0, "user", "no id"), (None, 1, "assistant", "é日"),
    *[(9, i, "assistant" if i % 2 else "user", f"turn {i} </turn>") for i in range(101)],
]


def brute_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        text = chat.plain_template([(r[2] or "", r[3] or "") for r in mine])
        out[conv] = (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text))
    return out


@pytest.mark.parametrize("part", [1, 3, 32, 500])
def test_chat_round_trip(spark, part):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    found = chat.format_chats(rows, part_turns=part)
    got = {r[0]: tuple(r)[1:] for r in chat.digest_chats(found).collect()}
    assert got == brute_chats(TURNS)
    assert found.filter("rewrites").count() == 0


def test_templates_that_rewrite_history_are_found():
    trimmed = lambda turns: "".join(f"[{r}:{t if i == len(turns) - 1 else '…'}]" for i, (r, t) in enumerate(turns))
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert chat.render_part(trimmed, [], turns, "assistant")["rewrites"]
    assert not chat.render_part(chat.plain_template, [], turns, "assistant")["rewrites"]
    numbered = lambda turns: "".join(f"{i} {t};" for i, (_, t) in enumerate(turns))
    got = chat.render_part(numbered, [], turns, "assistant")
    assert [got["text"][a:b] for a, b in got["loss"]] == ["two"]


def test_position_dependent_templates_are_found_at_the_first_seam(spark):
    rows = spark.createDataFrame([(1, i, "user", "x") for i in range(9)], "conv_id long, turn long, role string, text string")
    numbered = lambda turns: "".join(f"{i} {t};" for i, (_, t) in enumerate(turns))
    assert chat.format_chats(rows, numbered, part_turns=4).filter("rewrites").count() == 1


def test_templates_see_the_whole_prefix(spark):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"x{i}") for i in range(150)], "conv_id long, turn long, role string, text string")
    parts = lambda template, **more: chat.format_chats(rows, template, **more).orderBy("part").collect()
    turns = [(r["role"], r["text"]) for r in rows.orderBy("turn").collect()]
    last_100 = lambda turns: "".join(f"[{r}:{t}]" for r, t in turns[-100:])
    assert [r["rewrites"] for r in parts(last_100)] == [False, False, False, True, True]
    trims_once = lambda turns: "".join(f"[{r}:{t}]" for r, t in turns[5 if len(turns) > 70 else 0 :])
    assert [r["rewrites"] for r in parts(trims_once)] == [False, False, True, True, True]
    numbered = lambda turns: "".join(f"{i} {t};" for i, (_, t) in enumerate(turns))
    got = parts(numbered)
    assert "".join(r["text"] for r in got) == numbered(turns)
    assert [r["text"][a:b] for r in got for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True)] == [t for role, t in turns if role == "assistant"]
    numbered.memoryless = True  # a false declaration shows at the first seam
    assert [r["rewrites"] for r in parts(numbered)][1]


URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "http://a.net", "http://a.net/", "https://m.Example.NET/en/1?q=/de/", "https://example.net/fr/1", "http://example.com/de/5#x", "http://x.example.com/de", "https://k.org/fr/a?b",
    "ftp://fr.org?x=1", "http://notnet/en/", "http://a://b/c", "http://examplexnet/en/", "http://a.net?x/en/",
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:at].lower(), rest[at:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    best = None
    for verdict, rule in url_filter.OP4_RULES:
        h, p = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_hand_written_rules_match_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = url_filter.filter_urls(pages, labels, url_filter.OP4_RULES).orderBy("page_id").select("host", "path", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == [brute_rule(u) for u in URLS]


def test_mined_rules_block_the_combination(spark):
    rows = [(i, f"http://h{i % 5}.site.org/{'ads' if i % 2 else 'news'}/{'x' if i % 3 else 'y'}/{i}") for i in range(300)]
    bad = lambda u: "h1." in u and "/ads/" in u
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(bad(u))) for i, u in rows if i < 200] + [(None, 1), (3, 0)], "doc_id long, toxic int")
    mined = url_filter.mine_rules(pages, labels, min_support=0.01, min_count=5, min_confidence=0.8)
    tokens = [frozenset(r["antecedent"]) for r in mined.collect()]
    assert tokens and all(not a < b for a in tokens for b in tokens)
    got = url_filter.filter_urls(pages, labels, [], min_support=0.01, min_count=5, min_confidence=0.8)
    assert {r["page_id"] for r in got.filter("verdict = 'block'").collect()} == {i for i, u in rows if bad(u)}
    assert url_filter.filter_urls(pages.limit(0), labels, []).count() == 0


def test_a_bad_label_of_many_rare_domains_is_mined(spark):
    # each domain has two pages; only the label recurs
    rows = [(i, f"http://{'ads' if i % 4 == 0 else 'www'}.d{i // 8}x{i % 4}.t{i % 7}/{i}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/ads." in u)) for i, u in rows if i < 400], "doc_id long, toxic int")
    mined = url_filter.mine_rules(pages, labels)
    assert ["l:ads"] in [r["antecedent"] for r in mined.collect()]
    got = url_filter.filter_urls(pages, labels, [])
    assert {r["page_id"] for r in got.filter("verdict = 'block'").collect()} == {i for i, u in rows if "/ads." in u}


def brute_tokens(url):
    rest = url.split("://", 1)[1]
    host, *segments = rest.split("?")[0].split("/")
    parts = host.split(".")
    query = rest.split("?")[1:]
    out = {"h:" + ".".join(parts[i:]) for i in range(len(parts))} | {"l:" + p for p in parts} | {"p:" + s for s in segments if s}
    return out | {"q:" + q.split("=")[0] for q in query}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_verdicts_match_brute_force(spark, seed):
    draw = random.Random(seed)
    urls = [f"http://{draw.choice('abc')}.{draw.choice('xyz')}/{draw.choice(['ads', 'news'])}/{draw.choice(['u', 'v'])}{draw.choice(['', '?k=1'])}" for _ in range(400)]
    # a page is bad by chance, more often on some token sets
    bad = [int(draw.random() < (0.7 if "a.x" in u and "ads" in u else 0.5 if "/v?" in u else 0.15)) for u in urls]
    n, count, confidence, lift = 300, 6, 0.45, 1.3
    tokens = [brute_tokens(u) for u in urls]
    both, alone = {}, {}
    for t, b in zip(tokens[:n], bad[:n], strict=True):
        for k in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), k):
                alone[s] = alone.get(s, 0) + 1
                both[s] = both.get(s, 0) + b
    rules = [set(s) for s, x in both.items() if x >= count and x / alone[s] >= confidence and x / alone[s] * n / sum(bad[:n]) >= lift]
    want = {i for i, t in enumerate(tokens) if any(r <= t for r in rules)}
    assert rules and 0 < len(want) < len(urls)
    # a clashing and a further column, a repeated label
    pages = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(urls)], "page_id long, url string, host string, more long")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad[:n])] + [(5, 0)], "doc_id long, toxic int")
    got = url_filter.filter_urls(pages, labels, [], min_support=0.0, min_count=count, min_confidence=confidence, min_lift=lift)
    assert {r["page_id"] for r in got.filter("verdict = 'block'").collect()} == want
    assert got.columns == ["page_id", "url", "host", "more", "path", "verdict", "rule"] and got.filter("host = 'h'").count() == 0
