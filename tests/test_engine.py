"""The repository engine on small fixtures and golden values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.functions import chunker, code, text
from corpuslens.operators import annotate, classify, dml, encode, metrics, prompts, relational, rollup, splits, vectors
from corpuslens.sources import files as sources


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


# --- roll-up, histogram, encoding -----------------------------------------


def test_rollup_semantics(spark):
    files = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 2, True), (4, 2, False)], "file_id int, repository_id int, processed boolean")
    snippets = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 2, True), (4, 2, False), (5, 3, None)], "snippet_id int, file_id int, processed boolean")
    repositories = spark.createDataFrame([(1, False), (2, False), (3, False)], "repository_id int, processed boolean")
    done, up = rollup.backfill(repositories, files, snippets)
    assert rows(done.select("file_id", "processed"), "file_id") == [(1, True), (2, False), (3, False), (4, True)]
    assert rows(up.select("repository_id", "processed"), "repository_id") == [(1, False), (2, False), (3, True)]
    again, up2 = rollup.backfill(up, done, snippets)
    assert rows(again, "file_id") == rows(done, "file_id") and rows(up2, "repository_id") == rows(up, "repository_id")
    strict = rollup.rolled_up(files, snippets, "file_id", empty_as_processed=False)
    assert rows(strict.filter("file_id = 4").select("processed")) == [(False,)]


def test_histogram_keeps_empty_repositories(spark):
    repositories = spark.createDataFrame([(1, "benign", True), (2, None, True), (3, "worm", True), (4, "worm", False)], "repository_id int, label string, processed boolean")
    files = spark.createDataFrame([(1, 1), (2, 3), (3, 4)], "file_id int, repository_id int")
    snippets = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "snippet_id int, file_id int")
    found = spark.createDataFrame([(1, 0), (1, 0), (1, None), (2, 5), (4, 1)], "snippet_id int, cluster_id int")
    clusters = relational.repository_clusters(repositories, relational.cluster_counts(found, snippets, files))
    got = {r[0]: (r[1], r[2]) for r in relational.with_binary_label(relational.repository_histograms(clusters)).collect()}
    assert got == {1: ("benign", {0: 2, 5: 1}), 2: ("malicious", None), 3: ("malicious", None)}


def test_encoding(spark):
    counts = spark.createDataFrame([(1, 0, 3), (1, 4, 1), (1, 2, 0), (2, 1, 5)], "repository_id int, cluster_id int, cnt long")
    shares = encode.percentages(encode.validated(counts, 5))
    assert rows(shares.select("repository_id", "cluster_id", "pct"), "repository_id", "cluster_id") == [(1, 0, 0.75), (1, 4, 0.25), (2, 1, 1.0)]
    norm = encode.frobenius_scaled(shares).agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    assert math.isclose(norm, 1)
    for bad in ([(1, 5, 1)], [(1, -1, 1)], [(1, 0, -2)]):
        with pytest.raises(Exception, match="out of range"):
            encode.validated(spark.createDataFrame(bad, "repository_id int, cluster_id int, cnt long"), 5).collect()
    top = encode.top_clusters(spark.createDataFrame([(1, 9, 2), (1, 3, 2), (1, 1, 4), (1, 99, 50), (1, -3, 7)], "repository_id int, cluster_id int, cnt long"), 2, k=10)
    assert [(r["cluster_id"], round(r["weight"], 6)) for r in top.orderBy("rank").collect()] == [(1, round(4 / 6, 6)), (3, round(2 / 6, 6))]
    assert [r[1] for r in rows(encode.decoded(shares, 0.5), "repository_id")] == [0, 1]
    vector = encode.sparse_features(spark.createDataFrame([(1,), (7,)], "repository_id int"), shares, 5, "pct").orderBy("repository_id").collect()
    assert vector[0]["features"].toArray().tolist() == [0.75, 0, 0, 0, 0.25] and vector[1]["features"].numNonzeros() == 0


def test_label_map():
    assert schemas.label_map({"0": "a", 1: "b"}) == {0: "a", 1: "b"}
    assert schemas.label_map([{0: "a"}, {1: "b"}]) == {0: "a", 1: "b"}
    assert schemas.label_map("nonsense") == schemas.label_map(None) == {0: "benign", 1: "malicious"}


# --- changes --------------------------------------------------------------


def test_partial_updates(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, s string, n int")
    changes = spark.createDataFrame([(1, None, None, 1), (2, "x", None, 1), (2, None, 9, 2), (2, "y", None, 3), (8, "z", 1, 1)], "id int, s string, n int, at int")
    merged = dml.merge_update(base, dml.collapse_updates(changes, "id", "at"), "id")
    assert rows(merged, "id") == [(1, "a", 1), (2, "y", 9), (3, None, 3)]
    assert rows(dml.changed_rows(base, merged, "id", ["s", "n"]), "id") == [(2, "y", 9)]
    stamped = base.withColumn("at", F.lit("old"))
    out = dml.merge_update(stamped, dml.collapse_updates(changes, "id", "at"), "id", "at", F.lit("new"))
    assert [r[3] for r in rows(out, "id")] == ["old", "new", "old"]


def test_insert_upsert_delete(spark):
    base = spark.createDataFrame([(4, "a")], "id int, name string")
    new = spark.createDataFrame([("c", 2), ("b", 1)], "name string, at int")
    assert rows(dml.insert(base, new, "id", "at"), "id") == [(4, "a"), (5, "b"), (6, "c")]
    assert rows(dml.upsert(base, spark.createDataFrame([(4, "z"), (7, "y")], "id int, name string"), "id"), "id") == [(4, "z"), (7, "y")]
    good, bad = dml.split_valid(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"), F.col("name").isNotNull() & (F.col("name") != ""))
    assert rows(good) == [(1, "a")] and rows(bad) == [(2, None)]
    seen = spark.createDataFrame([("r", "late", 2), ("r", "first", 1), ("old", "x", 0)], "name string, label string, at int")
    assert rows(dml.get_or_create(spark.createDataFrame([("old",)], "name string"), seen, "at").select("name", "label")) == [("r", "first")]


def test_delete_cascades_from_the_middle(spark):
    tables = {"repositories": spark.createDataFrame([(1,)], "repository_id int"), "files": spark.createDataFrame([(1, 1), (2, 1)], "file_id int, repository_id int"), "snippets": spark.createDataFrame([(1, 1), (2, 2)], "snippet_id int, file_id int"), "functionalities": spark.createDataFrame([(1, 1), (2, 2)], "functionality_id int, snippet_id int")}
    left = dml.delete_cascade(tables, "files", spark.createDataFrame([(1,)], "file_id int"), schemas.TREE)
    assert [left[t].count() for t in ("repositories", "files", "snippets", "functionalities")] == [1, 1, 1, 1]
    last = dml.delete_cascade(tables, "functionalities", spark.createDataFrame([(1,)], "functionality_id int"), schemas.TREE)
    assert [last[t].count() for t in ("files", "snippets", "functionalities")] == [2, 2, 1]


def test_lookup_of_a_repeated_key_raises(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id int, s string")
    assert rows(relational.point_lookup(twice, "s", "a")) == [(1, "a")]
    assert relational.point_lookup(twice, "id", 5).count() == 0
    with pytest.raises(Exception, match="more than one"):
        relational.point_lookup(twice, "id", 1).collect()


# --- text -----------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, "a\r\nb\rc", text.normalize_eol) == "a\nb\nc\n"
    assert one(spark, " a \t  b\n", text.collapse_whitespace) == "a b"
    assert one(spark, "\n a\n\n \nb \n", text.drop_blank_lines) == "a\nb"
    assert one(spark, "aé日b", text.strip_non_ascii) == "ab"
    assert one(spark, "1\n2\n3\n", lambda x: text.truncate_lines(x, 2)) == "1\n2\n... [truncated, total lines: 3]"
    assert one(spark, "int main(void) {", text.function_name) == "main"
    assert one(spark, "x = 1;", text.function_name) == "unknown"
    assert one(spark, "org/model-a", text.collection_name) == "org_model-a"
    assert one(spark, "/x/functionalities_12.json", text.snippet_id_of_file) == 12
    data = spark.createDataFrame([(b"a\x00\xc3\xa9",), (b"\xe9\x00",)], "b binary")
    assert [r[0] for r in data.select(text.decode_bytes(F.col("b"))).collect()] == ["aé", "é"]


def test_annotation_parser(spark):
    said = "1: Load file; Decrypt; Run\n2:  a: b ;; a: b; c \n3: None\nno colon\nx: y\n4:\n5: none; other\n1: Last wins\n -7 : minus"
    got = {r["snippet_id"]: r["items"] for r in annotate.parsed(spark.createDataFrame([(said,)], "output string")).collect()}
    assert got == {1: ["Last wins"], 2: ["a: b", "a: b", "c"], 3: [], 4: [], 5: ["none", "other"], -7: ["minus"]}
    snippets = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "snippet_id int, processed boolean")
    parsed = annotate.parsed(spark.createDataFrame([(said,)], "output string"))
    found = annotate.new_functionalities(parsed, snippets)
    assert rows(found.select("snippet_id", "ordinal", "description"), "snippet_id", "ordinal") == [(1, 0, "Last wins"), (2, 0, "a: b"), (2, 1, "c")]
    marked = annotate.mark_processed(snippets, parsed)
    assert [r[1] for r in rows(marked, "snippet_id")] == [True] * 4
    assert annotate.new_functionalities(parsed, marked).count() == 0


def test_report_sections(spark):
    report = "intro **Chunk 1** code\nFunctionalities: Loads a file. Runs it! **Chunk 2** nothing **Chunk 3**\nFunctionalities:\n One only?"
    got = one(spark, report, text.report_sections)
    assert [(x["chunk"], x["sentences"]) for x in got] == [("Chunk 1", ["Loads a file.", "Runs it!"]), ("Chunk 2", []), ("Chunk 3", ["One only?"])]


def test_softmax_and_argmax(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>").select(text.softmax(F.col("v")).alias("p")).select("p", text.argmax(F.col("p")).alias("a")).first()
    assert math.isclose(sum(row["p"]), 1) and row["a"] == 1


# --- code -----------------------------------------------------------------


def test_scrubbing_and_literals():
    blob = "A" * 250
    assert re.fullmatch(r"x = \[ENCODED_BLOB len=250 sha256=[0-9a-f]{12}\];", code.scrub_blobs(f'x = "{blob}";'))
    assert code.scrub_blobs("'" + "A" * 199 + "'") == "'" + "A" * 199 + "'"
    assert code.ascii_literals("é = 'aéb' + \"c\\\"ü\" + 'open\né'") == "é = 'ab' + \"c\\\"\" + 'open\né'"


@pytest.mark.parametrize(
    "language,before,after",
    [
        ("c", 'int a; // x\n/* y\nz */ char *s = "// no";', 'int a; \n char *s = "// no";'),
        ("python", '#!/bin/py\n"""doc"""\nx = "# no"  # yes\ny = f("""kept""")\n', '#!/bin/py\n\nx = "# no"  \ny = f("""kept""")\n'),
        ("javascript", '"use strict";\nlet a = `// no`; // yes', "\nlet a = `// no`; "),
        ("html", "<p>a<!-- b\nc --></p>", "<p>a</p>"),
        ("bash", "#!/bin/sh\necho '# no' # yes", "#!/bin/sh\necho '# no' "),
    ],
)
def test_comment_stripping(language, before, after):
    assert code.strip_comments(before, language) == after
    assert code.strip_comments(after, language) == after


def test_spans():
    assert code.merged([(5, 7), (1, 3), (3, 4), (6, 9)]) == [(1, 4), (5, 9)]
    assert code.without([(0, 10), (12, 15)], 3, 13) == [(0, 3), (13, 15)]
    assert code.strip_comments("# head\n# more\nx # y\n", "python", header_lines=1) == "# head\n\nx \n"


def test_syntax_elements():
    calls, controls, strings = code.syntax_elements("def f(x):\n    if g(x):\n        return os.run('a')  # h(1)\n", "python")
    assert (calls, controls, strings) == (["g", "os.run"], ["if_statement"], ["'a'"])


def test_chunks_cut_before_definitions_and_cover_all_lines():
    source = "import a\nx = 1\n" + "".join(f"# about f{i}\ndef f{i}():\n    return '{'v' * 60}'\n\n" for i in range(8)) + "last = 1\n"
    chunks = list(chunker.chunk_code(source, "python", 40, remove_comments=False))
    lines = source.split("\n")
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert all(b[2] == a[3] + 1 for a, b in zip(chunks, chunks[1:], strict=False)) and chunks[0][2] == 1
    assert all(lines[c[2] - 1].startswith("# about") for c in chunks[1:])
    covered = {i for c in chunks for i in range(c[2] - 1, c[3])}
    assert all(i in covered for i, x in enumerate(lines) if x.strip())


def test_chunker_rules():
    analyzer = lambda *_: ([0, 3, 6], [2, 5])
    assert chunker.cut_rows([0, 3, 6, 1], [2, 5, 0]) == [1, 2, 5]
    ten = lambda line: 10
    source = "\n".join("abcdefgh")
    got = [(c[2], c[3]) for c in chunker.chunk_code(source, "c", 30, False, ten, analyzer)]
    # lines 4.. ride along uncounted after a cut; without a cut the budget is exceeded
    assert got == [(1, 2), (3, 5), (6, 8)]
    assert [(c[2], c[3]) for c in chunker.chunk_code("a\nb\n\n", "c", 1, False, ten, lambda *_: ([], []))] == [(1, 2)]
    assert list(chunker.chunk_code("\n\n", "c")) == []


def test_chunk_failures_go_to_dead_letters(spark):
    files = spark.createDataFrame([(1, "python", "x = 1\n"), (2, "klingon", "x"), (3, "c", None)], "file_id long, language string, source string")
    chunks, failed = chunker.chunk_files(files)
    assert [r["file_id"] for r in chunks.collect()] == [1] and [r["file_id"] for r in failed.collect()] == [2]


def test_tags_and_tokens():
    assert code.normalize_tag("Opens the Files, and writes boxes!") == "open file write box"
    assert code.count_tokens("") == 0 and code.count_tokens("hello world") < code.count_tokens("hello world, again")


# --- prompts, sources -----------------------------------------------------


def test_prompt_batches_and_requests(spark, tmp_path):
    blocks = spark.createDataFrame([(i, f"block {i} €") for i in range(1, 8)], "snippet_id int, block string")
    made = prompts.prompt_batches(blocks, per_prompt=2, per_file=3, template="Say:\n${code_snippets}\nend")
    got = rows(made.select("file_no", "custom_no", "prompt"), "file_no", "custom_no")
    assert [x[:2] for x in got] == [(0, 1), (0, 2), (0, 3), (1, 1)]
    assert got[0][2] == "Say:\nblock 1 €\n\nblock 2 €\nend"
    prompts.write_requests(prompts.request_lines(made, "m"), f"{tmp_path}/requests")
    lines = spark.read.text(f"{tmp_path}/requests").collect()
    assert len(lines) == 4 and all('"url":"/v1/responses"' in r[0] and "€" in r[0] for r in lines)


def test_prompt_block(spark):
    snippet = spark.createDataFrame([(5, "a/b.c", "c", "int f(int x) {\n  g(x);\n  if (x) return 1;\n}\n")], "snippet_id int, filepath string, language string, code string")
    block = prompts.snippet_blocks(snippet).first()["block"]
    assert block.startswith("Snippet ID: 5\nFile: a/b.c\nFunction: f\nLanguage: c\nAST Elements:\n  - Function Calls: [")
    assert "  - Control Structures: [if_statement]\n\n--- Begin Code ---\nint f(int x) {" in block and block.endswith("}\n--- End Code ---")


def test_tree_scan(spark, tmp_path):
    for path, data in {"worm/repo/__init__.py": b"x = 'a\xc3\xa9'\r\n", "worm/repo/._x.py": b"no", "worm/repo/X.PY": b"no", "benign/repo/b.c": b"\xe9\x00;", "top.py": b"1", "worm/file.py": b"2"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {r["path"]: (r["repository"], r["label"], r["language"], r["source"]) for r in sources.scan_sources(spark, str(tmp_path)).collect()}
    root = tmp_path.name
    assert got == {"worm/repo/__init__.py": ("repo", "worm", "python", "x = 'a'\n"), "benign/repo/b.c": ("repo", "benign", "c", "é;\n"), "top.py": (root, root, "python", "1\n"), "worm/file.py": ("file.py", "worm", "python", "2\n")}


def test_jsonl_and_cache(spark, tmp_path):
    good = '{"response": {"body": {"output": [{}, {"content": [{"text": "1: a; b"}]}]}}}'
    (tmp_path / "r.jsonl").write_text(good + '\n\n{"response": 1}\nnot json\n')
    texts, dead = sources.response_texts(sources.read_jsonl(spark, str(tmp_path)))
    assert [r["output"] for r in texts.collect()] == ["1: a; b"] and dead.count() == 1
    (tmp_path / "functionalities_3.json").write_text('[{"description": "a", "tag": "b"}]')
    (tmp_path / "functionalities_4.json").write_text("[]")
    assert [(r[0], len(r[1])) for r in rows(sources.cached_annotations(spark, str(tmp_path)), "snippet_id")] == [(3, 1), (4, 0)]
    functions = spark.createDataFrame([("o/r", "a.py", 2, "two"), ("p/r", "a.py", 1, "one\r\n")], "repository_name string, func_path string, ordinal int, code string")
    assert rows(sources.appended_functions(functions)) == [("benign/r/a.py", "one\n\n\ntwo\n\n\n")]


def test_retries():
    waits, calls = [], []

    def fails(prompt):
        calls.append(prompt)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert annotate.with_retry(fails, sleep=waits.append, draw=lambda: 0.5, most=2)("p") == "ok"
    assert waits == [1, 1.5, 2]
    with pytest.raises(OSError):
        annotate.with_retry(lambda _: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)("p")


def test_batch_jobs(tmp_path):
    from corpuslens.operators.batch_jobs import Service, run_jobs

    polls = {}

    def status(job):
        polls[job] = polls.get(job, 0) + 1
        if job == "job:slow":
            return {"state": "in_progress"}
        return {"state": "completed" if polls[job] > 2 else "in_progress", "output": f"out:{job}", "error": None}

    def upload(path):
        if path.endswith("bad"):
            raise OSError("no such file")
        return path.rsplit("/", 1)[-1].split(".")[0]

    service = Service(upload, lambda f: f"job:{f}", status, lambda f: f.encode())
    got = run_jobs(service, ["d/b.jsonl", "d/a.jsonl", "d/slow.jsonl", "d/bad"], str(tmp_path), at_once=3, poll_s=1, most_s=5, sleep=lambda _: None)
    assert [x["state"] for x in got] == ["completed", "completed", "error: no such file", "timeout"]
    assert (tmp_path / "a_output.jsonl").read_bytes() == b"out:job:a"


# --- splits, metrics, vectors, model --------------------------------------


def test_splits_are_exact_and_disjoint(spark):
    table = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(100)], "id int, label string")
    parts = splits.stratified_split(table, "id", "label", 0.3)
    assert rows(parts.groupBy("label", "split").count(), "label", "split") == [("a", "test", 21), ("a", "train", 49), ("b", "test", 9), ("b", "train", 21)]
    assert {r[0] for r in splits.stratified_split(table, "id", "label", 1.0).select("split").collect()} == {"test"}
    with pytest.raises(ValueError):
        splits.stratified_split(table, "id", "label", 0.3, 0.5)
    assert {r["count"] for r in splits.kfold(table, "id", "label").groupBy("fold").count().collect()} == {20}
    assert rows(splits.balanced(table, "id", "label").groupBy("label").count(), "label") == [("a", 30), ("b", 30)]
    drawn = {r[0]: r[1] for r in splits.weighted_sample(table, "label").groupBy("label").count().collect()}
    assert abs(drawn["a"] - 50) < 20 and abs(drawn["b"] - 50) < 20


@pytest.mark.parametrize(
    "matrix,accuracy,macro,weighted,malicious",
    [
        ([[7278, 75], [7, 374]], 0.9894, 0.9478, 0.9898, (0.8330, 0.9816, 0.9012)),
        ([[3438, 65], [23, 158]], 0.9761, 0.8848, 0.9773, (0.7085, 0.8729, 0.7822)),
        ([[5, 0], [0, 8]], 1.0, 1.0, 1.0, (1.0, 1.0, 1.0)),
    ],
)
def test_published_matrices(spark, matrix, accuracy, macro, weighted, malicious):
    cells = spark.createDataFrame([(t, p, matrix[t][p]) for t in (0, 1) for p in (0, 1)], "truth int, pred int, n long")
    got = metrics.summary(cells).first()
    assert [round(got[c], 4) for c in ("accuracy", "macro_f1", "weighted_f1")] == [accuracy, macro, weighted]
    assert tuple(round(x, 4) for x in metrics.per_class(cells).filter("class = 1").first()[2:]) == malicious


def test_roc_and_auc(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.05)], "truth int, score double")
    a = metrics.auc(scored).first()[0]
    b = metrics.auc(scored.withColumn("score", -F.col("score"))).first()[0]
    pairs = [(p, n) for p in (0.9, 0.5, 0.1) for n in (0.9, 0.1, 0.05)]
    assert math.isclose(a, sum((p > n) + 0.5 * (p == n) for p, n in pairs) / 9) and math.isclose(a + b, 1)
    points = metrics.roc_points(scored).orderBy(F.desc("threshold")).collect()
    assert points[0]["threshold"] == math.inf and (points[-1]["tpr"], points[-1]["fpr"]) == (1, 1)
    assert metrics.auc(scored.filter("truth = 1")).first()[0] is None


def test_vectors(spark):
    table = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, vector array<float>")
    assert [[round(x, 6) for x in r["vector"]] for r in vectors.l2_normalized(table).orderBy("id").collect()] == [[0.6, 0.8], [0, 0]]
    assert rows(vectors.nearest_centroid(table, [(0, [0.0, 0.0]), (1, [3.0, 3.0])]), "id") == [(1, 1), (2, 0)]
    with pytest.raises(Exception, match="fewer vectors"):
        vectors.exactly_n(table, 3).collect()
    texts = spark.createDataFrame([(1, "open file"), (9, "open file"), (3, None)], "id long, tag string")
    out = {r["id"]: r["vector"] for r in vectors.embed(texts, table).collect()}
    assert out[1] == [3.0, 4.0] and len(out[9]) == 256 and set(out) == {1, 9, 3}


def test_kmeans_fits_all_rows_in_all_tasks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(3000, 6)) + 4 * rng.normal(size=(7, 6))[rng.integers(0, 7, 3000)]
    data[:5] = 0
    table = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "id long, vector array<double>")
    unit = data / np.where((size := np.linalg.norm(data, axis=1)) > 0, size, 1)[:, None]
    away = lambda c: ((unit[:, None] - c[None]) ** 2).sum(axis=2)
    blocks = vectors.packed(table)
    assert sum(r["n"] > 0 for r in blocks.collect()) == blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    for k in (1, 7, 300):
        start = vectors.kmeans_start(blocks, k, 42)
        assert start.shape == (k, 6) and len(np.unique(start, axis=0)) == k and np.allclose(away(start).min(axis=0), 0)
        assert (start == vectors.kmeans_start(blocks.repartition(3), k, 42)).all()
        for c in (start, start + 0.01):
            found, want = vectors.kmeans_step(blocks, c), away(c).argmin(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, want, unit)
            for got in (found, vectors.kmeans_step(blocks, c, most=0)):
                assert np.allclose(got[0], sums) and (got[1] == np.bincount(want, minlength=k)).all() and np.isclose(got[2], away(c).min(axis=1).sum())
        centers = start
        for _ in range(20):
            centers = np.stack([unit[at == j].mean(axis=0) if (at == j).any() else centers[j] for at in [away(centers).argmin(axis=1)] for j in range(k)])
        fit = vectors.kmeans_fit(blocks, k)
        assert np.isclose(fit.summary.trainingCost, away(centers).min(axis=1).sum(), rtol=1e-3) and np.isclose(fit.summary.trainingCost, away(fit.centers).min(axis=1).sum())
    assert len(vectors.kmeans_fit(vectors.packed(table.filter("id < 6")), 4).centers) == 2  # zeros and one other


def test_elbow_search_deals_the_first_n_rows_to_all_tasks(spark, monkeypatch):
    from types import SimpleNamespace

    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "id long, vector array<double>")
    seen = []
    monkeypatch.setattr(vectors, "kmeans_fit", lambda rows, k, seed: seen.append(rows) or SimpleNamespace(summary=SimpleNamespace(trainingCost=-float(k))))
    vectors.elbow_search(table, 300)
    assert seen[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert {id(x) for x in seen} == {id(seen[0])} and seen[0].agg({"n": "sum"}).first()[0] == 300
    assert vectors.elbow_search(table.limit(0), 0) == (None, [])
    with pytest.raises(ValueError, match="fewer"):
        vectors.elbow_search(table, 500)
    with pytest.raises(Exception, match="one length"):
        vectors.elbow_search(table.selectExpr("id", "if(id = 7, array(1D), vector) vector"), 400)


def test_knee_and_grid():
    assert vectors.k_grid(1000, 10, 5) == [2, 5, 14, 37, 100] and vectors.k_grid(10, 10) == []
    xs = [float(x) for x in range(1, 21)]
    assert vectors.knee(xs, [100 / x for x in xs]) in (3.0, 4.0, 5.0)
    assert vectors.knee(xs[:2], [1, 0]) is None and vectors.knee(xs, [1.0] * 20) is None


def test_classifier_and_attribution(spark):
    from pyspark.ml.linalg import Vectors

    data = [(i, "benign" if i % 4 else "worm", float(i % 4 == 0), Vectors.dense([float(i % 4 == 0) + 0.01 * i / 60, 1.0])) for i in range(60)]
    table = spark.createDataFrame(data, ["repository_id", "label", "y", "features"])
    model = classify.fit(table)
    said = classify.predict(model, relational.with_binary_label(table))
    assert said.filter("label <> prediction").count() == 0
    names = spark.createDataFrame([(i, f"r{i}") for i in range(60)], ["repository_id", "name"])
    assert classify.checked_predictions(said, names).count() == 60
    with pytest.raises(Exception, match="without repository"):
        classify.checked_predictions(said, names.limit(1)).collect()
    long = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0), (1, 1, 5.0), (2, 1, 5.0)], "id int, feature int, x double")
    weights = spark.createDataFrame([(0, 2.0), (1, 9.0)], "feature int, w double")
    found = classify.linear_attribution(long, weights)
    assert rows(found.filter("feature = 0").select("id", "attribution"), "id") == [(1, -2.0), (2, 2.0)]
    titles = classify.top_features(found.filter("id = 2"), 1, spark.createDataFrame([(0, "reads")], "feature int, name string")).first()
    assert titles["title"] == "[0] reads"


def test_streaming_queue(spark, tmp_path):
    from corpuslens.streaming import queue

    table = spark.createDataFrame([(1, False), (2, True), (3, None), (1, False)], "snippet_id int, processed boolean")
    table.write.parquet(f"{tmp_path}/in")
    seen = []
    pending = queue.pending_stream(spark, f"{tmp_path}/in", table.schema)
    queue.work_queue(pending, lambda df, _: seen.extend(r[0] for r in df.select("snippet_id").collect()), f"{tmp_path}/state").awaitTermination()
    queue.work_queue(queue.pending_stream(spark, f"{tmp_path}/in", table.schema), lambda df, _: seen.extend(r[0] for r in df.select("snippet_id").collect()), f"{tmp_path}/state").awaitTermination()
    assert seen == [1]


def test_command_line_from_tree_to_metrics(spark, tmp_path):
    from corpuslens import cli

    for i in range(12):
        kind, calls = ("benign", "open(x); read(x)") if i % 2 else ("worm", "connect(x); send(x)")
        place = tmp_path / "tree" / kind / f"repo{i}"
        place.mkdir(parents=True)
        (place / "main.c").write_text(f"int f{i}(int x) {{\n  {calls};\n  return {i};\n}}\n")
    work = str(tmp_path / "work")
    cli.main(["load", str(tmp_path / "tree"), work])
    cli.main(["load", str(tmp_path / "tree"), work])  # again: nothing new
    store = cli.Store(spark, work)
    assert (store.read("repositories").count(), store.read("files").count(), store.read("snippets").count()) == (12, 12, 12)
    cli.main(["annotate", work])
    n = store.read("functionalities").count()
    cli.main(["annotate", work])
    assert n == store.read("functionalities").count() == 24 and store.read("repositories").filter("processed").count() == 12
    cli.main(["split", work, "--test", "0.5"])
    cli.main(["train", work, "-k", "2"])
    cli.main(["test", work, "-k", "2"])
    assert spark.read.json(f"{work}/metrics/summary").first()["accuracy"] == 1.0
