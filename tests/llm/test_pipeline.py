"""The pipeline on a small table: each stage's effect, and the columns of documents."""

import random

import corpus_pipeline
import __spark_entry__


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    prose = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(n // 12))
    texts = [prose(120) for _ in range(60)]
    texts[7] = texts[3]  # a copy
    item = " ".join(r.choice(vocabulary) for _ in range(14))
    texts[9] = texts[9] + "\n" + item
    texts[11] = "too short"
    texts[13] = texts[13] + "\na line that comes twice in all"
    texts[14] = texts[14] + "\na line that comes twice in all"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(90, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept.append({x["doc_id"] for x in docs.collect()})
    everything = set(range(60))
    assert kept[0] == everything - {11}
    lines = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{tmp_path}/line_dedup").collect()}
    assert "comes twice" in lines[13] and "comes twice" not in lines[14] and lines[7] == ""
    assert kept[2] == kept[1]  # the copy's lines are gone, so it is empty and links with nothing
    assert kept[3] == everything - {11, 9}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in packed.select("doc_id").distinct().collect()} == kept[3]


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_odd_tables(spark, tmp_path):
    r = random.Random(2)
    prose = lambda: "\n".join(" ".join(f"v{r.randrange(300)}" for _ in range(12)) for _ in range(6))
    texts = [prose() for _ in range(12)]
    rows = [(i, t, 5, "k") for i, t in enumerate(texts)] + [(3, prose(), 6, "k"), (None, prose(), 7, "k"), (None, None, 8, "k"), (50, "", 9, "k"), (4, texts[4], 5, "k")]
    kind = "doc_id long, text string, n_lines int, Items string"  # no lang, no source, no n_chars; clashing names
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "n_lines", "Items"]
    kept = docs.collect()
    assert {x["n_lines"] for x in kept} == {5, 6, 7} and {x["Items"] for x in kept} == {"k"}
    assert sorted(x["doc_id"] for x in kept if x["doc_id"] is not None) == sorted([*range(12), 3, 4])
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
