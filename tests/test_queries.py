"""Each registered query against its SQL on the smallest tables."""

import os

import pytest

from corpuslens.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def normal(df):
    return sorted(tuple("null" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) for row in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_cosine_search_covers_all_due_rows(spark):
    import numpy as np

    from corpuslens.operators import vectors
    from corpuslens.plans import standins

    due = {r[0] for r in standins.vectors(spark, SF).filter("id % 50 = 0").select("id").collect()}
    assert len(due) > 1 and {r[0] for r in catalog.QUERIES["cosine_topk_due"](spark, SF).select("query_id").distinct().collect()} == due
    data = np.random.default_rng(1).normal(size=(200, 8)).round(1)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "id long, vector array<double>")
    got = sorted(map(tuple, vectors.cosine_topk(table.filter("id % 5 = 0"), table, 3, block=16).select("query_id", "rank", "id").collect()))
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    near = {q: sorted((i for i in range(200) if i != q), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:3] for q in range(0, 200, 5)}
    assert got == [(q, r + 1, i) for q in near for r, i in enumerate(near[q])]


def test_elbow_curve_takes_the_whole_grid_and_returns_the_knee(spark, monkeypatch):
    from types import SimpleNamespace

    from corpuslens.operators import vectors
    from corpuslens.plans import standins

    # a straight line has no knee, so the search never stops early
    monkeypatch.setattr(vectors, "kmeans_fit", lambda rows, k, seed: SimpleNamespace(summary=SimpleNamespace(trainingCost=-float(k))))
    got = catalog.QUERIES["elbow_curve"](spark, SF).orderBy("k").collect()
    assert [r["k"] for r in got] == vectors.k_grid(standins.vectors(spark, SF).count()) and {r["knee"] for r in got} == {None}
    monkeypatch.setattr(vectors, "kmeans_fit", lambda rows, k, seed: SimpleNamespace(summary=SimpleNamespace(trainingCost=100.0 / k)))
    got = catalog.QUERIES["elbow_curve"](spark, SF).orderBy("k").collect()
    assert {r["knee"] for r in got} == {int(vectors.knee([float(r["k"]) for r in got], [r["inertia"] for r in got]))}


def test_softmax_takes_the_whole_vector(spark):
    from corpuslens.plans import standins

    want = {r["id"]: r["vector"].index(max(r["vector"])) for r in standins.vectors(spark, SF).select("id", "vector").collect()}
    assert {r["id"]: r["class"] for r in catalog.QUERIES["softmax_argmax_whole"](spark, SF).collect()} == want and max(want.values()) > 2
