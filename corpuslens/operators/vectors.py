"""Vector operators: scans by payload, norms, assignment to centroids, k-means and the elbow of its cost."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.materialize import fixed
from corpuslens.operators.relational import numbered


def by_payload(vectors: DataFrame, field: str, values: list) -> DataFrame:
    return vectors.filter(F.col(f"payload.{field}").isin(values))


def by_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_semi")


def first_n(vectors: DataFrame, n: int | None = None) -> DataFrame:
    return vectors if n is None else vectors.orderBy("id").limit(n)


def exactly_n(vectors: DataFrame, n: int) -> DataFrame:
    """The first n by id; fewer raise when the plan runs."""
    found = first_n(vectors, n)
    count = found.agg(F.assert_true(F.count(F.lit(1)) == n, F.lit("fewer vectors than asked for")).alias("_ok"))
    return found.crossJoin(F.broadcast(count)).filter("_ok is null").drop("_ok")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalized(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Rows of length 1; zero rows stay zero."""
    return vectors.withColumn("_n", norm(F.col(column))).withColumn(column, F.transform(column, lambda x: F.when(F.col("_n") > 0, x.cast("double") / F.col("_n")).otherwise(x.cast("double")))).drop("_n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest_centroid(vectors: DataFrame, centroids: list[tuple[int, list[float]]], column: str = "vector") -> DataFrame:
    """id, cluster: the nearest of a model's centroids (ties: least id).

    The centroids are the model (k times d numbers, on the driver as k-means
    leaves them); they reach each worker once, and vectors meet them in blocks
    of bounded size.
    """
    import numpy as np
    import pyarrow as pa

    order = sorted(centroids)
    names, table = np.array([i for i, _ in order], np.int64), np.array([c for _, c in order], float)
    model = vectors.sparkSession.sparkContext.broadcast((names, table))
    kind = vectors.schema["id"].dataType

    def run(batches):
        names, table = model.value
        block = max(1, 4_000_000 // table.size)
        for batch in batches:
            rows = [np.array(v, float) for v in batch.column("vector").to_pylist()]
            found = []
            for a in range(0, len(rows), block):
                some = np.stack(rows[a : a + block])
                found += names[((some[:, None, :] - table[None]) ** 2).sum(axis=2).argmin(axis=1)].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], names=["id", "cluster"])

    return vectors.select("id", F.col(column).alias("vector")).mapInArrow(run, f"id {kind.simpleString()}, cluster long")


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query_id, id, cosine, rank: each query's k nearest other vectors, exact.

    Every block of queries meets every block of vectors in a task of its own
    (about `block` rows each), which passes on its k best by query. All vectors
    have one length; zero vectors have no cosine and match nothing.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    m, n = (max(1, -(-rows.count() // block)) for rows in (queries, vectors))
    one = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(one(m).alias("i"), each(n).alias("j"), F.lit(True).alias("asks"), F.col("id").cast("long").alias("id"), "vector")
    right = vectors.select(each(m).alias("i"), one(n).alias("j"), F.lit(False).alias("asks"), F.col("id").cast("long").alias("id"), "vector")

    def best(rows):
        ids, table = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
        size = np.sqrt((table * table).sum(axis=1))
        asks = np.array([r[0] for r in rows])
        ask, have = np.flatnonzero(asks & (size > 0)), np.flatnonzero(~asks & (size > 0))
        if not len(ask) or not len(have):
            return
        for x in range(0, len(ask), 512):
            some = ask[x : x + 512]
            cosine = np.round(table[some] @ table[have].T / np.outer(size[some], size[have]), 6)
            for q, c in zip(ids[some].tolist(), cosine, strict=True):
                other = np.flatnonzero(ids[have] != q)
                if len(other) > k:
                    least = np.partition(c[other], len(other) - k)[len(other) - k]
                    other = other[c[other] >= least]
                order = other[np.lexsort((ids[have][other], -c[other]))][:k]
                yield from zip([q] * len(order), ids[have][order].tolist(), c[order].tolist(), strict=True)

    def run(batches):
        def out(rows):
            q, i, c = zip(*found, strict=True) if (found := list(best(rows))) else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "id", "cosine"])

        task, rows = None, []
        for batch in batches:
            values = batch.column("vector")
            for at, (i, j, asks, id_) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("i", "j", "asks", "id")], strict=True)):
                if (i, j) != task:
                    if rows:
                        yield out(rows)
                    task, rows = (i, j), []
                rows.append((asks, id_, values[at].values.to_numpy(zero_copy_only=False)))
        if rows:
            yield out(rows)

    scored = left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "query_id long, id long, cosine double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)


def hashed_encoder(dims: int = 256) -> Callable[[list[str]], list[list[float]]]:
    """The default encoder: signed hashed word and character-trigram counts, unit length."""
    import zlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            words = text.lower().split()
            for t in [*words, *[w[i : i + 3] for w in words for i in range(len(w) - 2)]]:
                h = zlib.crc32(t.encode())
                v[h % dims] += 1.0 if h >> 31 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out

    return encode


def embed(rows: DataFrame, cached: DataFrame | None = None, encoder: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """id, vector for rows (id, tag): cached vectors where there are any, else the encoder's; only missing ones are encoded."""
    encode = encoder or hashed_encoder()

    def run(batches) -> Iterator:
        for pdf in batches:
            yield pdf[["id"]].assign(vector=encode(pdf["tag"].fillna("").tolist()))

    missing = rows if cached is None else rows.join(cached.select("id"), "id", "left_anti")
    fresh = missing.select(F.col("id").cast("long").alias("id"), "tag").mapInPandas(run, "id long, vector array<float>")
    return fresh if cached is None else cached.join(rows.select("id"), "id", "left_semi").select("id", "vector").unionByName(fresh)


def kmeans_model(vectors: DataFrame, k: int, seed: int = 42, column: str = "vector"):
    """A k-means model of the normalised vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = l2_normalized(vectors, column).select("id", array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)


def packed(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """n, dims, keys, rows: blocks of normalised vectors as bytes (keys: a 64-bit hash of each row), dealt evenly, in the session's shared folder.

    All vectors must have one length and finite numbers.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n, lists = batch.num_rows, batch.column("vector")
            if not n:
                continue
            values = lists.flatten()
            table = values.to_numpy(zero_copy_only=False).astype(float)
            dims = len(table) // n
            if lists.null_count or len(set(np.diff(lists.offsets.to_numpy()).tolist())) > 1 or not np.isfinite(table).all():
                raise ValueError("vectors must have one length and finite numbers")
            table = table.reshape(n, dims)
            size = np.sqrt((table * table).sum(axis=1))
            table /= np.where(size > 0, size, 1.0)[:, None]
            keys = batch.column("key").to_numpy()
            for a in range(0, n, 4096):
                some = [pa.array([x]) for x in (len(keys[a : a + 4096]), dims, keys[a : a + 4096].tobytes(), table[a : a + 4096].tobytes())]
                yield pa.RecordBatch.from_arrays(some, names=["n", "dims", "keys", "rows"])

    rows = vectors.select(F.xxhash64("id", column).alias("key"), F.col(column).cast("array<double>").alias("vector"))
    return fixed(rows.repartition(vectors.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "n long, dims long, keys binary, rows binary"))


def nearest_in_tiles() -> Callable:
    """A function of rows and centres: each row's nearest centre (ties: the first) and squared distance."""
    import numpy as np

    def nearest(rows, centers, high=256, wide=1024):
        x = np.hstack([rows, np.ones((len(rows), 1))])
        c = np.vstack([-2 * centers.T, (centers * centers).sum(axis=1)])
        tiles = [np.ascontiguousarray(c[:, b : b + wide]) for b in range(0, len(centers), wide)]
        at, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        for a in range(0, len(rows), high):
            part, to = x[a : a + high], np.arange(len(x[a : a + high]))
            for b, tile in enumerate(tiles):
                found = part @ tile
                i = found.argmin(axis=1)
                value = found[to, i]
                better = value < least[a : a + high]
                at[a : a + high][better] = i[better] + b * wide
                least[a : a + high][better] = value[better]
        away = least + (rows * rows).sum(axis=1)
        return at, np.where(away > 1e-12, away, 0.0)

    return nearest


class Summary(NamedTuple):
    trainingCost: float
    numIter: int


class Clusters(NamedTuple):
    """centers: k (fewer if there are fewer distinct vectors) rows of the length of the vectors; summary: as of Spark's k-means."""

    centers: object
    summary: Summary


def kmeans_start(blocks: DataFrame, k: int, seed: int):
    """k rows by k-means++, in batches.

    Rows arrive by a Poisson process with their squared distance from the
    centres so far as rate; an arrival counts with the share of that distance
    left after those before it. So each round may add as many centres as there
    are, or more, and each row's draw depends on itself and the seed only.
    """
    import numpy as np
    import pyarrow as pa

    context, nearest = blocks.sparkSession.sparkContext, nearest_in_tiles()
    n, dims = blocks.agg(F.sum("n"), F.max("dims")).first()
    centers, bound, turn = np.zeros((0, dims)), 4.0 * n, 0

    def uniform(keys, salt):
        """Numbers in (0, 1) by splitmix64."""
        with np.errstate(over="ignore"):
            x = keys.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54

    while len(centers) < k:
        wanted = max(64.0, min(4.0 * len(centers), 1.5 * (k - len(centers)) + 32))
        sent, salt, until = context.broadcast(centers), 2 * (seed * 1000 + turn), wanted / bound

        def run(batches, sent=sent, salt=salt, until=until):
            total = 0.0
            kind = ["time", "rate", "draw", "row", "total"]
            for batch in batches:
                for dims, keys, rows in zip(*[batch.column(c).to_pylist() for c in ("dims", "keys", "rows")], strict=True):
                    keys, rows = np.frombuffer(keys, np.int64), np.frombuffer(rows).reshape(-1, dims)
                    # before the first centre, as far away as unit vectors can be
                    rate = nearest(rows, sent.value)[1] if len(sent.value) else np.full(len(rows), 4.0)
                    total += float(rate.sum())
                    with np.errstate(divide="ignore"):
                        time = -np.log(uniform(keys, salt)) / rate
                    came = np.flatnonzero(time < until)
                    if len(came):
                        draw = uniform(keys[came], salt + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(time[came]), pa.array(rate[came]), pa.array(draw), pa.array([r.tobytes() for r in rows[came]], pa.binary()), pa.array(np.zeros(len(came)))], names=kind)
            yield pa.RecordBatch.from_arrays([pa.array([np.inf]), pa.array([0.0]), pa.array([0.0]), pa.array([b""], pa.binary()), pa.array([total])], names=kind)

        got = blocks.mapInArrow(run, "time double, rate double, draw double, row binary, total double").toArrow()
        sent.destroy()
        bound = sum(got.column("total").to_pylist())
        if not bound:
            break
        time, rate, draw = (got.column(c).to_numpy() for c in ("time", "rate", "draw"))
        order = np.argsort(time, kind="stable")[: int(np.isfinite(time).sum())]
        raw, fresh = got.column("row"), np.zeros((0, dims))
        for a in range(0, len(order), 512):
            some = order[a : a + 512]
            rows = np.frombuffer(b"".join(raw[int(i)].as_py() for i in some)).reshape(-1, dims)
            left = np.minimum(rate[some], nearest(rows, fresh)[1]) if len(fresh) else rate[some].copy()
            apart = np.maximum(0.0, (rows * rows).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)[None] - 2 * rows @ rows.T)
            taken = []
            for i in range(len(some)):
                if left[i] > 1e-12 and draw[some[i]] * rate[some[i]] < left[i]:
                    taken.append(i)
                    left = np.minimum(left, apart[i])
            fresh = np.vstack([fresh, rows[taken]])
            if len(centers) + len(fresh) >= k:
                break
        centers, turn = np.vstack([centers, fresh])[:k], turn + 1
    return centers


def kmeans_step(blocks: DataFrame, centers, most: int = 64 << 20):
    """(sums, counts, cost): of the rows nearest to each centre; tasks' sums are added up by blocks of centres first where all of them take more than `most` bytes."""
    import numpy as np
    import pyarrow as pa

    nearest, sent = nearest_in_tiles(), blocks.sparkSession.sparkContext.broadcast(centers)
    kind, wide = "b long, at binary, n binary, s binary, cost double", 4096

    def out(sums, counts, cost, first=0):
        for b in range(0, len(counts), wide):
            at = np.flatnonzero(counts[b : b + wide]) + b
            some = [[(first + b) // wide], [(at + first).tobytes()], [counts[at].tobytes()], [sums[at].tobytes()], [0.0 if b else cost]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], names=["b", "at", "n", "s", "cost"])

    def run(batches):
        k, dims = sent.value.shape
        sums, counts, cost = np.zeros((k, dims)), np.zeros(k, np.int64), 0.0
        for batch in batches:
            for raw in batch.column("rows").to_pylist():
                rows = np.frombuffer(raw).reshape(-1, dims)
                at, away = nearest(rows, sent.value)
                order = np.argsort(at, kind="stable")
                which, start, size = np.unique(at[order], return_index=True, return_counts=True)
                sums[which] += np.add.reduceat(rows[order], start)
                counts[which] += size
                cost += float(away.sum())
        yield from out(sums, counts, cost)

    def added(found, sums, counts, first=0):
        cost = 0.0
        for at, n, s, c in found:
            at = np.frombuffer(at, np.int64) - first
            counts[at] += np.frombuffer(n, np.int64)
            sums[at] += np.frombuffer(s).reshape(-1, sums.shape[1])
            cost += c
        return cost

    def merged(batches):
        dims, blocks = sent.value.shape[1], {}
        for batch in batches:
            for b, *found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sums, counts, cost = blocks.get(b, (np.zeros((wide, dims)), np.zeros(wide, np.int64), 0.0))
                blocks[b] = sums, counts, cost + added([found], sums, counts, b * wide)
        for b, (sums, counts, cost) in blocks.items():
            yield from out(sums, counts, cost, b * wide)

    parts = blocks.mapInArrow(run, kind)
    if blocks.sparkSession.sparkContext.defaultParallelism * centers.nbytes > most:
        parts = parts.repartition("b").mapInArrow(merged, kind)
    got = parts.toArrow()
    sent.destroy()
    sums, counts = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
    cost = added(zip(*[got.column(c).to_pylist() for c in ("at", "n", "s", "cost")], strict=True), sums, counts)
    return sums, counts, cost


def kmeans_fit(blocks: DataFrame, k: int, seed: int = 42, most_steps: int = 20, tol: float = 1e-4) -> Clusters:
    """Lloyd's k-means over all rows of `packed` blocks, from k-means++; the cost is that of the centres returned.

    Steps and tolerance are those of Spark's k-means, whose k-means|| and table
    of distances between centres need a driver that grows with k squared.
    """
    import numpy as np

    centers, steps, moved = kmeans_start(blocks, k, seed), 0, math.inf
    while True:
        sums, counts, cost = kmeans_step(blocks, centers)
        if steps == most_steps or moved <= tol:
            return Clusters(centers, Summary(cost, steps))
        # a centre without rows stays where it is
        after = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        moved = float(np.sqrt(((after - centers) ** 2).sum(axis=1)).max())
        centers, steps = after, steps + 1


def kmeans_assign(model, vectors: DataFrame, column: str = "vector") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = l2_normalized(vectors, column).select("id", array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return model.transform(rows).select("id", "cluster")


def silhouette(assigned: DataFrame) -> float:
    """assigned: features and cluster."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(assigned)


def k_grid(n: int, least_members: int = 10, points: int = 30) -> list[int]:
    """Distinct cluster counts, evenly spaced in logarithm from 2 to n // least_members."""
    top = n // least_members
    if top < 2:
        return []
    step = (math.log10(top) - math.log10(2)) / max(1, points - 1)
    return sorted({int(round(10 ** (math.log10(2) + i * step), 9)) for i in range(points)})


def knee(xs: list[float], ys: list[float], sensitivity: float = 1.0) -> float | None:
    """The knee of a convex, decreasing curve, after Satopaa et al. 2011."""
    if len(xs) < 3 or max(ys) == min(ys):
        return None
    nx = [(x - xs[0]) / (xs[-1] - xs[0]) for x in xs]
    ny = [1 - (y - min(ys)) / (max(ys) - min(ys)) for y in ys]
    gap = [b - a for a, b in zip(nx, ny, strict=True)]
    mean_step = sum(b - a for a, b in zip(nx, nx[1:], strict=False)) / (len(nx) - 1)
    peaks = [i for i in range(1, len(gap) - 1) if gap[i] >= gap[i - 1] and gap[i] >= gap[i + 1]]
    for at, i in enumerate(peaks):
        stop = peaks[at + 1] if at + 1 < len(peaks) else len(gap)
        if any(gap[j] < gap[i] - sensitivity * mean_step for j in range(i + 1, stop)):
            return xs[i]
    return None


def elbow_search(vectors: DataFrame, n: int, least_members: int = 10, patience: int = 4, points: int = 30, seed: int = 42, ahead: int = 4) -> tuple[int | None, list[tuple[int, float]]]:
    """(knee, [(k, cost)]): fits k-means to the first n vectors by id along the grid; stops when the knee stays the same for `patience` more steps.

    `ahead` fits run at once, as one alone leaves workers idle between its short
    steps; those begun beyond the stop are left out.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    grid = k_grid(n, least_members, points)
    if not grid:
        return None, []
    # numbered, as a limit would leave all rows to one task
    rows = packed(numbered(vectors.select("id", "vector"), "id").filter(F.col("row_no") <= n))
    count, short, long = rows.agg(F.sum("n"), F.min("dims"), F.max("dims")).first()
    if count != n:
        raise ValueError("fewer vectors than asked for")
    if short != long:
        raise ValueError("vectors must have one length and finite numbers")
    curve: list[tuple[int, float]] = []
    found, same = None, 0
    with ThreadPoolExecutor(ahead) as pool:
        fits = [pool.submit(inheritable_thread_target(vectors.sparkSession)(lambda k=k: kmeans_fit(rows, k, seed))) for k in grid]
        try:
            for k, fit in zip(grid, fits, strict=True):
                curve.append((k, fit.result().summary.trainingCost))
                if len(curve) < 3:
                    continue
                now = knee([float(a) for a, _ in curve], [b for _, b in curve])
                same = same + 1 if now is not None and now == found else 0
                found = now
                if same >= patience:
                    break
        finally:
            for fit in fits:
                fit.cancel()
    return (None if found is None else int(found)), curve


def run_clustering(vectors: DataFrame, mode: str, k: int | None = None, model=None, **options):
    """search: the elbow; train: fit and assign the train split; test: assign the test split with a model."""
    if mode == "search":
        best, curve = elbow_search(vectors, vectors.count(), **options)
        if best is None:
            raise ValueError("no knee found")
        return best, curve
    if mode == "train":
        part = by_payload(vectors, "split", ["train"])
        model = kmeans_model(part, k) if model is None else model
        return model, kmeans_assign(model, part)
    if mode == "test":
        return model, kmeans_assign(model, by_payload(vectors, "split", ["test"]))
    raise ValueError(f"unknown mode {mode}")
