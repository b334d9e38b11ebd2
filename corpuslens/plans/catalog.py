"""The registered queries of the repository engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.functions import chunker, code, text
from corpuslens.operators import annotate, classify, dml, encode, metrics, prompts, relational, rollup, splits, vectors
from corpuslens.plans import standins as S
from corpuslens.sources import files as sources
from corpuslens.streaming import queue

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = S.SQL + sql
        return f

    return add


def counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.cluster_counts(S.functionalities(spark, d), S.snippets(spark, d), S.files(spark, d))


# --- the repository tree ---------------------------------------------------


@query("""SELECT r.repository_id, CASE WHEN label = 'benign' THEN 'benign' ELSE 'malicious' END AS label, cluster_id, cnt,
  round(cnt / sum(cnt) OVER (PARTITION BY r.repository_id), 9) AS pct
FROM repositories r LEFT JOIN counts c ON r.repository_id = c.repository_id WHERE processed""")
def repo_cluster_histogram(spark, d):
    rows = relational.with_binary_label(relational.repository_clusters(S.repositories(spark, d), counts(spark, d)))
    return encode.percentages(rows).withColumn("pct", F.round("pct", 9))


@query("""SELECT r.repository_id, label, count(cluster_id)::BIGINT AS clusters, coalesce(sum(cnt), 0)::BIGINT AS total
FROM repositories r LEFT JOIN counts c ON r.repository_id = c.repository_id WHERE processed AND split = 'train' GROUP BY ALL""")
def repo_histogram_maps(spark, d):
    maps = relational.repository_histograms(relational.repository_clusters(S.repositories(spark, d), counts(spark, d), "train"))
    total = F.aggregate(F.map_values("data"), F.lit(0).cast("long"), lambda a, x: a + x)
    return maps.select("repository_id", "label", F.coalesce(F.size("data"), F.lit(0)).cast("long").alias("clusters"), F.coalesce(total, F.lit(0)).alias("total"))


@query(""", p AS (SELECT repository_id, cluster_id, cnt / sum(cnt) OVER (PARTITION BY repository_id) AS pct FROM counts JOIN repositories USING (repository_id) WHERE processed)
SELECT repository_id, cluster_id, round(pct / (SELECT sqrt(sum(pct * pct)) FROM p), 9) AS value FROM p""")
def repo_cluster_frobenius(spark, d):
    rows = counts(spark, d).join(S.repositories(spark, d).filter("processed").select("repository_id"), "repository_id")
    shares = encode.percentages(encode.validated(rows, 64))
    return encode.frobenius_scaled(shares).select("repository_id", "cluster_id", F.round("value", 9).alias("value"))


@query(""", p AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY cnt DESC, cluster_id) AS rank FROM counts)
SELECT repository_id, cluster_id, cnt, rank::INTEGER AS rank, round(cnt / sum(cnt) OVER (PARTITION BY repository_id), 9) AS weight FROM p WHERE rank <= 16""")
def repo_top_clusters(spark, d):
    return encode.top_clusters(counts(spark, d), 16, k=64).withColumn("weight", F.round("weight", 9))


@query("""SELECT repository_id, cluster_id, round(pct, 9) AS pct FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY repository_id) AS pct FROM counts) WHERE pct >= 0.02""")
def decode_threshold(spark, d):
    return encode.decoded(encode.percentages(counts(spark, d)), 0.02).select("repository_id", "cluster_id", F.round("pct", 9).alias("pct"))


@query("""SELECT snippet_id, file_id, code, start_line, end_line, processed, language, filename, filepath, repository_id FROM snippets JOIN files USING (file_id) WHERE NOT processed""")
def pending_snippets_with_meta(spark, d):
    return relational.pending_snippets_with_meta(S.snippets(spark, d), S.files(spark, d)).orderBy("snippet_id")


@query("""SELECT repository_id, tag, count(*) AS n, count(cluster_id) AS clustered FROM functionalities JOIN snippets USING (snippet_id) JOIN files USING (file_id) GROUP BY ALL""")
def functionalities_by_repository(spark, d):
    rows = relational.functionalities_by_repository(S.functionalities(spark, d), S.snippets(spark, d), S.files(spark, d))
    return rows.groupBy("repository_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.count("cluster_id").alias("clustered"))


@query("""SELECT f.file_id, coalesce(bool_and(processed), true) AS processed FROM files f LEFT JOIN snippets s ON f.file_id = s.file_id GROUP BY f.file_id""")
def file_processed_rollup(spark, d):
    return rollup.rolled_up(S.files(spark, d).withColumn("processed", F.lit(False)), S.snippets(spark, d), "file_id").select("file_id", "processed")


@query(""", f AS (SELECT f.file_id, any_value(repository_id) AS repository_id, coalesce(bool_and(processed), true) AS processed FROM files f LEFT JOIN snippets s ON f.file_id = s.file_id GROUP BY f.file_id)
SELECT r.repository_id, coalesce(bool_and(f.processed), true) AS processed FROM repositories r LEFT JOIN f ON r.repository_id = f.repository_id GROUP BY r.repository_id""")
def repo_processed_rollup(spark, d):
    return rollup.backfill(S.repositories(spark, d), S.files(spark, d), S.snippets(spark, d))[1].select("repository_id", "processed")


@query(""", a AS (SELECT snippet_id, CASE WHEN snippet_id % 3 = 0 THEN file_id % 100 + 1 ELSE file_id END AS file_id, CASE WHEN snippet_id % 5 = 0 THEN NOT processed ELSE processed END AS processed FROM snippets)
SELECT f.file_id, coalesce(bool_and(processed), true) AS processed FROM files f LEFT JOIN a ON f.file_id = a.file_id GROUP BY f.file_id""")
def rollup_incremental(spark, d):
    """Snippets change their flag or file; only affected files are derived anew."""
    before = S.snippets(spark, d).select("snippet_id", "file_id", "processed")
    moved = F.when(F.col("snippet_id") % 3 == 0, F.col("file_id") % 100 + 1).otherwise(F.col("file_id"))
    after = before.select("snippet_id", moved.alias("file_id"), F.when(F.col("snippet_id") % 5 == 0, ~F.col("processed")).otherwise(F.col("processed")).alias("processed"))
    files = rollup.rolled_up(S.files(spark, d).select("file_id", F.lit(False).alias("processed")), before, "file_id")
    return rollup.incremental(files, after, "file_id", rollup.affected_parents(before, after, "snippet_id", "file_id"))


@query("""SELECT file_id, repository_id FROM files f WHERE EXISTS (SELECT 1 FROM snippets s WHERE s.file_id = f.file_id AND processed IS NOT TRUE)""")
def unprocessed_parents_semi(spark, d):
    return relational.parents_with_open_children(S.files(spark, d).select("file_id", "repository_id"), S.snippets(spark, d), "file_id")


@query("""SELECT file_id, repository_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM snippets s WHERE s.file_id = f.file_id AND processed IS NOT TRUE)""")
def unprocessed_parents_anti(spark, d):
    return relational.parents_without_open_children(S.files(spark, d).select("file_id", "repository_id"), S.snippets(spark, d), "file_id")


@query("SELECT count(*) AS n FROM snippets WHERE NOT processed")
def count_unprocessed(spark, d):
    return S.snippets(spark, d).filter(~F.col("processed")).agg(F.count("snippet_id").alias("n"))


@query("SELECT count(*) AS n FROM repositories WHERE processed")
def count_processed(spark, d):
    return S.repositories(spark, d).filter("processed").agg(F.count("repository_id").alias("n"))


@query("SELECT count(DISTINCT cluster_id) AS n FROM functionalities")
def distinct_clusters(spark, d):
    return S.functionalities(spark, d).agg(F.countDistinct("cluster_id").alias("n"))


@query("SELECT repository_id, name, label, processed, split FROM repositories WHERE repository_id = 7")
def repository_by_id(spark, d):
    return relational.point_lookup(S.repositories(spark, d), "repository_id", 7)


@query("SELECT repository_id, name, label, processed, split FROM repositories WHERE name = (SELECT min(name) FROM repositories)")
def repository_by_name(spark, d):
    repositories = S.repositories(spark, d)
    return relational.point_lookup(repositories, "name", repositories.agg(F.min("name")).first()[0])


@query("SELECT repository_id, name, label FROM repositories WHERE split = 'train'")
def repositories_of_split(spark, d):
    return S.repositories(spark, d).filter(F.col("split") == "train").select("repository_id", "name", "label")


@query(""", o AS (SELECT snippet_id, (row_number() OVER (ORDER BY snippet_id) - 1) // 50 AS batch_id FROM snippets WHERE NOT processed)
SELECT batch_id, count(*) AS n, min(snippet_id) AS first_id, max(snippet_id) AS last_id FROM o GROUP BY batch_id""")
def snippet_batches(spark, d):
    rows = relational.batches(S.snippets(spark, d).filter(~F.col("processed")).select("snippet_id"), "snippet_id", 50)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("snippet_id").alias("first_id"), F.max("snippet_id").alias("last_id"))


@query("SELECT ceil(count(*) / 50)::BIGINT AS batches FROM snippets WHERE NOT processed")
def snippet_batch_count(spark, d):
    return relational.batch_count(S.snippets(spark, d).filter(~F.col("processed")), 50)


@query("SELECT repository_id, CASE WHEN label = 'benign' THEN 'benign' ELSE 'malicious' END AS label, CASE WHEN label = 'benign' THEN 0 ELSE 1 END::INTEGER AS y FROM repositories")
def binary_labels(spark, d):
    rows = relational.with_binary_label(S.repositories(spark, d)).select("repository_id", "label")
    return rows.withColumn("y", encode.label_index(F.col("label")))


# --- changes ---------------------------------------------------------------


@query("""SELECT snippet_id, file_id, CASE WHEN snippet_id % 7 = 0 THEN 'updated' ELSE code END AS code, CASE WHEN snippet_id % 7 = 0 AND snippet_id % 2 = 1 THEN true ELSE processed END AS processed FROM snippets""")
def partial_update_merge(spark, d):
    base = S.snippets(spark, d).select("snippet_id", "file_id", "code", "processed")
    changes = base.filter("snippet_id % 7 = 0").select("snippet_id", F.lit("updated").alias("code"), F.when(F.col("snippet_id") % 2 == 1, True).alias("processed"))
    return dml.merge_update(base, changes, "snippet_id")


@query(""", b AS (SELECT snippet_id, code FROM snippets)
SELECT snippet_id, CASE WHEN snippet_id % 3 = 0 AND snippet_id % 2 = 0 THEN 'third' WHEN snippet_id % 3 = 0 THEN 'first' ELSE code END AS code FROM b""")
def bulk_update_last_wins(spark, d):
    base = S.snippets(spark, d).select("snippet_id", "code")
    some = base.filter("snippet_id % 3 = 0")
    changes = some.select("snippet_id", F.lit("first").alias("code"), F.lit(1).alias("at")).unionByName(some.select("snippet_id", F.lit(None).cast("string").alias("code"), F.lit(2).alias("at"))).unionByName(some.filter("snippet_id % 2 = 0").select("snippet_id", F.lit("third").alias("code"), F.lit(3).alias("at")))
    return dml.merge_update(base, dml.collapse_updates(changes, "snippet_id", "at"), "snippet_id")


@query("SELECT snippet_id, processed FROM (SELECT snippet_id, CASE WHEN snippet_id % 4 = 0 THEN true ELSE processed END AS processed, processed AS old FROM snippets) WHERE processed IS DISTINCT FROM old")
def changed_flags(spark, d):
    before = S.snippets(spark, d).select("snippet_id", "processed")
    after = before.withColumn("processed", F.when(F.col("snippet_id") % 4 == 0, True).otherwise(F.col("processed")))
    return dml.changed_rows(before, after, "snippet_id", ["processed"])


@query("""SELECT id, repository_id FROM vectors WHERE id % 3 <> 0 UNION ALL SELECT id, repository_id + 100 FROM vectors WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, repository_id FROM vectors WHERE id % 5 = 0""")
def upsert_union(spark, d):
    base = S.vectors(spark, d).select("id", F.col("payload.repository_id").alias("repository_id"))
    new = base.filter("id % 3 = 0").withColumn("repository_id", F.col("repository_id") + 100).unionByName(base.filter("id % 5 = 0").withColumn("id", F.col("id") + 1000000))
    return dml.upsert(base, new, "id")


@query("SELECT id, repository_id, CASE WHEN id % 2 = 0 THEN 'full' ELSE split END AS split, tag FROM vectors")
def payload_merge(spark, d):
    rows = S.vectors(spark, d)
    changes = rows.filter("id % 2 = 0").select("id", F.lit("full").alias("split"))
    return dml.merge_payload(rows, changes, ["split"]).select("id", "payload.*")


@query(""", f AS (SELECT * FROM files WHERE repository_id NOT IN (3, 9)), s AS (SELECT snippets.* FROM snippets WHERE file_id IN (SELECT file_id FROM f)),
g AS (SELECT * FROM functionalities WHERE snippet_id IN (SELECT snippet_id FROM s))
SELECT 'repositories' AS name, count(*) AS n FROM repositories WHERE repository_id NOT IN (3, 9) UNION ALL SELECT 'files', count(*) FROM f UNION ALL SELECT 'snippets', count(*) FROM s UNION ALL SELECT 'functionalities', count(*) FROM g""")
def delete_cascade(spark, d):
    tables = {"repositories": S.repositories(spark, d), "files": S.files(spark, d), "snippets": S.snippets(spark, d), "functionalities": S.functionalities(spark, d)}
    keys = spark.createDataFrame([(3,), (9,)], "repository_id long")
    tree = [(p, c, link, "snippet_id" if c == "functionalities" else key) for p, c, link, key in schemas.TREE]
    left = dml.delete_cascade(tables, "repositories", keys, tree)
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT language AS name, arg_min(repository_id, file_id)::VARCHAR AS label, min(file_id) AS at FROM files WHERE language <> 'building' GROUP BY language""")
def get_or_create_repo(spark, d):
    seen = S.files(spark, d).select(F.col("language").alias("name"), F.col("repository_id").cast("string").alias("label"), F.col("file_id").alias("at"))
    return dml.get_or_create(spark.createDataFrame([("building",)], "name string"), seen, "at")


@query("""SELECT repository_id, name FROM repositories UNION ALL
SELECT (SELECT max(repository_id) FROM repositories) + row_number() OVER (ORDER BY language), language FROM (SELECT DISTINCT language FROM files)""")
def insert_with_keys(spark, d):
    base = S.repositories(spark, d).select("repository_id", "name")
    new = S.files(spark, d).select(F.col("language").alias("name")).distinct().withColumn("at", F.col("name"))
    return dml.insert(base, new, "repository_id", "at")


# --- vectors ---------------------------------------------------------------


@query("SELECT id, repository_id FROM vectors WHERE tag IN ('tag 1', 'tag 4')")
def vector_scan_by_payload(spark, d):
    return vectors.by_payload(S.vectors(spark, d), "tag", ["tag 1", "tag 4"]).select("id", "payload.repository_id")


@query("SELECT count(*) AS n FROM vectors WHERE split = 'train'")
def vector_count_by_payload(spark, d):
    return vectors.by_payload(S.vectors(spark, d), "split", ["train"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, len(vector)::INTEGER AS dims FROM vectors ORDER BY id LIMIT 100")
def vector_first_n(spark, d):
    return vectors.exactly_n(S.vectors(spark, d), 100).select("id", F.size("vector").alias("dims"))


@query("SELECT id FROM vectors WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def vectors_by_ids(spark, d):
    ids = S.table(spark, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return vectors.by_ids(S.vectors(spark, d), ids).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embedding_ids(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(S.vectors(spark, d).select("id"), "id", "left_anti")


@query(""", u AS (SELECT id, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) AS i FROM vectors), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM u GROUP BY id)
SELECT id, round(norm, 6) AS norm, round(sum(x / norm), 6) AS total, round(sum(x * x / norm / norm), 6) AS length FROM u JOIN n USING (id) GROUP BY id, norm""")
def vector_l2_normalize(spark, d):
    rows = vectors.l2_normalized(S.vectors(spark, d).withColumn("raw", F.col("vector")))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.round(vectors.norm(F.col("raw")), 6).alias("norm"), F.round(total, 6).alias("total"), F.round(F.pow(vectors.norm(F.col("vector")), 2), 6).alias("length"))


def centroids(spark, d):
    long = S.vectors(spark, d).select("payload.repository_id", F.posexplode("vector").alias("i", "x"))
    means = long.groupBy("repository_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    return [(r[0], [x[1] for x in r[1]]) for r in means.orderBy("repository_id").collect()]  # ten classes


@query(""", u AS (SELECT id, repository_id, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) AS i FROM vectors),
c AS (SELECT repository_id AS cluster, i, avg(x) AS m FROM u GROUP BY ALL),
e AS (SELECT id, cluster, sum((x - m) * (x - m)) AS dist FROM u JOIN c USING (i) GROUP BY ALL)
SELECT id, arg_min(cluster, dist) AS cluster FROM e GROUP BY id""")
def nearest_centroid(spark, d):
    return vectors.nearest_centroid(S.vectors(spark, d), centroids(spark, d))


@query(""", u AS (SELECT id, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) AS i FROM vectors), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM u GROUP BY id),
s AS (SELECT a.id AS query_id, b.id, round(sum(a.x * b.x) / (any_value(na.norm) * any_value(nb.norm)), 6) AS cosine FROM u a JOIN u b USING (i) JOIN n na ON a.id = na.id JOIN n nb ON b.id = nb.id WHERE a.id IN (0, 1, 2, 3, 4, 5, 6, 7) AND a.id <> b.id GROUP BY a.id, b.id)
SELECT query_id, id, cosine, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, d):
    """An extension: the five nearest vectors of eight stated queries."""
    rows = S.vectors(spark, d)
    return vectors.cosine_topk(rows.filter(F.col("id") < 8), rows, 5)


@query(""", u AS (SELECT id, repository_id, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) AS i FROM vectors), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM u GROUP BY id),
s AS (SELECT a.id AS query_id, b.id, round(sum(a.x * b.x) / (any_value(na.norm) * any_value(nb.norm)), 6) AS cosine FROM u a JOIN u b USING (i) JOIN n na ON a.id = na.id JOIN n nb ON b.id = nb.id WHERE a.id % 50 = 0 AND a.id <> b.id GROUP BY a.id, b.id)
SELECT query_id, id, cosine, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk_due(spark, d):
    """The search over all that is due: the five nearest vectors of every row whose id is divisible by 50."""
    rows = S.vectors(spark, d)
    return vectors.cosine_topk(rows.filter(F.col("id") % 50 == 0), rows, 5)


@query(r""", u AS (SELECT id, unnest(vector)::DOUBLE AS x FROM vectors), n AS (SELECT id, count(*) AS dims, sqrt(sum(x * x)) AS norm FROM u GROUP BY id)
SELECT doc_id AS id, coalesce(dims, 256)::INTEGER AS dims, round(CASE WHEN dims IS NOT NULL THEN norm WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE 1 END, 4) AS norm FROM documents LEFT JOIN n ON id = doc_id""")
def embed_missing(spark, d):
    rows = S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("tag"))
    cached = S.vectors(spark, d).select("id", "vector")
    return vectors.embed(rows, cached).select("id", F.size("vector").alias("dims"), F.round(vectors.norm(F.col("vector")), 4).alias("norm"))


@query()
def kmeans_assign(spark, d):
    rows = S.vectors(spark, d)
    return vectors.run_clustering(rows, "train", 10)[1].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def elbow_curve(spark, d):
    rows = S.vectors(spark, d)
    best, curve = vectors.elbow_search(rows, rows.count())
    return spark.createDataFrame([(k, float(c), best) for k, c in curve], "k int, inertia double, knee int")


# --- text ------------------------------------------------------------------


@query("SELECT doc_id, sha256(CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) AS digest, len(t) - len(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END AS n_lines FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)")
def normalize_eol(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", text.normalize_eol(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("digest"), text.line_count(F.col("t")).cast("long").alias("n_lines"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def collapse_ws(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.sha2(text.collapse_whitespace(F.col("text")), 256).alias("digest"))


@query(r"SELECT page_id, sha256(regexp_replace(array_to_string(list_filter(string_split(replace(html, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''), chr(10)), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def drop_blank_lines(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.sha2(text.drop_blank_lines(F.col("html")), 256).alias("digest"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') AS kept FROM documents")
def strip_non_ascii(spark, d):
    return S.table(spark, d, "documents").select("doc_id", text.strip_non_ascii(F.col("text")).alias("kept"))


@query("""SELECT doc_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], chr(10)) || chr(10) || '... [truncated, total lines: ' || len(l) || ']' ELSE text END AS shown
FROM (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)""")
def truncate_lines(spark, d):
    return S.table(spark, d, "documents").select("doc_id", text.truncate_lines(F.col("text"), 5).alias("shown"))


@query("SELECT doc_id, 1 + coalesce(sum(n + 2) OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_line FROM (SELECT doc_id, source, len(text) - len(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS n FROM documents)")
def append_line_offsets(spark, d):
    from pyspark.sql import Window

    rows = S.table(spark, d, "documents").select("doc_id", "source", text.line_count(text.normalize_eol(F.col("text"))).cast("long").alias("n"))
    before = Window.partitionBy("source", F.floor(F.col("doc_id") / 100)).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", (F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)) + 1).cast("long").alias("start_line"))


def answers(spark, d):
    """Documents as annotator output: `id: sentence; sentence`, and a repeated id on a line that must win."""
    body = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit(";"), F.lit(",")), F.lit(". "), F.lit("; "))
    first = F.concat(F.col("doc_id").cast("string"), F.lit(": dropped; by the next\nno id here\n"), F.col("doc_id").cast("string"), F.lit(": "), body)
    return S.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(": None"))).otherwise(first).alias("output"))


@query(""", a AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 10 = 0 THEN '' ELSE replace(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), ';', ','), '. ', '; ') END, ';'), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents),
u AS (SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM a), f AS (SELECT doc_id, item, min(i) AS i FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = u.doc_id AND len(items) = 1 AND lower(item) = 'none') GROUP BY ALL)
SELECT a.doc_id AS snippet_id, count(item) AS n_items, sha256(coalesce(string_agg(item, '|' ORDER BY i), '')) AS digest FROM a LEFT JOIN f ON a.doc_id = f.doc_id GROUP BY a.doc_id""")
def parse_llm_output(spark, d):
    rows = annotate.parsed(answers(spark, d))
    return rows.select(F.col("snippet_id").cast("long").alias("snippet_id"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_distinct("items"), "|"), 256).alias("digest"))


@query(""", a AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 10 = 0 THEN '' ELSE replace(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), ';', ','), '. ', '; ') END, ';'), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents),
u AS (SELECT doc_id, unnest(items) AS item FROM a WHERE doc_id % 4 <> 0 AND NOT (len(items) = 1 AND lower(items[1]) = 'none'))
SELECT doc_id AS snippet_id, count(DISTINCT item) AS n FROM u GROUP BY doc_id""")
def store_annotations(spark, d):
    """New functionalities of annotated documents, and how many snippets that marks."""
    snippets = S.table(spark, d, "documents").select(F.col("doc_id").alias("snippet_id"), (F.col("doc_id") % 4 == 0).alias("processed"))
    found = annotate.new_functionalities(annotate.parsed(answers(spark, d)), snippets)
    return found.groupBy(F.col("snippet_id").cast("long").alias("snippet_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract_props(spark, d):
    return S.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r""", p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[^:]*://', ''), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[2] ELSE 'root' END AS repository, CASE WHEN len(parts) >= 2 THEN parts[1] ELSE 'root' END AS label FROM p""")
def path_to_repo_label(spark, d):
    relative = F.regexp_replace("url", "^[^:]*://", "")
    repository, label = text.repository_and_label(relative, "root")
    return S.table(spark, d, "pages").select("page_id", repository.alias("repository"), label.alias("label"))


@query(r"SELECT page_id, regexp_extract(url, '[^/]*$') AS filename, 'html' AS language FROM pages WHERE regexp_matches(url, '\.[hH][tT][mM][lL]$')")
def file_languages(spark, d):
    """Files of unknown suffix are left out."""
    rows = S.table(spark, d, "pages").select("page_id", F.substring_index("url", "/", -1).alias("filename"))
    return sources.with_language(rows).filter("language = 'html'")


@query("""SELECT 'benign/' || source || '/' || lang || (doc_id // 50) || '.txt' AS path, sha256(string_agg(CASE WHEN ends_with(t, chr(10)) THEN t ELSE t || chr(10) END || chr(10) || chr(10), '' ORDER BY doc_id)) AS digest
FROM (SELECT doc_id, source, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents) GROUP BY source, lang, doc_id // 50""")
def append_functions(spark, d):
    rows = S.table(spark, d, "documents").select(F.concat(F.lit("owner/"), "source").alias("repository_name"), F.concat("lang", F.floor(F.col("doc_id") / 50).cast("string"), F.lit(".txt")).alias("func_path"), F.col("doc_id").alias("ordinal"), F.col("text").alias("code"))
    return sources.appended_functions(rows).select("path", F.sha2("source", 256).alias("digest"))


@query()
def report_sections(spark, d):
    """Documents as older reports: sections with sentences."""
    report = F.concat(F.lit("**Chunk 1** x\nFunctionalities: "), F.col("text"), F.lit(" **Chunk 2** y\nFunctionalities: Reads. Writes."))
    rows = S.table(spark, d, "documents").select("doc_id", F.explode(text.report_sections(report)).alias("s"))
    return rows.select("doc_id", "s.chunk", F.size("s.sentences").alias("sentences"))


@query(r"SELECT page_id, CASE WHEN n = '' THEN 'unknown' ELSE n END AS name FROM (SELECT page_id, regexp_extract(html, '\b([a-zA-Z_]\w*)\s*\([^;{]*\)\s*\{', 1) AS n FROM pages)")
def extract_function_name(spark, d):
    return S.table(spark, d, "pages").select("page_id", text.function_name(F.col("html")).alias("name"))


@query(r"""SELECT page_id AS snippet_id, concat_ws(chr(10), 'Snippet ID: ' || page_id, 'File: ' || url, 'Function: ' || CASE WHEN n = '' THEN 'unknown' ELSE n END, 'Language: html', 'AST Elements:', '  - Function Calls: [a, b]', '  - Control Structures: None', '', '--- Begin Code ---', regexp_replace(CASE WHEN len(l) > 400 THEN array_to_string(l[1:400], chr(10)) || chr(10) || '... [truncated, total lines: ' || len(l) || ']' ELSE t END, '^\s+|\s+$', '', 'g'), '--- End Code ---') AS block
FROM (SELECT page_id, url, regexp_replace(html, '[^\x00-\x7F]+', '', 'g') AS t, string_split(regexp_replace(regexp_replace(html, '[^\x00-\x7F]+', '', 'g'), '\n$', ''), chr(10)) AS l, regexp_extract(html, '\b([a-zA-Z_]\w*)\s*\([^;{]*\)\s*\{', 1) AS n FROM pages)""")
def prompt_blocks(spark, d):
    none = F.array().cast("array<string>")
    return S.table(spark, d, "pages").select(F.col("page_id").alias("snippet_id"), text.prompt_block(F.col("page_id"), F.col("url"), F.lit("html"), F.col("html"), F.array(F.lit("a"), F.lit("b")), none).alias("block"))


@query(""", o AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS r FROM pages), p AS (SELECT r // 20 AS prompt_no, count(*) AS n, min(page_id) AS first_id FROM o GROUP BY 1)
SELECT (prompt_no // 5)::INTEGER AS file_no, 'snippets_batch_' || (prompt_no % 5 + 1) AS custom_id, n, first_id FROM p""")
def batch_requests(spark, d):
    blocks = S.table(spark, d, "pages").select(F.col("page_id").alias("snippet_id"), F.col("url").alias("block"))
    made = prompts.prompt_batches(blocks, per_file=5)
    lines = prompts.request_lines(made, "model").select("file_no", "custom_no", F.get_json_object("value", "$.custom_id").alias("custom_id"))
    return made.join(lines, ["file_no", "custom_no"]).select("file_no", "custom_id", F.size("snippet_ids").cast("long").alias("n"), F.array_min("snippet_ids").alias("first_id"))


@query()
def scrub_blobs(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.sha2(code.mapped(code.scrub_blobs, "string")("text"), 256).alias("digest"))


@query()
def strip_string_literals(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.sha2(code.mapped(code.ascii_literals, "string")("text"), 256).alias("digest"))


@query()
def token_count(spark, d):
    return S.table(spark, d, "documents").select("doc_id", code.mapped(code.count_tokens, "long")("text").alias("tokens"))


@query()
def normalize_tag(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.sha2(code.mapped(code.normalize_tag, "string")("text"), 256).alias("digest"))


@query()
def chunk_documents(spark, d):
    files = S.table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("html").alias("language"), text.normalize_eol(F.col("html")).alias("source"))
    return chunker.chunk_files(files, partitions=spark.sparkContext.defaultParallelism)[0].select("file_id", "chunk_no", "start_line", "end_line", F.sha2("code", 256).alias("digest"))


@query()
def chunk_lateral(spark, d):
    spark.udtf.register("chunk_code", chunker.chunk_udtf())
    S.table(spark, d, "pages").createOrReplaceTempView("chunk_pages")
    return spark.sql("SELECT page_id, c.chunk_no, c.start_line, c.end_line FROM chunk_pages, LATERAL chunk_code(html, 'html') c")


@query("SELECT page_id, sha256(regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '', 'g')) AS digest FROM pages")
def strip_comments_html(spark, d):
    strip = code.mapped(lambda x: code.strip_comments(x, "html"), "string")
    return S.table(spark, d, "pages").select("page_id", F.sha2(strip("html"), 256).alias("digest"))


@query()
def ast_elements(spark, d):
    rows = S.table(spark, d, "pages").select("page_id", F.col("html").alias("code"), F.lit("javascript").alias("language"))
    return prompts.syntax_columns(rows).select("page_id", F.size("calls").alias("calls"), F.array_join("controls", ",").alias("controls"))


@query()
def annotate_pages(spark, d):
    blocks = S.table(spark, d, "pages").select(F.col("page_id").alias("snippet_id"), F.col("url").alias("filepath"), F.lit("html").alias("language"), F.col("html").alias("code"))
    made = prompts.prompt_batches(prompts.snippet_blocks(blocks)).withColumn("prompt_no", F.col("file_no") * 500 + F.col("custom_no"))
    said = annotate.annotate(made.select("prompt_no", "prompt"), annotate.rule_annotator)
    return annotate.parsed(said).select("snippet_id", F.array_join("items", "; ").alias("items"))


# --- splits, classes, metrics ----------------------------------------------


@query(""", r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) AS place, count(*) OVER (PARTITION BY quality) AS size FROM labels)
SELECT doc_id, quality, CASE WHEN place <= floor(size * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return splits.stratified_split(S.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.3, 0.7)


@query("SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) - 1) % 5)::INTEGER AS fold FROM labels")
def kfold_assign(spark, d):
    return splits.kfold(S.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "fold")


@query(""", r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) AS place FROM labels)
SELECT doc_id, quality FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balance_classes(spark, d):
    return splits.balanced(S.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(""", r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id::VARCHAR) AS place, count(*) OVER (PARTITION BY quality) AS size, count(*) OVER () AS total FROM labels),
c AS (SELECT quality, row_number() OVER (ORDER BY quality) - 1 AS i, count(*) OVER () AS classes FROM (SELECT DISTINCT quality FROM labels)),
q AS (SELECT r.*, total // classes + CASE WHEN i < total % classes THEN 1 ELSE 0 END AS quota FROM r JOIN c ON r.quality IS NOT DISTINCT FROM c.quality)
SELECT doc_id, quality, ((place * quota) // size - ((place - 1) * quota) // size)::BIGINT AS copies FROM q WHERE (place * quota) // size > ((place - 1) * quota) // size""")
def weighted_sample(spark, d):
    drawn = splits.weighted_sample(S.table(spark, d, "labels").select("doc_id", "quality"), "quality", key="doc_id")
    return drawn.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT id, v.repository_id, r.split, tag FROM vectors v JOIN repositories r ON v.repository_id = r.repository_id")
def propagate_split(spark, d):
    return splits.propagate_split(S.repositories(spark, d), S.vectors(spark, d)).select("id", "payload.*")


@query("SELECT quality, n, round((1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (), 9) AS weight FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)")
def class_weights(spark, d):
    return metrics.class_weights(S.table(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 9))


def judged(spark, d):
    return S.table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred"))


MATRIX = """, g AS (SELECT t.i AS truth, p.i AS pred FROM range(2) t(i), range(2) p(i)),
m AS (SELECT g.truth::INTEGER AS truth, g.pred::INTEGER AS pred, count(l.doc_id) AS n FROM g LEFT JOIN labels l ON l.quality = g.truth AND l.toxic = g.pred GROUP BY ALL)
"""


@query(MATRIX + "SELECT truth, pred, n FROM m")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(judged(spark, d), [0, 1])


@query(MATRIX + "SELECT truth, pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 9) AS share FROM m")
def confusion_matrix_normalized(spark, d):
    return metrics.normalized(metrics.confusion_matrix(judged(spark, d), [0, 1])).withColumn("share", F.round("share", 9))


REPORT = MATRIX + """, c AS (SELECT i::INTEGER AS class, (SELECT sum(n) FROM m WHERE truth = i AND pred = i) AS tp, (SELECT sum(n) FROM m WHERE pred = i) AS predicted, (SELECT sum(n) FROM m WHERE truth = i) AS support FROM range(2) r(i)),
q AS (SELECT class, support, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)
"""


@query(REPORT + "SELECT class, support::BIGINT AS support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def classification_report(spark, d):
    out = metrics.per_class(metrics.confusion_matrix(judged(spark, d), [0, 1]))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(REPORT + """SELECT sum(support)::BIGINT AS n, round((SELECT sum(n) FROM m WHERE truth = pred) / sum(support), 9) AS accuracy,
round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f""")
def classification_summary(spark, d):
    out = metrics.summary(metrics.confusion_matrix(judged(spark, d), [0, 1]))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "n"})


def scored(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return S.table(spark, d, "labels").select("doc_id", F.col("quality").alias("truth")).join(docs, "doc_id")


SCORES = """, s AS (SELECT quality AS truth, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
t AS (SELECT count(*) FILTER (WHERE truth = 1) AS p, count(*) FILTER (WHERE truth <> 1) AS q FROM s)
"""


@query(SCORES + """, d AS (SELECT score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth <> 1) AS neg FROM s GROUP BY score),
r AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM d WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 'infinity'::DOUBLE, 0, 0)
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / p, 9) AS tpr, round(fp / q, 9) AS fpr FROM r, t""")
def roc_points(spark, d):
    return metrics.roc_points(scored(spark, d)).withColumns({"tpr": F.round("tpr", 9), "fpr": F.round("fpr", 9)})


@query(SCORES + """, k AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s)
SELECT round(((SELECT sum(r) FROM k WHERE truth = 1) - p * (p + 1) / 2) / (p * q), 9) AS auc FROM t""")
def auc_exact(spark, d):
    return metrics.auc(scored(spark, d)).select(F.round("auc", 9).alias("auc"))


CLASS_SCORES = """, s AS (SELECT repository_id AS truth, unnest(vector[1:10])::DOUBLE AS score, generate_subscripts(vector[1:10], 1) - 1 AS class FROM vectors),
k AS (SELECT class, truth = class AS hit, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2 AS r FROM s),
t AS (SELECT class, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS q, sum(r) FILTER (WHERE hit) AS r FROM k GROUP BY class),
a AS (SELECT class, p AS support, CASE WHEN p > 0 AND q > 0 THEN (r - p * (p + 1) / 2) / (p * q) END AS auc FROM t)
"""


def class_scores(spark, d):
    """Each vector's first ten entries as scores of the ten classes."""
    rows = S.vectors(spark, d).select(F.col("payload.repository_id").alias("label"), F.posexplode(F.slice("vector", 1, 10)).alias("class", "score"))
    return rows.select((F.col("label") == F.col("class")).cast("int").alias("truth"), "class", "score")


@query(CLASS_SCORES + "SELECT class::INTEGER AS class, support, round(auc, 9) AS auc FROM a")
def auc_per_class(spark, d):
    return metrics.auc_by_class(class_scores(spark, d)).withColumn("auc", F.round("auc", 9))


@query(CLASS_SCORES + "SELECT round(avg(auc), 9) AS macro, round(sum(auc * support) / sum(support) FILTER (WHERE auc IS NOT NULL), 9) AS weighted FROM a")
def auc_averages(spark, d):
    return metrics.auc_averages(metrics.auc_by_class(class_scores(spark, d))).withColumns({c: F.round(c, 9) for c in ("macro", "weighted")})


@query(""", e AS (SELECT id, [exp(vector[1]::DOUBLE - m), exp(vector[2]::DOUBLE - m), exp(vector[3]::DOUBLE - m)] AS x FROM (SELECT id, vector, greatest(vector[1], vector[2], vector[3])::DOUBLE AS m FROM vectors))
SELECT id, round(x[1] / list_sum(x), 6) AS p0, (CASE WHEN x[1] >= x[2] AND x[1] >= x[3] THEN 0 WHEN x[2] >= x[3] THEN 1 ELSE 2 END)::INTEGER AS class FROM e""")
def softmax_argmax(spark, d):
    rows = S.vectors(spark, d).select("id", text.softmax(F.slice("vector", 1, 3).cast("array<double>")).alias("p"))
    return rows.select("id", F.round(F.get("p", F.lit(0)), 6).alias("p0"), text.argmax(F.col("p")).alias("class"))


@query(""", e AS (SELECT id, vector, list_transform(vector, lambda v: exp(v::DOUBLE - list_max(vector)::DOUBLE)) AS x FROM vectors)
SELECT id, round(x[1] / list_sum(x), 6) AS p0, (list_position(vector, list_max(vector)) - 1)::INTEGER AS class FROM e""")
def softmax_argmax_whole(spark, d):
    """Over all entries of each vector."""
    rows = S.vectors(spark, d).select("id", text.softmax(F.col("vector").cast("array<double>")).alias("p"))
    return rows.select("id", F.round(F.get("p", F.lit(0)), 6).alias("p0"), text.argmax(F.col("p")).alias("class"))


@query(""", u AS (SELECT id, repository_id, unnest(vector)::DOUBLE AS x, generate_subscripts(vector, 1) - 1 AS feature FROM vectors),
a AS (SELECT u.repository_id, u.feature, (x - avg(x) OVER (PARTITION BY u.feature)) / (u.feature + 1) AS v FROM u)
SELECT feature::INTEGER AS feature, round(avg(v), 6) AS mean, round(avg(abs(v)), 6) AS mean_abs FROM a WHERE repository_id = 3 GROUP BY feature ORDER BY abs(avg(v)) DESC, feature LIMIT 10""")
def linear_attribution_topk(spark, d):
    long = S.vectors(spark, d).select("id", F.col("payload.repository_id").alias("r"), F.posexplode("vector").alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    weights = long.select("feature").distinct().withColumn("w", 1 / (F.col("feature") + 1))
    chosen = long.filter("r = 3").select("id").distinct()
    found = classify.linear_attribution(long.select("id", "feature", "x"), weights).join(chosen, "id", "left_semi")
    return classify.top_features(found, 10).withColumns({"mean": F.round("mean", 6), "mean_abs": F.round("mean_abs", 6)})


@query()
def classifier_predict(spark, d):
    """Train on one split of customers, predict the other: the share of right predictions by class."""
    files = S.files(spark, d)
    n = S.functionalities(spark, d).filter("cluster_id is not null").join(S.snippets(spark, d).select("snippet_id", "file_id"), "snippet_id").groupBy(F.col("file_id").alias("repository_id"), "cluster_id").agg(F.count(F.lit(1)).alias("cnt"))
    rows = files.select(F.col("file_id").alias("repository_id"), F.when(F.col("language") == "building", "benign").otherwise(F.col("language")).alias("label"))
    rows = relational.with_binary_label(rows).withColumn("y", encode.label_index(F.col("label")).cast("double"))
    features = encode.sparse_features(rows, encode.percentages(n), 64, "pct")
    parts = splits.stratified_split(features, "repository_id", "label", 0.3)
    model = classify.fit(parts.filter("split = 'train'"))
    said = classify.predict(model, parts.filter("split = 'test'"))
    return said.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("right"))


# --- streaming -------------------------------------------------------------


def event_stream(spark, d):
    # A pattern, as a streaming source takes a folder or a pattern, not a file.
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")


@query("SELECT user_id, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'view'))::BIGINT AS open, bool_and(event_type IN ('purchase', 'view')) AS processed FROM events GROUP BY user_id")
def stream_rollup(spark, d):
    """An extension: the roll-up of flags over a stream, against the batch result."""
    rows = event_stream(spark, d).select("user_id", F.col("event_type").isin("purchase", "view").alias("processed"))
    return queue.drained(queue.rollup_stream(rows, "user_id"), "user_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """An extension: event-time windows with a watermark."""
    out = queue.drained(queue.windowed_counts(event_stream(spark, d)), "window", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
