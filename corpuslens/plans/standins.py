"""The engine's tables over the driver's test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("n_nationkey").cast("long").alias("repository_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("r_name") == "EUROPE", "benign").when(F.col("r_name") != "ASIA", F.lower("r_name")).alias("label"),
        (F.col("n_nationkey") % 6 != 5).alias("processed"),
        F.when(F.col("n_nationkey") % 10 < 7, "train").otherwise("test").alias("split"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("file_id"),
        F.col("c_nationkey").cast("long").alias("repository_id"),
        F.lower("c_mktsegment").alias("language"),
        F.col("c_name").alias("filename"),
        F.concat_ws("/", F.lower("c_mktsegment"), "c_name").alias("filepath"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("snippet_id"),
        F.col("o_custkey").alias("file_id"),
        F.lit(1).alias("start_line"),
        (F.floor(F.col("o_totalprice") / 1000) + 1).cast("int").alias("end_line"),
        F.col("o_orderpriority").alias("code"),
        (F.col("o_orderstatus") == "F").alias("processed"),
    )


def functionalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snippet_id"),
        F.col("l_linestatus").alias("tag"),
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey") % 64).alias("cluster_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct((F.col("label")).alias("repository_id"), F.when(F.col("vec_id") % 10 < 7, "train").otherwise("test").alias("split"), F.concat(F.lit("tag "), F.col("label").cast("string")).alias("tag"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload"))


SQL = """
WITH repositories AS (SELECT n_nationkey::BIGINT AS repository_id, n_name AS name,
    CASE WHEN r_name = 'EUROPE' THEN 'benign' WHEN r_name <> 'ASIA' THEN lower(r_name) END AS label,
    n_nationkey % 6 <> 5 AS processed, CASE WHEN n_nationkey % 10 < 7 THEN 'train' ELSE 'test' END AS split
    FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT c_custkey AS file_id, c_nationkey::BIGINT AS repository_id, lower(c_mktsegment) AS language, c_name AS filename,
    lower(c_mktsegment) || '/' || c_name AS filepath FROM customer),
snippets AS (SELECT o_orderkey AS snippet_id, o_custkey AS file_id, 1 AS start_line, (floor(o_totalprice / 1000) + 1)::INTEGER AS end_line,
    o_orderpriority AS code, o_orderstatus = 'F' AS processed FROM orders),
functionalities AS (SELECT l_orderkey AS snippet_id, l_linestatus AS tag, CASE WHEN l_returnflag <> 'N' THEN l_partkey % 64 END AS cluster_id FROM lineitem),
vectors AS (SELECT vec_id AS id, embedding AS vector, label AS repository_id, CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, 'tag ' || label AS tag FROM embeddings),
counts AS (SELECT repository_id, cluster_id, count(*) AS cnt FROM functionalities JOIN snippets USING (snippet_id) JOIN files USING (file_id)
    WHERE cluster_id IS NOT NULL GROUP BY ALL)
"""
