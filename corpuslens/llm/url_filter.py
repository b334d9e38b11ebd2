"""URL filtering by association rules, under hand-written host and path rules.

Labelled pages become transactions of URL tokens (host labels, host suffixes,
path segments, query keys), with one more item if the label says bad. FP-growth
mines them; rules "tokens -> bad" that pass the support (a share, and a count of
pages), confidence and lift bounds, and that no shorter one implies, form the
filter. Tokens that are too rare among bad pages for any such rule are left out
before mining. An inverted index from token to rules finds the rules whose
tokens all occur.

Hand-written rules ("host/path") come first: a rule fits its host and all
subdomains if the path starts with its path; the longest fitting rule wins.

Defined results: a null URL or one without "://" has an empty host and path,
no tokens, and is allowed; very long URLs are judged whole; repeated rows and
ids are judged each; several labels of an id make it bad if one says so; of
several mined rules that match any one blocks, so ties need no order; no labels,
or no rule that passes, means that only hand-written rules block; empty tables
give empty tables; further columns are kept (host, path, rule, verdict are
overwritten).
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BAD = "\x00bad"


def host_of(url: Column) -> Column:
    return C.lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host, and what follows each of its dots, longest first."""
    return C.let(F.split(host, "\\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h:<suffix> of the host, l:<label> of it, p:<segment>, q:<key>; purely numeric parts of a segment are one token."""
    host = F.filter(suffixes(host_of(url)), lambda x: x != "")
    labels = F.filter(F.split(host_of(url), "\\."), lambda x: x != "")
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    found = F.concat(F.transform(host, lambda x: F.concat(F.lit("h:"), x)), F.transform(labels, lambda x: F.concat(F.lit("l:"), x)), F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0"))), F.transform(keys, lambda x: F.concat(F.lit("q:"), x)))
    return F.array_distinct(found)


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.001, min_count: int = 20, min_confidence: float = 0.5, min_lift: float = 2.0, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """rule_id, antecedent (tokens), size, confidence, support: the rules that block."""
    spark = pages.sparkSession
    bad = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(F.col(label_col)).alias("_bad"))
    urls = pages.select(F.col(id_col).alias("_id"), tokens_of(F.col(url_col)).alias("items"))
    rows = urls.join(bad, "_id").select(F.when(F.col("_bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")).filter(F.size("items") > 0)
    rows = C.written(rows, "url-transactions")
    none = spark.createDataFrame([], "rule_id long, antecedent array<string>, size int, confidence double, support double")
    n = rows.count()
    if n < min_count:
        return none
    least, bad_pages = max(min_count, math.ceil(min_support * n)), max(1, rows.filter(F.array_contains("items", BAD)).count())
    # at most (tokens of a URL) / min_support rows
    useful = [r[0] for r in rows.filter(F.array_contains("items", BAD)).select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") >= least).select("t").collect()]
    if not useful:
        return none
    kept = rows.withColumn("items", F.array_intersect("items", F.array(*map(F.lit, useful)).cast("array<string>"))).filter(F.size("items") > 0)
    # pages without a useful token hold no itemset but count for the support; half a page less makes the bound safe from rounding
    n_kept = kept.count()
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_kept, minConfidence=min_confidence).fit(kept)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD).withColumn("lift", F.col("confidence") * n / bad_pages)
    rules = rules.filter(F.col("lift") >= min_lift).select(F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * n_kept / n).alias("support"))
    rules = C.written(rules.withColumn("size", F.size("antecedent")), "url-rules")
    other = rules.select(F.col("antecedent").alias("a2"), F.col("size").alias("s2"), F.explode("antecedent").alias("t"))
    implied = rules.withColumn("t", F.explode("antecedent")).join(other, "t").filter("s2 < size").filter(F.size(F.array_except("a2", "antecedent")) == 0).select("antecedent").distinct()
    return C.written(rules.join(implied, "antecedent", "left_anti").withColumn("rule_id", F.xxhash64("antecedent")).select("rule_id", "antecedent", "size", "confidence", "support"), "url-filter")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls (column url) that a mined rule matches, by an inverted index of the rules' tokens."""
    index = rules.select("rule_id", "size", F.explode("antecedent").alias("token"))
    tokens = urls.select("url").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    hits = tokens.join(C.checked_broadcast(index, F.octet_length("token") + 64), "token").groupBy("url", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return hits.filter("n = size").select("url").distinct()


def rule_choice(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of [(verdict, "host/path")] as struct(rule, verdict), else null. rules: a short hand-written list."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.partition("/")[0].lower()
        mine = ((host == at) | host.endswith("." + at)) & path.startswith(rule[rule.index("/") :])
        fits = F.when(mine, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", **options) -> DataFrame:
    """pages with host, path, rule and verdict."""
    mined = mine_rules(pages, labels, url_col=url_col, **options)
    out = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    out = out.withColumn("_rule", rule_choice(F.col("host"), F.col("path"), rules))
    hit = C.written(blocked_urls(pages.select(F.col(url_col).alias("url")), mined), "blocked-urls").withColumn("_blocked", F.lit(True))
    hit = C.checked_broadcast(hit.withColumnRenamed("url", "_url"), F.octet_length("_url") + 48)
    out = out.join(hit, out[url_col] == F.col("_url"), "left")
    out = out.withColumn("verdict", F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))))
    return out.withColumn("rule", F.col("_rule.rule")).drop("_rule", "_url", "_blocked")


#: Fixed by the query's contract.
OP4_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, C.table(spark, sf_dir, "labels"), OP4_RULES).select("page_id", "host", "path", "rule", "verdict")
