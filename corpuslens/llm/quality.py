"""Quality rules with robust multivariate outliers (DataFrame operations only).

Per document: plain counts, two base rules, and a vector of transformed
statistics. Per language and source, location and scatter of the vectors come
from the minimum covariance determinant estimate. Three starts are tried (by
medians and absolute deviations; by correlations of hyperbolic tangents; by
correlations of spatial signs). From each, concentration steps keep the
`keep_share` of documents nearest to the current estimate and estimate anew;
after two steps, the start with the least determinant goes on until its
determinant no longer changes (at most `steps` steps in all). The scatter is
rescaled so that the median distance is that of the chi-squared law. A document
is rejected if its squared Mahalanobis distance exceeds `cutoff`.

The estimate is a regularised one: a floor on each variance (`floor` squared, in
log units) keeps statistics that are constant in most documents from rejecting
all others, and counts in the determinants. `cutoff` lies well above the
chi-squared law's tail (20.5 at 0.999), as the statistics of clean prose have
heavier tails; both are parameters chosen by hand, not estimated. Documents of
groups with fewer than `min_group` documents that pass the base rules are judged
by the estimate of their language (over all its sources), and where that has too
few as well, by that of all documents, however few they are.

Defined results: null text has no words (and fails the base rule of 20 words);
null language and source form groups of their own, and so does a missing
language or source column; repeated rows are judged each; ties in distance are
kept or rejected together; very long texts are judged whole; an empty table
gives an empty table; further columns are kept (a clash with one of the result's
columns is overwritten); the distance is null only where no document at all
passes the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Median of the chi-squared law with 5 degrees of freedom.
CHI2_MEDIAN_5 = 4.3515
DIMS = ("z1", "z2", "z3", "z4", "z5")
SPAN = 8
#: The key of the estimate of all documents; those of languages and groups begin otherwise.
ALL = "*"


def repeat_words(words: Column, k: int = SPAN) -> Column:
    """How many words lie in k-word windows that occur at least twice."""

    def hashes(h: Column) -> Column:
        last = F.size(h) - k
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def covered(win: Column) -> Column:
        ordered = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(o: Column) -> Column:
            same = lambda a, b: F.get(o, a)["h"] == F.get(o, b)["h"]
            return F.array_sort(F.transform(F.filter(F.transform(o, lambda x, i: F.struct(x["i"].alias("i"), (F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))).alias("r"))), lambda x: x["r"]), lambda x: x["i"]))

        step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(k), p - s["last"])).alias("n"))
        return C.let(ordered, lambda o: F.aggregate(repeats(o), F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")), step, lambda s: s["n"]))

    return C.let(C.let(F.transform(words, lambda w: F.xxhash64(w)), hashes), lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(F.lit(0))).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = C.no_nul(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.SPACE)) != "")
    out = docs.withColumn("_words", C.ascii_words(F.col(text_col)))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, C.SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
    })
    return out.drop("_words").withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    z = (F.log1p("n_words"), F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words))
    return [x.cast("double").alias(n) for x, n in zip(z, DIMS, strict=True)]


def cholesky(cov: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Names of columns to expressions of the lower factor; cov must be positive definite."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(DIMS)):
        for j in range(i + 1):
            rest = cov[j, i]
            for m in range(j):
                rest = rest - F.col(f"l{i}{m}") * F.col(f"l{j}{m}")
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
    return low


def distanced(rows: DataFrame) -> DataFrame:
    """rows (z*, and beside them an estimate m*, l**) with d2: the squared Mahalanobis distance, by forward substitution."""
    out, parts = rows, []
    for i, z in enumerate(DIMS):
        y = F.col(z) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", y / F.col(f"l{i}{i}"))
        parts.append(F.col(f"_y{i}") * F.col(f"_y{i}"))
    return out.withColumn("d2", sum(parts[1:], parts[0]))


def with_distance(rows: DataFrame, estimate: DataFrame, side, *more: str) -> DataFrame:
    """rows with d2 for each estimate (m*, l**) of their group; more: further columns of the estimate that are kept."""
    return distanced(rows.join(side(estimate), "g")).select(*rows.columns, *more, "d2")


def levels(rows: DataFrame, min_group: int) -> DataFrame:
    """g0, g1, g: for each group of rows (g0, g1, base_failed), its language and the key it is judged by: g0, g1 or ALL."""
    n = rows.groupBy("g0", "g1").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n0"))
    n = C.written(n, "group-sizes")
    languages = n.groupBy("g1").agg(F.sum("n0").alias("n1"))
    key = F.when(F.col("n0") >= min_group, F.col("g0")).when(F.col("n1") >= min_group, F.col("g1")).otherwise(F.lit(ALL))
    return C.written(n.join(languages, "g1").select("g0", "g1", key.alias("g")), "levels")


def pools(rows: DataFrame, level: DataFrame, side) -> DataFrame:
    """g, z1..: the rows that each key in use is estimated from; those of a language or of all documents hold its large groups too."""
    used = C.written(level.select("g").distinct(), "keys")
    members = level.select("g0", F.explode(F.array("g0", "g1", F.lit(ALL))).alias("g")).join(used, "g", "left_semi")
    return rows.select("g0", *DIMS).join(side(C.written(members, "pools")), "g0").select("g", *DIMS)


PAIRS = [(j, i) for i in range(len(DIMS)) for j in range(i + 1)]


def factored(moments: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """moments with the lower factor l** of a scatter and the logarithm of its determinant, without c**."""
    for (i, j), value in cholesky(cov).items():
        moments = moments.withColumn(f"l{i}{j}", value)
    logs = [F.log(F.col(f"l{i}{i}")) for i in range(len(DIMS))]
    return moments.withColumn("logdet", 2 * sum(logs[1:], logs[0])).drop(*[f"c{j}{i}" for j, i in PAIRS])


def starts(rows: DataFrame, floor: float, side) -> DataFrame:
    """g, k, m*, l**, logdet: three first estimates of each group, about its medians and scaled by its absolute deviations."""
    medians = C.written(rows.groupBy("g").agg(*[F.percentile_approx(z, 0.5).alias(f"m{i}") for i, z in enumerate(DIMS)]), "medians")
    off = rows.join(side(medians), "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(z) - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i, z in enumerate(DIMS)])
    spread = [F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + floor**2).alias(f"a{i}") for i in range(len(DIMS))]
    centre = C.written(medians.join(off, "g").select("g", *[f"m{i}" for i in range(len(DIMS))], *spread), "centres")
    u = [(F.col(z) - F.col(f"m{i}")) / F.col(f"a{i}") for i, z in enumerate(DIMS)]
    norm = F.greatest(F.sqrt(sum((x * x for x in u[1:]), u[0] * u[0])), F.lit(1e-9))
    placed = rows.join(side(centre), "g").select("g", *[F.tanh(x).alias(f"t{i}") for i, x in enumerate(u)], *[(x / norm).alias(f"s{i}") for i, x in enumerate(u)])
    products = placed.groupBy("g").agg(*[F.avg(F.col(f"{k}{j}") * F.col(f"{k}{i}")).alias(f"{k}{j}{i}") for k in "ts" for j, i in PAIRS])
    out = None
    for k, name in enumerate(("", "t", "s")):

        def share(j: int, i: int, name: str = name) -> Column:
            """A correlation, drawn towards 0 so that the scatter has an inverse."""
            both = F.sqrt(F.col(f"{name}{j}{j}") * F.col(f"{name}{i}{i}"))
            return F.when(both > 0, 0.9 * F.col(f"{name}{j}{i}") / both).otherwise(F.lit(0.0))

        cov = {(j, i): F.col(f"a{j}") * F.col(f"a{i}") * (F.lit(1.0) if j == i else share(j, i) if name else F.lit(0.0)) for j, i in PAIRS}
        one = factored(centre.join(products, "g").withColumn("k", F.lit(k)), cov)
        one = one.select("g", "k", *[f"m{i}" for i in range(len(DIMS))], *[f"l{i}{j}" for j, i in PAIRS], "logdet")
        out = one if out is None else out.unionByName(one)
    return C.written(out, "mcd-starts")


def concentrated(rows: DataFrame, estimate: DataFrame, keep_share: float, floor: float, side) -> DataFrame:
    """The estimate of the keep_share of each group's rows nearest to an estimate, by group and start."""
    near = with_distance(rows, estimate, side, "k")
    bound = C.written(near.groupBy("g", "k").agg(F.percentile_approx("d2", keep_share).alias("b")), "mcd-bound")
    half = near.join(side(bound), ["g", "k"]).filter("d2 <= b")
    moments = half.groupBy("g", "k").agg(*[F.avg(z).alias(f"m{i}") for i, z in enumerate(DIMS)], *[F.covar_pop(DIMS[j], DIMS[i]).alias(f"c{j}{i}") for j, i in PAIRS])
    return C.written(factored(moments, {(j, i): F.col(f"c{j}{i}") + (floor**2 if i == j else 0.0) for j, i in PAIRS}), "mcd-step")


def mcd(rows: DataFrame, keep_share: float, steps: int, floor: float, side) -> DataFrame:
    """A row for each group g of rows (g, z1..): location m*, lower factor l** of the scatter, scale. side: hints how a table of three rows a group is joined."""
    estimate = starts(rows, floor, side)
    for _ in range(min(2, steps)):
        estimate = concentrated(rows, estimate, keep_share, floor, side)
    best = estimate.groupBy("g").agg(F.min_by("k", F.struct("logdet", "k")).alias("k"))
    estimate = C.written(estimate.join(best, ["g", "k"]), "mcd-best")
    for _ in range(steps - 2):
        after = concentrated(rows, estimate, keep_share, floor, side)
        moved = after.join(estimate.select("g", F.col("logdet").alias("before")), "g").agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        estimate = after
        if moved is None or moved < 1e-6:
            break
    scale = with_distance(rows, estimate, side).groupBy("g").agg((F.percentile_approx("d2", 0.5) / CHI2_MEDIAN_5).alias("scale"))
    return C.written(estimate.join(scale, "g"), "mcd")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep_share: float, steps: int, floor: float, cutoff: float, min_group: int) -> DataFrame:
    """o (a struct of docs' other columns, so that no name can clash), tk, the statistics, distance, kept."""
    kept = C.others(docs, text_col, *STATISTICS, "distance", "kept")
    group = lambda c: F.coalesce(C.quoted(c).cast("string"), F.lit("\x00")) if c in docs.columns else F.lit("\x00")
    lang, source = group(lang_col), group(source_col)
    g0, g1 = F.concat_ws("\x1f", F.lit("2"), lang, source), F.concat_ws("\x1f", F.lit("1"), lang)
    text = C.quoted(text_col)
    plain = docs.select(F.struct(*map(C.quoted, kept or [text_col])).alias("o"), C.text_key(text).alias("tk"), g0.alias("g0"), g1.alias("g1"), text.alias("text"))
    rows = C.written(with_statistics(plain).select("o", "tk", *STATISTICS, "g0", "g1", *vector()), "statistics")
    level = levels(rows, min_group)
    # every table of estimates has at most three rows of 300 bytes and a key for each of these groups
    few = level.agg(3 * F.coalesce(F.sum(2 * F.octet_length("g0") + 300), F.lit(0))).first()[0] <= C.BROADCAST_BYTES
    side = F.broadcast if few else lambda x: x
    # every step scans these rows, so they are joined with their keys only once
    vectors = C.written(pools(rows.filter(~F.col("base_failed")), level, side), "vectors")
    estimate = mcd(vectors, keep_share, steps, floor, side)
    by_group = C.written(level.drop("g1").join(estimate, "g").drop("g", "k", "logdet"), "estimates")
    judged = distanced(rows.join(side(by_group), "g0", "left"))
    judged = judged.withColumn("distance", F.col("d2") / F.greatest("scale", F.lit(1.0)))
    return judged.select("o", "tk", *STATISTICS, "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_share: float = 0.75, steps: int = 8, floor: float = 0.3, cutoff: float = 60.0, min_group: int = 50) -> DataFrame:
    """docs' columns with the statistics, base_failed, distance (null if no document passes the base rules) and kept; texts are not carried."""
    out = _judged(docs, text_col, lang_col, source_col, keep_share, steps, floor, cutoff, min_group)
    return out.select(*["o.*"] * bool(C.others(docs, text_col, *STATISTICS, "distance", "kept")), *STATISTICS, "distance", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_share: float = 0.75, steps: int = 8, floor: float = 0.3, cutoff: float = 60.0, min_group: int = 50) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    cast = lambda c: F.coalesce(C.quoted(c).cast("long"), F.lit(C.MAX_LONG))
    slim = docs.select(cast(id_col).alias("id"), C.quoted(text_col).alias("text"), *[C.quoted(c).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")) if c in docs.columns])
    bad = _judged(slim, "text", "lang", "source", keep_share, steps, floor, cutoff, min_group).filter(~F.col("kept"))
    bad = C.checked_broadcast(C.written(bad.select(F.col("o.id").alias("_q_ord"), F.col("tk").alias("_q_tk")).distinct(), "rejected"), 16)
    keyed = docs.withColumns({"_q_ord": cast(id_col), "_q_tk": C.text_key(C.quoted(text_col))})
    return keyed.join(bad, ["_q_ord", "_q_tk"], "left_anti").drop("_q_ord", "_q_tk")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
