"""Classification metrics as aggregates: confusion matrix, precision, recall, F1, ROC and AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.operators.materialize import fixed


def _classes(spark: SparkSession, classes: list) -> DataFrame:
    return spark.createDataFrame([(c,) for c in classes], "class int")


def confusion_matrix(rows: DataFrame, classes: list[int], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """truth, pred, n for all pairs of classes; rows outside the classes are left out."""
    both = _classes(rows.sparkSession, classes)
    grid = F.broadcast(both.select(F.col("class").alias("truth")).crossJoin(both.select(F.col("class").alias("pred"))))
    counts = rows.groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalized(matrix: DataFrame) -> DataFrame:
    """share: n over the row's sum; 0 for empty rows."""
    total = F.sum("n").over(Window.partitionBy("truth"))
    return matrix.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def per_class(matrix: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 from a confusion matrix; undefined ones are 0."""
    long = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit("t").alias("k"), (F.col("truth") == F.col("pred")).alias("hit"), "n"), F.struct(F.col("pred").alias("class"), F.lit("p").alias("k"), (F.col("truth") == F.col("pred")).alias("hit"), "n"))).alias("x")).select("x.*")
    sums = long.groupBy("class").agg(F.sum(F.when(F.col("hit") & (F.col("k") == "t"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") == "p", F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("k") == "t", F.col("n")).otherwise(0)).alias("support"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = sums.withColumns({"precision": share(F.col("tp"), F.col("predicted")), "recall": share(F.col("tp"), F.col("support"))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1).select("class", F.col("support").cast("long").alias("support"), "precision", "recall", "f1")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: n, accuracy, and macro and weighted precision, recall and F1."""
    hits = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    report = per_class(matrix)
    cells = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    cells += [F.when(F.sum("support") > 0, F.sum(F.col(c) * F.col("support")) / F.sum("support")).otherwise(F.lit(0.0)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return hits.crossJoin(F.broadcast(report.agg(*cells))).withColumn("accuracy", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(F.lit(0.0))).drop("hit")


def _by_score(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives by distinct score: the only rows that later windows see."""
    return rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).cast("long").alias("pos"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).cast("long").alias("neg"))


def running(rows: DataFrame, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """rows with c_before: the sum of each column over the rows before, by range partitions and their totals."""
    key = F.desc(order) if descending else F.asc(order)
    # Range bounds are sampled anew on each evaluation; the checkpoint makes totals and rows agree.
    placed = fixed(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns])
    within = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(bases), "_part")
    return out.withColumns({f"{c}_before": F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).drop("_part", *[f"_b_{c}" for c in columns])


def roc_points(rows: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """threshold (descending; the first is infinite), tp, fp, tpr, fpr at each distinct score."""
    steps = running(_by_score(rows, truth, score), "score", ["pos", "neg"], descending=True)
    totals = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("q"))
    points = steps.select(F.col("score").alias("threshold"), (F.col("pos") + F.col("pos_before")).alias("tp"), (F.col("neg") + F.col("neg_before")).alias("fp"))
    start = rows.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp long, fp long")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return start.unionByName(points).crossJoin(F.broadcast(totals)).select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), share("tp", "p").alias("tpr"), share("fp", "q").alias("fpr"))


def auc(rows: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """Exact AUC by ranks, ties averaged; null if a class is missing."""
    steps = running(_by_score(rows, truth, score), "score", ["pos", "neg"])
    ranks = steps.withColumn("rank", F.col("pos_before") + F.col("neg_before") + (F.col("pos") + F.col("neg") + 1) / 2)
    sums = ranks.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def auc_by_class(rows: DataFrame, truth: str = "truth", of: str = "class", score: str = "score") -> DataFrame:
    """class, support, auc of one class against the rest; rows: a row for each item and class, truth 1 if the item is of it.

    All classes are ranked in one distributed sort by class and score; ties are averaged; auc is null if a side is missing.
    """
    fine = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    steps = fine.groupBy(F.struct(F.col(of).alias("class"), F.col(score).cast("double").alias("score")).alias("at")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).cast("long").alias("pos"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    before = running(steps, "at", ["pos", "neg"]).withColumn("class", F.col("at.class"))
    # ranks over all classes; a class's first rank is the count of the classes before it
    rank = F.col("pos_before") + F.col("neg_before") + (F.col("pos") + F.col("neg") + 1) / 2
    sums = before.groupBy("class").agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.min(F.col("pos_before") + F.col("neg_before")).alias("first"))
    p, q = F.col("p"), F.col("q")
    return sums.select("class", p.alias("support"), F.when((p > 0) & (q > 0), (F.col("r") - F.col("first") * p - p * (p + 1) / 2) / (p * q)).alias("auc"))


def auc_averages(classes: DataFrame) -> DataFrame:
    """One row: the mean AUC of the classes that have one, and the mean weighted by support."""
    known = classes.filter("auc is not null")
    return known.agg(F.avg("auc").alias("macro"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("weighted"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n, weight: in proportion to 1 / (n + 1e-6), summing to 1."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("_w", 1 / (F.col("n") + F.lit(1e-6)))
    total = counts.agg(F.sum("_w").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("weight", F.col("_w") / F.col("_t")).drop("_w", "_t")
