"""Evaluation of a classifier on weighted rows (EVL): expected, predicted, confidence, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("count")).otherwise(0)
    return rows.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(hit).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def by_class(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support): one shuffle of summed confusions, both sides in one aggregate."""
    pairs = rows.groupBy("expected", "predicted").agg(F.sum("count").alias("n"))
    same = F.col("expected") == F.col("predicted")
    sides = F.array(
        F.struct(F.col("expected").alias("label"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(same, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(same, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    out = pairs.select(F.inline(sides)).groupBy("label").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r).withColumn("support", F.col("tp") + F.col("fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def reliability(rows: DataFrame) -> DataFrame:
    """Accuracy by confidence, to two places."""
    return accuracy(rows.withColumn("bucket", F.bround("confidence", 2)), "bucket")


def confusions(rows: DataFrame, most: int = 12) -> DataFrame:
    wrong = rows.where("expected <> predicted").groupBy("expected", "predicted").agg(F.sum("count").alias("n"))
    return wrong.orderBy(F.desc("n"), "expected", "predicted").limit(most)
