"""Validation of judge scores against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.25
METRICS = ("faithfulness", "answer_relevance", "context_precision")


def with_defaults(labels: DataFrame) -> DataFrame:
    return labels.select("qid", F.coalesce("metric", F.lit("faithfulness")).alias("metric"), F.col("score").cast("double").alias("score"), F.coalesce("note", F.lit("")).alias("note"))


def paired(scores: DataFrame, labels: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, qid, judge, human) where both exist."""
    long = scores.select("qid", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("judge")) for m in metrics]))).where("judge IS NOT NULL")
    return labels.join(long, ["qid", "metric"]).select("metric", "qid", "judge", F.col("score").alias("human"))


def pearson(x: Column, y: Column) -> Column:
    """Null with fewer than three pairs or a constant side."""
    return F.when(F.count("*") >= 3, F.try_divide(F.covar_pop(x, y), F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.stddev_pop(x) * F.stddev_pop(y)).otherwise(0.0)))


def validate(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per metric: n, agreement, means, bias (judge minus human), MAE, correlation, interval, verdict."""
    gap = F.abs(F.col("judge") - F.col("human"))
    rows = pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg((gap <= tolerance).cast("double")).alias("agreement"), F.avg("judge").alias("mean_judge"), F.avg("human").alias("mean_human"),
        ((F.sum("judge") - F.sum("human")) / F.count("*")).alias("bias"), F.avg(gap).alias("mae"), pearson(F.col("judge"), F.col("human")).alias("correlation"),
    )
    half = 1.96 * F.sqrt(F.greatest(F.col("agreement") * (1 - F.col("agreement")), F.lit(1e-9)) / F.col("n"))
    return rows.select("*", F.greatest(F.lit(0.0), F.col("agreement") - half).alias("ci_low"), F.least(F.lit(1.0), F.col("agreement") + half).alias("ci_high"), verdict().alias("verdict"))


def verdict() -> Column:
    """unvalidated below 20 labels, else usable from .8, weak from .65, unreliable; and the bias."""
    level = F.when(F.col("agreement") >= 0.8, "usable").when(F.col("agreement") >= 0.65, "weak").otherwise("unreliable")
    lean = F.when(F.col("bias") > 0.05, "generous").when(F.col("bias") < -0.05, "harsh").otherwise("unbiased")
    return F.when(F.col("n") < 20, F.lit("unvalidated")).otherwise(F.concat(level, F.lit(", "), lean))


def disagreements(pairs: DataFrame, tolerance: float = TOLERANCE, top: int = 10) -> DataFrame:
    """Per metric the widest gaps beyond the tolerance."""
    delta = F.round(F.col("judge") - F.col("human"), 3)
    order = Window.partitionBy("metric").orderBy(F.abs("delta").desc(), "qid")
    far = pairs.where(F.abs(F.col("judge") - F.col("human")) > tolerance).withColumn("delta", delta)
    return far.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)


def labeling_template(scores: DataFrame, records: DataFrame, metric: str = "faithfulness", n: int = 50) -> DataFrame:
    """The first ``n`` items by qid for a human to label; the judge's score is withheld."""
    chosen = scores.orderBy("qid").limit(n).select("qid")
    return chosen.join(records, "qid").select("qid", F.lit(metric).alias("metric"), "question", "answer", F.lit(None).cast("double").alias("score"), F.lit("").alias("note"))
