"""Retrieval metrics over qrels and rankings.

``golden(qid, question_type, gold_chunk_ids)``, ``ranked(qid, chunk_id, rank)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 10, 20)


def qrels(golden: DataFrame) -> DataFrame:
    return golden.select("qid", F.explode(F.array_distinct("gold_chunk_ids")).alias("chunk_id"))


def answerable(golden: DataFrame) -> DataFrame:
    """Items with something to find; others are skipped by every retrieval metric."""
    return golden.where((F.col("question_type") != "unanswerable") & (F.size("gold_chunk_ids") > 0))


def score_items(golden: DataFrame, ranked: DataFrame, k_values: Sequence[int] = K_VALUES, ndcg_k: int = 10) -> DataFrame:
    """One row per answerable item: recall_k, hit_k, precision_k, mrr, ndcg, first_hit_rank.

    An item without results scores 0.  Precision divides by the results there are, at most k; the
    ideal of NDCG has at most ``ndcg_k`` hits.
    """
    items = answerable(golden).select("qid", "question_type", F.size(F.array_distinct("gold_chunk_ids")).alias("n_gold"))
    returned = ranked.groupBy("qid").agg(F.count("*").alias("n_ranked"))
    hits = ranked.join(qrels(golden), ["qid", "chunk_id"], "left_semi").groupBy("qid").agg(
        F.min("rank").alias("first_hit_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in k_values],
        F.sum(F.when(F.col("rank") <= ndcg_k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    joined = items.join(hits, "qid", "left").join(returned, "qid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(ndcg_k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return joined.select(
        "qid", "question_type", *[(zero(f"hits_{k}") / F.col("n_gold")).alias(f"recall_{k}") for k in k_values],
        *[(zero(f"hits_{k}") > 0).cast("double").alias(f"hit_{k}") for k in k_values],
        *[F.coalesce(F.try_divide(zero(f"hits_{k}"), F.least(F.lit(k), zero("n_ranked"))), F.lit(0.0)).alias(f"precision_{k}") for k in k_values],
        F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), "first_hit_rank",
    )


def macro_average(items: DataFrame, golden: DataFrame) -> DataFrame:
    """Means over evaluated items, with how many were evaluated and skipped."""
    names = [c for c in items.columns if c not in ("qid", "question_type", "first_hit_rank")]
    means = items.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names], F.count("*").alias("n_evaluated"))
    skipped = golden.agg(F.count("*").alias("n")).select("n")
    return means.join(skipped).select(*names, "n_evaluated", (F.col("n") - F.col("n_evaluated")).alias("n_skipped"))


def by_question_type(items: DataFrame, k: int = 10) -> DataFrame:
    return items.groupBy("question_type").agg(
        F.count("*").alias("n"), F.round(F.avg(f"recall_{k}"), 4).alias("recall"), F.round(F.avg(f"hit_{k}"), 4).alias("hit_rate"), F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg")
    )
