"""Rank fusion of several retrievers' lists, for all queries at once.

``rankings(qid, source, chunk_id, raw_score, rank)`` in, (qid, chunk_id, score, rank, components) out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.lexical import TIE_DECIMALS

FLAT = 1e-12


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", TIE_DECIMALS).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


def _components(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", value.alias("value"))))).alias("components")


def reciprocal_rank(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold a chunk."""
    return _ranked(rankings.groupBy("qid", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), _components(F.col("raw_score"))))


def min_max(rankings: DataFrame) -> DataFrame:
    """Adds norm: scores scaled to [0, 1] in each list; a flat list is all 1."""
    own = Window.partitionBy("qid", "source")
    low, high = F.min("raw_score").over(own), F.max("raw_score").over(own)
    return rankings.withColumn("norm", F.when(high - low < FLAT, F.lit(1.0)).otherwise((F.col("raw_score") - low) / (high - low)))


def normalized_sum(rankings: DataFrame) -> DataFrame:
    return _ranked(min_max(rankings).groupBy("qid", "chunk_id").agg(F.sum("norm").alias("score"), _components(F.col("raw_score"))))


def fuse(rankings: DataFrame, method: str = "rrf", k: int = 60) -> DataFrame:
    """Fuses per query; a query that only one list answers keeps that list's scores and order."""
    if method not in ("rrf", "normalized_sum"):
        raise ValueError(f"unknown fusion method {method!r}")
    lists = rankings.withColumn("one", F.min("source").over(Window.partitionBy("qid")) == F.max("source").over(Window.partitionBy("qid")))
    fused = reciprocal_rank(lists.where("NOT one").drop("one"), k) if method == "rrf" else normalized_sum(lists.where("NOT one").drop("one"))
    alone = lists.where("one").select("qid", "chunk_id", F.col("raw_score").alias("score"), F.create_map("source", "raw_score").alias("components"), "rank")
    return fused.unionByName(alone)


def fan_out(queries: DataFrame) -> DataFrame:
    """``queries(qid, variants array)`` to (qid, query_idx, query): each variant is searched by itself."""
    return queries.select("qid", F.posexplode("variants").alias("query_idx", "query"))


def source_name(retriever: str, query_idx: Column, n_variants: Column) -> Column:
    """``bm25`` for a single query, ``bm25#i`` for one of several."""
    return F.when(n_variants > 1, F.concat(F.lit(f"{retriever}#"), query_idx.cast("string"))).otherwise(F.lit(retriever))


def distinct_variants(variants: DataFrame, max_queries: int = 3) -> DataFrame:
    """``variants(qid, ordinal, query)``: non-empty, once whatever the case, first ones first."""
    key = F.lower(F.trim("query"))
    first = Window.partitionBy("qid", "key").orderBy("ordinal")
    kept = variants.withColumn("key", key).where((F.col("key") != "") | (F.col("ordinal") == 0)).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("ordinal")) - 1
    return kept.withColumn("query_idx", place).where(F.col("query_idx") < max_queries).select("qid", "query_idx", F.when(F.col("query_idx") == 0, F.col("query")).otherwise(F.trim("query")).alias("query"))
