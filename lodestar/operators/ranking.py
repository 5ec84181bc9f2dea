"""Reranking and context assembly.

The pool is cut before the scorer sees it.  A query's context is a handful of rows, so the
sequential steps (dedup against what was kept, budget that skips and goes on) are folds over
one short array per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.lexical import TIE_DECIMALS

SEPARATOR = "\n\n---\n\n"


def overlap_score(query_tokens: Column, chunk_tokens: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: share of the query's terms in the chunk."""
    return F.coalesce(T.containment(query_tokens, chunk_tokens), F.lit(0.0))


def rerank(fused: DataFrame, score: Column, candidates: int = 50) -> DataFrame:
    """``fused(qid, chunk_id, score, rank, ...)`` reordered by ``score`` within the pool.

    Rows beyond the pool keep their order beneath it.  Adds pre_rank and rerank_score (null there).
    """
    pool = fused.where(F.col("rank") <= candidates).withColumn("rerank_score", score)
    tail = fused.where(F.col("rank") > candidates).withColumn("rerank_score", F.lit(None).cast("double"))
    order = Window.partitionBy("qid").orderBy((F.col("pre_rank") > candidates), F.round("rerank_score", TIE_DECIMALS).desc_nulls_last(), "pre_rank")
    both = pool.unionByName(tail).withColumnRenamed("rank", "pre_rank")
    return both.withColumn("rank", F.row_number().over(order))


def context_cut(ranked: DataFrame, top_n: int = 5) -> DataFrame:
    return ranked.where(F.col("rank") <= top_n)


def candidate_arrays(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """(qid, items): each query's rows as an array of structs in rank order."""
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("items"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def deduplicate(items: Column, threshold: float = 0.92, vectors: bool = False) -> Column:
    """Keeps an item unless it is as similar as ``threshold`` to one that was kept before it.

    Items have tokens, or embedding if ``vectors``: then similarity is the inner product as it is.
    """
    like = (lambda a, b: dot(a["embedding"], b["embedding"])) if vectors else (lambda a, b: T.jaccard(a["tokens"], b["tokens"]))
    none = F.slice(items, 1, 0)
    return F.aggregate(items, none, lambda kept, x: F.when(F.exists(kept, lambda k: like(k, x) >= threshold), kept).otherwise(F.concat(kept, F.array(x))))


def deduplicate_either(items: Column, threshold: float = 0.92) -> Column:
    """By vectors where every item of the query has one, else by tokens."""
    complete = F.forall(items, lambda x: x["embedding"].isNotNull())
    return F.when(complete, deduplicate(items, threshold, vectors=True)).otherwise(deduplicate(items, threshold))


def within_budget(items: Column, budget: int) -> Column:
    """Takes items in order while they fit; one that does not fit is passed over, later ones may."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, 1, 0).alias("kept"))
    fits = lambda a, x: a["used"] + x["token_count"] <= budget
    step = lambda a, x: F.struct(
        F.when(fits(a, x), a["used"] + x["token_count"]).otherwise(a["used"]).cast("long").alias("used"), F.when(fits(a, x), F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept")
    )
    return F.aggregate(items, start, step, lambda a: a["kept"])


def edge_order(items: Column, ordering: str = "edges") -> Column:
    """Best items at both ends: 0 2 4 ... 5 3 1.  Two or fewer stay as they are."""
    if ordering == "sequential":
        return items
    even = F.filter(items, lambda x, i: i % 2 == 0)
    odd = F.reverse(F.filter(items, lambda x, i: i % 2 == 1))
    return F.when(F.size(items) <= 2, items).otherwise(F.concat(even, odd))


def render_context(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["rendered"]), SEPARATOR)


def assemble(ranked: DataFrame, budget: int = 3000, threshold: float = 0.92, ordering: str = "edges", vectors: bool = False) -> DataFrame:
    """``ranked(qid, rank, chunk_id, token_count, rendered, tokens | embedding)`` to one context per query.

    With ``vectors`` the rows have both, and a query of which any row lacks its embedding is deduplicated by tokens.
    (qid, context_ids, context_text, n_candidates, n_duplicates, n_over_budget, n_selected, tokens_used).
    """
    columns = [c for c in ("chunk_id", "token_count", "rendered", "tokens", "embedding") if c in ranked.columns]
    rows = candidate_arrays(ranked, columns)
    own = deduplicate_either(F.col("items"), threshold) if vectors else deduplicate(F.col("items"), threshold)
    rows = rows.withColumn("unique", own).withColumn("kept", within_budget(F.col("unique"), budget))
    ordered = edge_order(F.col("kept"), ordering)
    return rows.select(
        "qid", F.transform(ordered, lambda x: x["chunk_id"]).alias("context_ids"), render_context(ordered).alias("context_text"), F.size("items").alias("n_candidates"),
        (F.size("items") - F.size("unique")).alias("n_duplicates"), (F.size("unique") - F.size("kept")).alias("n_over_budget"), F.size("kept").alias("n_selected"),
        F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["token_count"]).alias("tokens_used"),
    )
