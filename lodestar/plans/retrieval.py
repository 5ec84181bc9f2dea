"""Retrieval for all queries at once: search, fuse, rerank, cut, assemble."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import text as T
from lodestar.operators import dense, fusion, generation, lexical, ranking
from lodestar.operators.telemetry import Clock
from lodestar.plans.index import CorpusIndex

#: (qid, query, chunk columns) rows in, a score column out.
Scorer = Callable[[DataFrame], F.Column]


@dataclass(frozen=True)
class Retrieved:
    """rankings by source, fused, ranked (after reranking) and contexts, all keyed by qid."""

    rankings: DataFrame
    fused: DataFrame
    ranked: DataFrame
    contexts: DataFrame
    rewrite_active: bool


def rewrite_active(cfg: Config, variants: DataFrame | None) -> bool:
    """Rewriting is on only if it is asked for and variants were really made."""
    if cfg.retrieval.rewrite.enabled and variants is None:
        import warnings

        warnings.warn("query rewriting is enabled but no variants are given; it is off", stacklevel=2)
    return cfg.retrieval.rewrite.enabled and variants is not None


def search_all(index: CorpusIndex, queries: DataFrame, cfg: Config, variants: DataFrame | None = None) -> DataFrame:
    """(qid, source, chunk_id, raw_score, rank); each variant of a query is a list of its own."""
    r = cfg.retrieval
    if not ((r.bm25.enabled and index.lexical) or (r.dense.enabled and index.vectors is not None)):
        raise RuntimeError("no retriever is enabled and available")
    asked = queries.select(F.col("qid").cast("string").alias("qid"), "query")
    if variants is not None:
        asked = fusion.distinct_variants(
            asked.select("qid", F.lit(0).alias("ordinal"), "query").unionByName(variants.select(F.col("qid").cast("string").alias("qid"), F.col("ordinal") + 1, "query").toDF("qid", "ordinal", "query")), r.rewrite.max_queries
        )
        from pyspark.sql import Window

        asked = asked.withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    else:
        asked = asked.select("qid", F.lit(0).alias("query_idx"), "query", F.lit(1).alias("n"))
    keyed = asked.withColumn("parent", F.col("qid")).withColumn("qid", F.concat_ws("\u0001", "qid", "query_idx"))
    parts = []
    if r.bm25.enabled and index.lexical:
        parts.append(lexical.search(index.lexical, keyed, r.bm25))
    if r.dense.enabled and index.vectors is not None:
        vectors = dense.embed_queries_once(keyed, prefix=r.dense.query_prefix, normalize=r.dense.normalize).select("qid", "embedding")
        parts.append(dense.search(index.vectors, vectors, r.dense.top_k, r.dense.normalize))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = F.when(F.col("n") > 1, F.concat("source", F.lit("#"), F.col("query_idx").cast("string"))).otherwise(F.col("source"))
    return found.join(keyed.select("qid", "parent", "query_idx", "n"), "qid").select(F.col("parent").alias("qid"), named.alias("source"), "chunk_id", "raw_score", "rank")


def token_scorer(rows: DataFrame) -> F.Column:
    body = F.concat_ws("\n", "title", "section", "text")
    return ranking.overlap_score(F.array_distinct(T.tokens(F.col("query"))), T.tokens(body))


def retrieve(index: CorpusIndex, queries: DataFrame, cfg: Config, variants: DataFrame | None = None, scorer: Scorer = token_scorer, model: generation.LanguageModel | None = None, clock: Clock | None = None) -> Retrieved:
    """Queries without a hit have no rows in rankings and an empty context.

    With rewriting on, a ``model`` writes the variants unless they are given.  A ``clock`` times the stages.
    """
    r = cfg.retrieval
    timed = clock.stage if clock else (lambda _, rows: rows)
    if r.rewrite.enabled and variants is None and model is not None:
        variants = generation.rewrite(queries.select(F.col("qid").cast("string").alias("qid"), "query"), model, r.rewrite.max_queries)
        variants = variants if variants is None else timed("query_rewrite", variants)
    active = rewrite_active(cfg, variants)
    rankings = timed("search", search_all(index, queries, cfg, variants if active else None))
    fused = timed("fusion", fusion.fuse(rankings, r.fusion.method, r.fusion.k))
    asked = queries.select(F.col("qid").cast("string").alias("qid"), "query")
    if r.rerank.enabled:
        pool = fused.where(F.col("rank") <= r.rerank.candidates).join(index.chunks, "chunk_id").join(asked, "qid")
        scores = pool.withColumn("own", scorer(pool)).select("qid", "chunk_id", "own")
        ranked = ranking.rerank(fused.join(scores, ["qid", "chunk_id"], "left"), F.col("own"), r.rerank.candidates).drop("own")
        ranked = timed("rerank", ranked)
    else:
        ranked = fused.withColumn("pre_rank", F.col("rank")).withColumn("rerank_score", F.lit(None).cast("double"))
    cut = ranking.context_cut(ranked, r.rerank.top_n).join(index.chunks, "chunk_id")
    tag = T.citation_tag(F.col("doc_id").cast("string"), F.col("source_type"), F.col("section"))
    shown = cut.select("qid", "rank", "chunk_id", "token_count", T.render_chunk(tag, F.col("title"), F.col("date"), F.col("text")).alias("rendered"), T.tokens(F.col("text")).alias("tokens"))
    if index.vectors is not None and r.dense.enabled:
        shown = shown.join(index.vectors, "chunk_id", "left")
        contexts = ranking.assemble(shown, r.assembly.max_context_tokens, r.assembly.dedup_threshold, r.assembly.ordering, vectors=True)
    else:
        contexts = ranking.assemble(shown, r.assembly.max_context_tokens, r.assembly.dedup_threshold, r.assembly.ordering)
    filled = asked.select("qid").join(contexts, "qid", "left").withColumn("context_ids", F.coalesce("context_ids", F.array().cast("array<string>"))).withColumn("context_text", F.coalesce("context_text", F.lit("")))
    return Retrieved(rankings, fused, ranked, timed("assemble_context", filled), active)
