"""Evaluation runs, build gates, ablations, and their Markdown tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.config import Config
from lodestar.functions import text as T
from lodestar.operators import failures, generation, golden, metrics, telemetry
from lodestar.operators.chunking import chunk_documents
from lodestar.operators.telemetry import Clock
from lodestar.plans.index import CorpusIndex
from lodestar.plans.retrieval import retrieve


@dataclass(frozen=True)
class Row:
    label: str
    overrides: Mapping[str, Any] = field(default_factory=dict)


_NO_RERANK = {"retrieval.rerank.enabled": False}


def _pool(n: int) -> dict[str, int]:
    return {"retrieval.rerank.candidates": n, "retrieval.bm25.top_k": n, "retrieval.dense.top_k": n}


ROWS = [
    Row("Dense only", {"retrieval.bm25.enabled": False, **_NO_RERANK}),
    Row("BM25 only", {"retrieval.dense.enabled": False, **_NO_RERANK}),
    Row("Hybrid (RRF)", _NO_RERANK),
    Row("Hybrid (normalized-sum)", {**_NO_RERANK, "retrieval.fusion.method": "normalized_sum"}),
    Row("Hybrid + reranker"),
    Row("Hybrid + reranker + query rewrite", {"retrieval.rewrite.enabled": True}),
    Row("Hybrid + reranker, top-20 pool", _pool(20)),
    Row("Hybrid + reranker, top-100 pool", _pool(100)),
    Row("Sequential context order", {"retrieval.assembly.ordering": "sequential"}),
]
CHUNKING_ROWS = [Row(f"Chunk {n} (structure)", {"chunking.target_tokens": n}) for n in (256, 512, 1024)] + [
    Row("Chunk 512 (fixed-size)", {"chunking.strategy": "fixed", "chunking.target_tokens": 512})
]


@dataclass(frozen=True)
class Run:
    """``items``, ``totals`` and ``by_type`` of retrieval; ``records`` of every question; with a model also the judged
    ``answers`` and their ``quality``, and with a clock the ``latency`` of the stages."""

    label: str
    items: DataFrame
    totals: DataFrame
    by_type: DataFrame
    records: DataFrame
    rewrite_active: bool
    answers: DataFrame | None = None
    quality: DataFrame | None = None
    latency: DataFrame | None = None


def context_passages(index: CorpusIndex, contexts: DataFrame) -> DataFrame:
    """(qid, passages, valid_citations) in the order of the context."""
    listed = contexts.select("qid", F.posexplode("context_ids").alias("place", "chunk_id")).join(index.chunks, "chunk_id")
    tag = T.citation_tag(F.col("doc_id").cast("string"), F.col("source_type"), F.col("section"))
    rows = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "text", tag.alias("tag")))).alias("p"))
    return rows.select("qid", F.transform("p", lambda x: x["text"]).alias("passages"), F.transform("p", lambda x: x["tag"]).alias("valid_citations"))


def run(
    index: CorpusIndex, items: DataFrame, cfg: Config, label: str = "default", variants: DataFrame | None = None,
    model: generation.LanguageModel | None = None, judge: generation.LanguageModel | None = None, clock: Clock | None = None,
) -> Run:
    """``items(qid, question, question_type, gold_chunk_ids)`` through retrieval and metrics.

    A ``model`` that is available also answers each question, and a ``judge`` that is available scores the answers.
    An answer that fails is an error of its own record.
    """
    found = retrieve(index, items.select("qid", F.col("question").alias("query")), cfg, variants, model=model, clock=clock)
    scored = metrics.score_items(items, found.ranked, cfg.eval.k_values, cfg.eval.ndcg_k)
    lists = found.ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]).alias("ranked_ids"))
    empty = F.array().cast("array<string>")
    records = items.join(lists, "qid", "left").join(found.contexts.select("qid", "context_ids"), "qid", "left").withColumn("ranked_ids", F.coalesce("ranked_ids", empty)).withColumn("context_ids", F.coalesce("context_ids", empty))
    totals = metrics.macro_average(scored, items)
    answers = quality = None
    if model is not None and model.available():
        asked = items.select("qid", "question").join(found.contexts.select("qid", "context_text"), "qid").join(context_passages(index, found.contexts), "qid", "left")
        asked = asked.withColumns({c: F.coalesce(c, empty) for c in ("passages", "valid_citations")})
        answers = generation.answer(asked, model)
        answers = clock.stage("generate", answers) if clock else answers.persist()  # models are asked once
        records = records.join(answers.select("qid", "answer", "abstained", "citations", "error"), "qid", "left")
        if judge is not None and judge.available():
            rows = answers.where("answer IS NOT NULL").join(items.select("qid", "question_type", (F.col("question_type") != "unanswerable").alias("answerable")), "qid")
            answers = generation.judge(rows, judge).persist()
            quality = generation.aggregate_items(answers)
            records = records.join(answers.select("qid", "faithfulness", "answer_relevance", "context_precision", "n_claims", "n_unsupported", "degenerate", "errors"), "qid", "left")
    latency = telemetry.latency_summary(clock.spans(items.select(F.col("qid").alias("trace_id")))) if clock else None
    return Run(label, scored, totals, metrics.by_question_type(scored, cfg.eval.ndcg_k), records, found.rewrite_active, answers, quality, latency)


def gate_inputs(done: Run) -> DataFrame:
    """What ``gates`` compares: null where it was not measured."""
    out = done.totals
    none = F.lit(None).cast("double")
    out = out.join(done.quality.select("faithfulness")) if done.quality is not None else out.withColumn("faithfulness", none)
    if done.latency is None:
        return out.withColumn("p95_ms", none)
    return out.join(done.latency.where("stage = 'TOTAL_RETRIEVAL'").agg(F.max("p95_ms").alias("p95_ms")))


def gates(totals: DataFrame, cfg: Config) -> DataFrame:
    """``totals(recall_10, ndcg, faithfulness, p95_ms)`` to (gate, value, threshold, passed).

    A value that does not exist passes, but NDCG counts even if nothing was evaluated.
    """
    e = cfg.eval
    rules = [("recall@10", "recall_10", e.min_recall_at_10, 1), ("ndcg", "ndcg", e.min_ndcg_at_10, 1), ("faithfulness", "faithfulness", e.min_faithfulness, 1), ("p95_ms", "p95_ms", e.max_p95_latency_ms, -1)]
    rows = [F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.coalesce(F.col(c) * s >= t * s, F.lit(True)).alias("passed")) for g, c, t, s in rules]
    return totals.select(F.inline(F.array(*rows)))


def ablation(index: CorpusIndex, items: DataFrame, cfg: Config, rows: list[Row] | None = None, variants: DataFrame | None = None) -> DataFrame:
    """One row of totals per configuration over a shared index."""
    runs = [run(index, items, cfg.patch(r.overrides), r.label, variants) for r in rows or ROWS]
    return reduce(DataFrame.unionByName, [r.totals.select(F.lit(r.label).alias("label"), F.lit(r.rewrite_active).alias("rewrite_active"), *r.totals.columns) for r in runs])


def chunking_ablation(documents: DataFrame, base_chunks: DataFrame, items: DataFrame, cfg: Config, rows: list[Row] | None = None, counter: str = "chars4") -> DataFrame:
    """Totals per chunking: chunks, index and golden labels are made anew for each.

    Each configuration is measured when it is called: its tables are held while its one row of totals is
    computed, and released before the next.
    """
    out, fields = [], []
    for r in rows or CHUNKING_ROWS:
        own = cfg.patch(r.overrides)
        chunks = chunk_documents(documents, own.chunking, counter).persist()
        index = CorpusIndex.build(chunks, own).persist()
        moved = golden.remap(items, base_chunks, chunks).where("outcome <> 'dropped'").select("qid", "gold_chunk_ids")
        kept = items.drop("gold_chunk_ids").join(moved, "qid").persist()
        try:
            totals = run(index, kept, own, r.label).totals
            fields = totals.schema.fields
            out.append((r.label, *totals.first()))
        finally:
            kept.unpersist()
            index.unpersist()
    return documents.sparkSession.createDataFrame(out, StructType([StructField("label", StringType()), *fields]))


def failure_report(records: DataFrame, items: DataFrame, top_n: int = 20, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts by category, worst failures) of records joined with their metrics."""
    joined = records.join(items.select("qid", F.col(f"recall_{k}").alias("recall"), "first_hit_rank"), "qid", "left")
    for name, kind in (("answer", "string"), ("abstained", "boolean"), ("error", "string"), ("faithfulness", "double"), ("n_claims", "int"), ("n_unsupported", "int")):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    classified = failures.classify(joined)
    return failures.category_counts(classified), failures.worst(classified, top_n)


def markdown(rows: DataFrame, places: int = 3) -> str:
    """A small table as Markdown; numbers rounded, nulls as a dash."""
    show = lambda v: "—" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows.collect()])
