"""Failure attribution: each item to the earliest stage that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Categories, in the order they are reported.
CATEGORIES = ("retrieval", "ranking", "abstention", "generation", "error")
EXCERPT = 300


def classify(records: DataFrame, faithfulness_floor: float = 0.8, recall_floor: float = 0.5) -> DataFrame:
    """Adds category and detail (null: clean) to records.

    Columns: gold_chunk_ids, ranked_ids, context_ids, answer, abstained, error, recall (at 10),
    first_hit_rank, faithfulness, n_claims, n_unsupported.  Whether an item can be answered is told
    by its gold ids.
    """
    c = F.col
    has_gold = F.size("gold_chunk_ids") > 0
    meets = lambda ids: F.coalesce(F.arrays_overlap("gold_chunk_ids", ids), F.lit(False))
    abstained = F.coalesce("abstained", F.lit(False))
    rules = [
        (F.coalesce("error", F.lit("")) != "", "error", c("error")),
        (~has_gold & ~abstained & c("answer").isNotNull(), "abstention", F.lit("answered a question the corpus cannot support (hallucination risk)")),
        (~has_gold, None, None),
        (~meets("ranked_ids"), "retrieval", F.lit("no gold chunk appeared anywhere in the ranked list")),
        (
            ~meets("context_ids"), "ranking",
            F.when(F.coalesce("first_hit_rank", F.lit(0)) > 0, F.concat(F.lit("gold chunk was retrieved at rank "), c("first_hit_rank").cast("string"), F.lit(" but fell below the context cutoff")))
            .otherwise(F.lit("gold chunk was retrieved but did not reach the context")),
        ),
        (abstained, "abstention", F.lit("refused despite the gold chunk being present in the context")),
        (
            F.coalesce(c("faithfulness") < faithfulness_floor, F.lit(False)), "generation",
            F.concat(c("n_unsupported").cast("string"), F.lit("/"), c("n_claims").cast("string"), F.lit(" claims unsupported despite correct context")),
        ),
        (
            F.coalesce(c("recall") < recall_floor, F.lit(False)), "retrieval",
            F.concat(F.lit("partial recall ("), F.format_string("%.2f", c("recall")), F.lit("): some gold chunks were never retrieved")),
        ),
    ]
    category, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, text in reversed(rules):
        category = F.when(test, F.lit(name).cast("string")).otherwise(category)
        detail = F.when(test, F.lit(None).cast("string") if text is None else text).otherwise(detail)
    return records.select("*", category.alias("category"), detail.alias("detail"), F.substring("answer", 1, EXCERPT).alias("answer_excerpt"))


def category_counts(classified: DataFrame) -> DataFrame:
    """(category, n) of all categories, also those without a failure, and clean."""
    present = classified.groupBy(F.coalesce("category", F.lit("clean")).alias("category")).agg(F.count("*").alias("n"))
    known = F.explode(F.array(*[F.lit(x) for x in (*CATEGORIES, "clean")]))
    names = classified.sparkSession.range(1).select(known.alias("category"))
    return names.join(present, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def worst(classified: DataFrame, top_n: int = 20) -> DataFrame:
    """Failures, errors first, then by recall and faithfulness (missing ones as 0), then by qid."""
    failed = classified.where("category IS NOT NULL")
    order = [(F.col("category") != "error").cast("int"), F.coalesce("recall", F.lit(0.0)), F.coalesce("faithfulness", F.lit(0.0)), F.col("qid")]
    return failed.orderBy(*order).limit(top_n)
