"""Corpus preparation: five stages over ``documents``, each reading all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; ``run`` writes each result as Parquet and gives the next
stage what it reads back, so a lost executor costs at most a stage.  All but the last return
the columns of ``documents``.  Stages decide by texts and by the rows' own keys, so rows with null or
repeated ids are each judged for themselves.  What a stage writes on its way is deleted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from lodestar.llm.common import KEY, ids_if_small, materialize, scratch_path, scratch_scope, table, text_key
from lodestar.llm.queries import MARGINS, TARGETS, tokenizer_path

#: A prediction against the label rejects a document from this score on.
CONTRADICTION = 0.9
END_ID = 2
#: Near copies: word shingles of this width, and their Jaccard similarity from this percentage on.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and texts that clearly are in another language than labelled.

    A missing label is filled with the prediction.
    """
    net = language_id.fit(docs.where(~language_id.held_out()))
    pred, score = "__lang_pred", "__lang_score"
    found = language_id.predict(docs, net, added=(pred, score))
    wrong = F.coalesce((F.col("lang") != F.col(pred)) & (F.col(score) >= CONTRADICTION), F.lit(False))
    no_letter = F.col(pred) == language_id.UNDETERMINED
    if net is None:  # nothing to learn from: only the missing letters can be told
        no_letter = ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = found.where(~wrong & ~no_letter)
    lang = F.coalesce("lang", pred) if net is not None else F.col("lang")
    return kept.withColumn("lang", lang).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one row stays: the one with the smallest id.

    Null ids come last; rows with the same id are told apart by the hash of their text, and of rows
    with the same id and text the smallest in all columns stays.  Texts without words stay.
    """
    row = ["__id", *KEY]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    joined = jaccard_join.jaccard_join(docs.select("doc_id", "text"), width=NEAR_WORDS, percent=NEAR_PERCENT)
    found = materialize(joined.where("component IS NOT NULL").select("component", "doc_id", name, *KEY), "near-copies")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *row)
    first = found.groupBy("component").agg(F.min(order).alias("r")).select(*[f"r.{c}" for c in row])
    # rows meet by their own keys, of which a large component has as many as rows
    gone = materialize(found.select(*row).join(first, row, "left_anti").distinct(), "near-gone")
    again = materialize(found.groupBy(*row).agg(F.count("*").alias("n")).where("n > 1").select(*row), "near-again")
    keyed = docs.select("*", name, *text_key(F.col("text"))).join(ids_if_small(gone), row, "left_anti")
    listed = ids_if_small(again)
    once = keyed.join(listed, row, "left_anti").select(docs.columns)
    twice = keyed.join(listed, row, "left_semi").groupBy(*row).agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*")
    return once.unionByName(twice)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover to a twentieth or more go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = materialize(found.where("contaminated").select(*KEY).distinct(), "contaminated")
    return docs.select("*", *text_key(F.col("text"))).join(ids_if_small(bad), KEY, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that the kept tokens approach the target weights."""
    rows = docs.select("doc_id", "text", "source", "lang", F.struct(*docs.columns).alias("row"))
    return mixing.mix(rows, MARGINS, TARGETS, columns=["row"]).where("sampled").select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_files.roundtrip(docs, tokenizer_path(), END_ID, scratch_path(spark, "token-files", scoped=False), digest=True)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A trained network decides in the first stage, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-").replace("/", "-"))
        with scratch_scope(spark, "stage"):
            docs = materialize(stage(spark, docs, sf_dir), name, path=path)
    return docs
