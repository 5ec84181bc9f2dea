"""Building a golden set: a model writes questions over seed chunks, screens them, and accepted ones fill the quotas.

Seeds are taken in one shuffled order.  A round takes as many as the type still lacks, asks the model about all of
them at once, and keeps what passes; so a quota is met by accepted items, never exceeded, and a seed is used once.
What comes to the driver is a round's items, at most a quota.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions import text as T
from lodestar.operators import generation, golden
from lodestar.operators.golden import Quotas
from lodestar.plans.index import CorpusIndex

WRITER_SYSTEM = "You write exam questions about the given passages and nothing else. Reply with JSON only."
WRITER = {
    "factoid": 'Write one self-contained question that the passage answers, and the answer. Reply with {"question": "...", "answer": "..."}.\n\n{passages}',
    "multi_hop": 'Write one question that needs facts of both passages, and the answer. Reply with {"question": "...", "answer": "..."}.\n\n{passages}',
    "aggregation": 'Write one question that counts or compares over all passages, and the answer. Reply with {"question": "...", "answer": "..."}.\n\n{passages}',
    "unanswerable": 'Write one question on the subject of the passage that it does not answer, and why. Reply with {"question": "...", "answer": "..."}.\n\n{passages}',
}
SCREENER = (
    "Should this question be kept? It is rejected under a rule that it breaks:\n{rules}\n"
    'Reply with {"keep": true, "violated_rules": []}.\n\nQUESTION: {question}\n\nANSWER: {answer}\n\n{passages}'
)
EXTRA = {"multi_hop": golden.MULTI_HOP_RULES, "unanswerable": golden.UNANSWERABLE_RULES}
#: Nearest chunks among which a partner of another document is looked for.
NEAREST = 60


@dataclass(frozen=True)
class Built:
    """``items`` in the golden schema, and ``report(outcome, n)``: generated, kept, rejected, errors, and reasons."""

    items: DataFrame
    report: DataFrame


def partners(index: CorpusIndex, seeds: DataFrame, quotas: Quotas) -> DataFrame:
    """(chunk_id, source_ids) of multi-hop seeds: the seed and the nearest chunk of another document.

    Without vectors it is a chunk of another document that shares a term; seeds that have none are left out.
    """
    if index.vectors is not None:
        vectors = index.vectors.join(index.chunks.select("chunk_id", "doc_id"), "chunk_id")
        wanted = vectors.join(seeds.select("chunk_id"), "chunk_id", "left_semi").withColumn("qid", F.col("chunk_id"))
        near = golden.dense.search(vectors.select("chunk_id", "embedding"), wanted.select("qid", "embedding"), NEAREST)
        docs = index.chunks.select("chunk_id", "doc_id")
        apart = near.join(docs, "chunk_id").join(docs.select(F.col("chunk_id").alias("qid"), F.col("doc_id").alias("own")), "qid").where("doc_id <> own")
        return apart.groupBy("qid").agg(F.min(F.struct("rank", "chunk_id"))["chunk_id"].alias("other")).select(F.col("qid").alias("chunk_id"), F.array("qid", "other").alias("source_ids"))
    return drawn(index, seeds, 2, quotas.seed, other_document=True)


def drawn(index: CorpusIndex, seeds: DataFrame, size: int, seed: str, other_document: bool = False) -> DataFrame:
    """(chunk_id, source_ids): each seed with ``size - 1`` chunks that share a term with it, if there are so many."""
    terms = index.chunks.select("chunk_id", "doc_id", F.explode(F.array_distinct("meta.mesh_terms")).alias("term"))
    own = terms.join(seeds.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("own"), F.col("doc_id").alias("own_doc"), "term")
    offers = own.join(terms, "term").where((F.col("doc_id") != F.col("own_doc")) if other_document else (F.col("chunk_id") != F.col("own")))
    order = Window.partitionBy("own").orderBy(F.md5(F.concat(F.lit(seed), "own", "chunk_id")))
    chosen = offers.select("own", "chunk_id").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") < size)
    groups = chosen.groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))), lambda x: x["chunk_id"]).alias("others")).where(F.size("others") == size - 1)
    return groups.select(F.col("own").alias("chunk_id"), F.concat(F.array("own"), "others").alias("source_ids"))


def sources(index: CorpusIndex, kind: str, seeds: DataFrame, quotas: Quotas) -> DataFrame:
    if kind == "multi_hop":
        return partners(index, seeds, quotas)
    if kind == "aggregation":
        return drawn(index, seeds, quotas.group_size, quotas.seed)
    return seeds.select("chunk_id", F.array("chunk_id").alias("source_ids"))


def attempt(index: CorpusIndex, model: generation.LanguageModel, kind: str, seeds: DataFrame, quotas: Quotas) -> list:
    """One row for each seed that has its sources: question, answer, source_ids, docs, keep, reasons, error."""
    given = sources(index, kind, seeds, quotas)
    texts = given.select("chunk_id", F.posexplode("source_ids").alias("place", "id")).join(index.chunks.select(F.col("chunk_id").alias("id"), "text", "doc_id"), "id")
    shown = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), (x["place"] + 1).cast("string"), F.lit("] "), x["text"])), "\n\n")
    rows = texts.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"), F.array_sort(F.collect_set("doc_id")).alias("docs"))
    rows = rows.select("chunk_id", shown.alias("passages"), "docs").join(given, "chunk_id").join(seeds.select("chunk_id", "place"), "chunk_id")
    wrote = generation.with_responses(rows, {"written": generation.filled(WRITER[kind], passages=F.col("passages"))}, model, WRITER_SYSTEM)
    body = F.from_json("written", "struct<question:string,answer:string>")
    wrote = wrote.withColumns({"question": F.nullif(T.strip(body["question"]), F.lit("")), "answer": body["answer"]})
    usable = F.col("question").isNotNull() & ((F.lit(kind) == "unanswerable") | (F.length(F.coalesce("answer", F.lit(""))) > 0))
    rules = "\n".join(f"{n}. {t}" for n, t in {**golden.RULES, **EXTRA.get(kind, {})}.items())
    prompt = generation.filled(SCREENER, rules=F.lit(rules), question=F.col("question"), answer=F.coalesce("answer", F.lit("")), passages=F.col("passages"))
    checked = generation.with_responses(wrote, {"response": F.when(usable, prompt)}, model, WRITER_SYSTEM).withColumns({"usable": usable, "qid": F.col("chunk_id"), "question_type": F.lit(kind)}).persist()
    ruled = golden.screen(checked.where("usable").select("qid", "question_type", "response"))
    out = checked.join(ruled, "qid", "left").orderBy("place").collect()
    checked.unpersist()
    return out


def build(index: CorpusIndex, model: generation.LanguageModel, quotas: Quotas | None = None) -> Built:
    if not model.available():
        raise generation.ModelError("building a golden set needs a language model")
    quotas, spark = quotas or Quotas(), index.chunks.sparkSession
    types = [("factoid", quotas.factoid), ("multi_hop", quotas.multi_hop), ("aggregation", quotas.aggregation), ("unanswerable", quotas.unanswerable)]
    order = golden.shuffled(index.chunks, "chunk_id", quotas.seed)
    most = quotas.attempts * sum(n for _, n in types)
    pool = [r["chunk_id"] for r in index.chunks.select("chunk_id", order.alias("h")).orderBy("h", "chunk_id").limit(most).collect()]
    report, kept, at = Counter(), [], 0
    for kind, quota in types:
        have, tried = 0, 0
        while have < quota and tried < quota * quotas.attempts and at < len(pool):
            take = pool[at : at + min(quota - have, quota * quotas.attempts - tried)]
            at, tried = at + len(take), tried + len(take)
            seeds = spark.createDataFrame([(c, i) for i, c in enumerate(take)], "chunk_id string, place int")
            for r in attempt(index, model, kind, seeds, quotas):
                if r["written_error"]:
                    report["errors"] += 1
                elif r["usable"]:
                    report["generated"] += 1
                    if r["keep"]:
                        have += 1
                        gold = [] if kind == "unanswerable" else list(r["source_ids"])
                        kept.append((f"{kind}-{have:04d}", r["question"], kind, gold, None if kind == "unanswerable" else r["answer"], (",".join(r["docs"]), index.fingerprint)))
                    else:
                        report["rejected"] += 1
                        report.update(f"reason: {x}"[:88] for x in r["reasons"] or ["unspecified"])
    report["kept"] = len(kept)
    return Built(spark.createDataFrame(kept, schemas.GOLDEN), spark.createDataFrame(sorted(report.items()), "outcome string, n int"))
