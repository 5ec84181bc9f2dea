"""Building and moving golden sets.

Random choices of a seeded generator become an order by a hash of seed and id, which any
number of executors reproduce.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import dense

# What a screener's rule numbers stand for.
RULES = {
    1: "not self-contained (refers to 'this study' / 'the passage')",
    2: "answer not stated in the source passages",
    3: "vague, or several answers equally correct",
    4: "asks about document metadata, not clinical content",
    5: "too generic to discriminate between papers",
}
MULTI_HOP_RULES = {6: "not genuinely multi-hop (one passage suffices)"}
UNANSWERABLE_RULES = {6: "actually answerable from the passages", 7: "so unrelated no retriever would surface these passages"}


@dataclass(frozen=True)
class Quotas:
    factoid: int = 80
    multi_hop: int = 40
    aggregation: int = 20
    unanswerable: int = 40
    attempts: int = 3
    group_size: int = 4
    seed: str = "20260806"


def shuffled(rows: DataFrame, id_col: str, seed: str) -> Column:
    """A position that looks random and is the same on every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")))


def seeds(chunks: DataFrame, quotas: Quotas, id_col: str = "chunk_id") -> DataFrame:
    """(question_type, place, id): chunks dealt to types in order, each used once.

    A type may try ``attempts`` times its quota; later types get what earlier ones left.  The window
    sees only the first rows in the order.
    """
    types = [("factoid", quotas.factoid), ("multi_hop", quotas.multi_hop), ("aggregation", quotas.aggregation), ("unanswerable", quotas.unanswerable)]
    total = sum(n for _, n in types) * quotas.attempts
    pool = chunks.select(id_col, shuffled(chunks, id_col, quotas.seed).alias("h")).orderBy("h", id_col).limit(total)
    place = pool.withColumn("place", F.row_number().over(Window.orderBy("h", id_col)) - 1)
    edge, cases = 0, None
    for name, n in types:
        edge += n * quotas.attempts
        cases = F.when(F.col("place") < edge, name) if cases is None else cases.when(F.col("place") < edge, name)
    return place.select(cases.alias("question_type"), "place", id_col)


def related(vectors: DataFrame, wanted: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id", k: int = 1) -> DataFrame:
    """(qid, id): the nearest neighbour of each wanted vector in another document."""
    found = dense.search(vectors, wanted, k, id_col=id_col, other_than=doc_col)
    return found.select("qid", id_col, "raw_score", "rank")


#: Chunks of a term among which partners are drawn; a term that more have is split by the chunks' hashes.
TERM_BUCKET = 1000


def sharing_terms(chunks: DataFrame, size: int, seed: str, id_col: str = "chunk_id", terms: str = "terms") -> DataFrame:
    """(id, group): each chunk with ``size - 1`` others that share a term, if there are so many.

    Within a term the chunks stand in a circle in shuffled order, and each is offered the ones that follow it; so all
    chunks of a frequent term become partners, and it takes ``size - 1`` rows a chunk like a rare one.
    """
    held = chunks.select(id_col, F.explode(F.array_distinct(terms)).alias("term"), shuffled(chunks, id_col, seed).alias("h"))
    number = F.conv(F.substring("h", 9, 6), 16, 10).cast("long")
    held = held.join(held.groupBy("term").agg(F.count("*").alias("n")), "term").withColumn("b", number % F.ceil(F.col("n") / TERM_BUCKET))
    circle = Window.partitionBy("term", "b")
    placed = held.withColumn("nth", F.row_number().over(circle.orderBy("h", id_col))).withColumn("c", F.count("*").over(circle))
    steps = placed.where("c > 1").select("term", "b", id_col, "nth", "c", F.explode(F.sequence(F.lit(1), F.least(F.lit(size - 1), F.col("c") - 1))).alias("j"))
    wanted = steps.select("term", "b", id_col, ((F.col("nth") - 1 + F.col("j")) % F.col("c") + 1).cast("int").alias("nth"))
    offered = placed.select("term", "b", "nth", F.col(id_col).alias("other"), "h")
    # partners are drawn anew for each chunk, by a hash of both
    drawn = F.md5(F.concat("h", F.col(id_col).cast("string")))
    pairs = wanted.join(offered, ["term", "b", "nth"]).where(F.col(id_col) != F.col("other")).groupBy(id_col, "other").agg(F.min(drawn).alias("h"))
    best = Window.partitionBy(id_col).orderBy("h", "other")
    chosen = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") < size)
    groups = chosen.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "other"))), lambda s: s["other"]).alias("others"))
    return groups.where(F.size("others") == size - 1).select(id_col, F.concat(F.array(id_col), "others").alias("group"))


def rule_names(entries: Column, question_type: Column) -> Column:
    """Screener entries (numbers, numbers as text, or prose) to reasons."""
    def name(entry: Column) -> Column:
        number = F.try_to_number(F.regexp_replace(T.strip(entry), r"\.+$", ""), F.lit("999")).cast("int")
        known = F.lit(None).cast("string")
        for n, text in RULES.items():
            known = F.when(number == n, text).otherwise(known)
        for kind, rules in (("multi_hop", MULTI_HOP_RULES), ("unanswerable", UNANSWERABLE_RULES)):
            for n, text in rules.items():
                known = F.when((question_type == kind) & (number == n), text).otherwise(known)
        return F.when(number.isNull(), F.substring(entry, 1, 80)).otherwise(F.coalesce(known, F.concat(F.lit("rule "), number.cast("string"))))

    return F.transform(entries, name)


def screen(responses: DataFrame) -> DataFrame:
    """``responses(qid, question_type, response)`` of a screener to (qid, keep, reasons).

    What cannot be read is rejected; a rejection without a reason gets one.
    """
    body = T.json_text(F.col("response"))
    parsed = F.from_json(body, "struct<keep:boolean,violated_rules:array<string>,reasons:array<string>>")
    entries = F.coalesce(parsed["violated_rules"], parsed["reasons"], F.array().cast("array<string>"))
    keep = F.coalesce(parsed["keep"], F.lit(False))
    named = rule_names(entries, F.col("question_type"))
    reasons = F.when(body.isNull(), F.array(F.lit("screening_error"))).when(~keep & (F.size(named) == 0), F.array(F.lit("rejected without a stated rule"))).otherwise(named)
    return responses.select("qid", keep.alias("keep"), reasons.alias("reasons"))


def rejection_counts(screened: DataFrame) -> DataFrame:
    return screened.where("NOT keep").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def missing_gold(golden: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(qid, id) of gold labels that no chunk has."""
    return golden.select("qid", F.explode("gold_chunk_ids").alias(id_col)).join(chunks.select(id_col), id_col, "left_anti").select("qid", id_col)


def single_document_multi_hop(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """Multi-hop items whose gold chunks do not span two documents."""
    gold = golden.where("question_type = 'multi_hop'").select("qid", F.explode("gold_chunk_ids").alias("chunk_id"))
    spans = gold.join(chunks.select("chunk_id", "doc_id"), "chunk_id", "left").groupBy("qid").agg(F.countDistinct("doc_id").alias("n_documents"))
    return spans.where("n_documents < 2")


def remap(golden: DataFrame, old: DataFrame, new: DataFrame, containment: float = 0.6) -> DataFrame:
    """Golden items moved to another chunking: (qid, question_type, gold_chunk_ids, outcome).

    A new chunk of the same document inherits a label if it holds that share of the old chunk's
    distinct tokens.  Items that find none are ``dropped``; unanswerable ones pass through.
    """
    tokens = lambda c: F.array_distinct(T.tokens(F.col(c)))
    labels = golden.where("question_type <> 'unanswerable' AND size(gold_chunk_ids) > 0").select("qid", F.posexplode("gold_chunk_ids").alias("place", "old_id"))
    was = old.select(F.col("chunk_id").alias("old_id"), "doc_id", tokens("text").alias("was")).join(labels.select("old_id").distinct(), "old_id", "left_semi")
    now = new.select(F.col("chunk_id").alias("new_id"), F.col("ordinal").alias("new_ordinal"), "doc_id", "text").join(was.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("now", tokens("text"))
    found = was.join(now, "doc_id").where(T.containment(F.col("was"), F.col("now")) >= containment).select("old_id", "new_id", "new_ordinal")
    lists = labels.join(found, "old_id").groupBy("qid").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "new_ordinal", "new_id"))), lambda s: s["new_id"])).alias("ids"))
    passes = (F.col("question_type") == "unanswerable") | (F.size("gold_chunk_ids") == 0)
    outcome = F.when(passes, "passed").when(F.col("ids").isNull(), "dropped").when(F.size("ids") > F.size("gold_chunk_ids"), "expanded").otherwise("remapped")
    ids = F.when(passes, F.col("gold_chunk_ids")).otherwise(F.col("ids"))
    return golden.join(lists, "qid", "left").select("qid", "question_type", ids.alias("gold_chunk_ids"), outcome.alias("outcome"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, chunk_id): ``docs(chunk_id, text)`` whose text contains the text of ``items(qid, query)``.

    A text that contains an item has all the item's inner words as words of its own, so items
    meet documents on their rarest inner word, and only those pairs are compared.  Items
    without an inner word are few and short; they are compared with every document.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    inner = items.select("qid", "query", F.array_distinct(F.slice(runs("query"), 2, F.greatest(F.lit(0), F.size(runs("query")) - 2))).alias("inner"))
    words = docs.select("chunk_id", F.explode(F.array_distinct(runs("text"))).alias("word"))
    wanted = inner.select("qid", F.explode("inner").alias("word"))
    own = words.join(wanted.select("word").distinct(), "word", "left_semi")
    counts = own.groupBy("word").agg(F.count("*").alias("df"))
    rarest = wanted.join(counts, "word", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))["word"].alias("word"))
    candidates = rarest.join(own, "word").select("qid", "chunk_id").join(inner.select("qid", "query"), "qid")
    found = candidates.join(docs.select("chunk_id", "text"), "chunk_id").where(F.contains("text", "query"))
    bare = inner.where(F.size("inner") == 0).select("qid", "query")
    return found.select("qid", "chunk_id").unionByName(docs.join(bare, F.contains("text", "query")).select("qid", "chunk_id"))
