"""Exact deduplication by progressive refinement.

Rows are grouped by normalised length, then by (length, prefix hash), and only rows whose
group still holds several rows have their whole content hashed.  Two texts are equal when they
are identical after each run of ASCII white space becomes one space; SHA-256 over the UTF-8
bytes decides.

Scale: the first two levels move 16-byte keys with map-side combining, so one text copied into
a third of the rows costs one row per task.  Texts never cross the network: where the surviving
(length, prefix hash) pairs are too many to broadcast, digests are made before the join.  Nothing
is collected.  Rows are found again by their digest, never by their id.

Defined cases: a null text counts as empty; empty texts are equal to each other.  Of equal texts the
smallest id stays; a null id stays only where no row of the group has an id, and rows of one text
with the same id are alike, so they stay or go together.  Every row is reported as often as it occurs and
counts in its group, with its own digest, whatever its id.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_IDS, materialize

PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_limit: int = BROADCAST_IDS) -> DataFrame:
    """(digest, keep_id, group_size) of the texts that several rows have."""
    body = normalized(F.col(text_col)).alias("body")
    source = docs.select(F.col(id_col).alias("id"), body).select("id", "body", F.length("body").alias("len"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("head"))
    keys = materialize(source.select("len", "head"), "exact-keys")
    many = lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    lengths = materialize(many(keys, ["len"]), "exact-lengths")
    heads = materialize(many(keys.join(lengths, "len", "left_semi"), ["len", "head"]), "exact-heads")
    digest = F.sha2("body", 256).alias("digest")
    if heads.count() <= broadcast_limit:
        hashed = source.join(F.broadcast(heads), ["len", "head"], "left_semi").select("id", digest)
    else:
        hashed = source.select("id", "len", "head", digest).join(heads, ["len", "head"], "left_semi")
    return materialize(hashed.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_limit: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Groups come from ``copy_groups``; the digest that every row reports takes one more scan.
    """
    groups = copy_groups(docs, id_col, text_col, prefix_chars, broadcast_limit)
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(normalized(F.col(text_col)), 256).alias("digest")).join(groups, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
