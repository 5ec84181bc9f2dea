"""Queries and SQL of this package, merged into ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, exact_dedup, jaccard_join, language_id, license_scan, mixing, substring_dedup, suffix_tree, token_counts, token_files
from lodestar.llm.common import scratch_path, table

TOKENIZER = "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = decontaminate.items_digest(F.col("items")).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       min(doc_id) OVER (PARTITION BY text_sha256) = doc_id AS kept,
       text_sha256
FROM n
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as flat files of two-byte ids closed by <|endoftext|>, which plain text never encodes to."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "flat"), tokenizer_path(), 49407, id_bytes=2)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.roundtrip(docs, tokenizer_path(), 2, scratch_path(spark, "token-files"), digest=True)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    return suffix_tree.score_documents(docs, place=("file", "nth"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


#: Sources weigh the same, English half of all tokens, and lengths stand in for topics.
MARGINS = ["source", "lang", "topic"]
TARGETS = {"source": None, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": {"short": 0.1, "medium": 0.3, "long": 0.4, "book": 0.2}}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MARGINS, TARGETS).withColumn("prob", F.round("prob", 6))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


QUERIES = {"op2_jaccard_join": op2_jaccard_join, "op4_license_scan": op4_license_scan, "op9_mixing": op9_mixing, "op6_language_id": op6_language_id, "op10_lm_scoring": op10_lm_scoring, "op3_decontamination": op3_decontamination, "op1_substring_dedup": op1_substring_dedup, "op7_token_counts": op7_token_counts, "op8_token_output": op8_token_output, "op5_exact_dedup": op5_exact_dedup}
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50
), hashed AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS h FROM starts
), gone AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS first_id FROM hashed) WHERE first_id < doc_id
), places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS i FROM gone
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS body, count(*) AS n
  FROM places p ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT item_id, least(13, len(words)) AS size, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS pos, words FROM b WHERE len(words) > 0
), keys AS (
  SELECT DISTINCT item_id, size, array_to_string(words[pos:pos + size - 1], ' ') AS body FROM windows
), sizes AS (SELECT DISTINCT size FROM keys),
starts AS (
  SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS pos, words FROM d, sizes WHERE len(words) >= size
), found AS (
  SELECT s.doc_id, s.pos, s.size, k.item_id
  FROM (SELECT doc_id, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS body FROM starts) s JOIN keys k ON s.size = k.size AND s.body = k.body
), hits AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS i FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT x AS doc_id, count(*) AS d FROM links GROUP BY x),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id))
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id, coalesce(d, 0) AS n_links, coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN deg USING (doc_id) LEFT JOIN cls USING (doc_id)
"""

SQL = {"op2_jaccard_join": OP2_SQL, "op4_license_scan": license_scan.oracle_sql(), "op9_mixing": mixing.oracle_sql(MARGINS, TARGETS), "op3_decontamination": OP3_SQL, "op1_substring_dedup": OP1_SQL, "op5_exact_dedup": OP5_SQL}
