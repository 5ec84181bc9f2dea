"""Registered queries of the retrieval and evaluation operators, and their SQL oracles.

``documents`` are chunks, ``benchmark`` rows are questions, ``events`` are telemetry spans (trace = user,
stage = type), ``embeddings`` are vectors, ``labels`` and ``conversations`` stand for judged answers.
Floating-point results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Chunking, Config, Lexical
from lodestar.functions import text as T
from lodestar.operators import chunking, dense, failures, fusion, generation, golden, judging, lexical, metrics, ranking, telemetry
from lodestar.plans import chunk_sql, evaluation
from lodestar.plans.index import CorpusIndex
from lodestar.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def longs(rows: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as SQL counts them."""
    return rows.withColumns({f: F.col(f).cast("long") for f, kind in rows.dtypes if kind == "int"})


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = wraps(f)(lambda spark, d: longs(f(spark, d)))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str) -> dict[str, F.Column]:
    return {n: F.round(n, 6) for n in names}


# ---------------------------------------------------------------- shared inputs


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.col("source").alias("source_type"), "lang")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


RAW = Lexical(k1=0.9, b=0.4, top_k=20, use_stopwords=False)


def bm25(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return lexical.search_chunks(docs(spark, d), questions(spark, d), Lexical(top_k=k))


def bm25_raw(spark: SparkSession, d: str) -> DataFrame:
    """A second retriever: other parameters, and stopwords kept."""
    return lexical.search_chunks(docs(spark, d), questions(spark, d), RAW, source="raw")


def both_rankings(spark: SparkSession, d: str) -> DataFrame:
    return bm25(spark, d).unionByName(bm25_raw(spark, d))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Golden items: documents that contain the question's text; others cannot be answered."""
    asked = questions(spark, d)
    ids = golden.containing(docs(spark, d), asked).groupBy("qid").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return asked.join(ids, "qid", "left").select(
        "qid", F.col("query").alias("question"), F.when(F.col("ids").isNull(), "unanswerable").when(F.size("ids") > 1, "aggregation").otherwise("factoid").alias("question_type"),
        F.coalesce("ids", F.array().cast("array<bigint>")).alias("gold_chunk_ids"),
    )


def tok_sql(c: str, stop: bool = True) -> str:
    keep = f" AND NOT list_contains({STOP_SQL}, p)" if stop else ""
    whole = f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[-''/][a-z0-9]+)*'), lambda x: NOT list_contains({STOP_SQL}, x))" if stop else f"regexp_extract_all(lower({c}), '[a-z0-9]+(?:[-''/][a-z0-9]+)*')"
    parts = f"list_filter(string_split_regex(x, '[-''/]'), lambda p: p <> '' AND p <> x{keep})"
    return f"flatten(list_transform({whole}, lambda x: CASE WHEN regexp_matches(x, '[-''/]') THEN list_concat([x], {parts}) ELSE [x] END))"


def bm25_sql(p: str, k: int, cfg: Lexical = Lexical()) -> str:
    s = cfg.use_stopwords
    return f"""{p}_t AS MATERIALIZED (SELECT doc_id, {tok_sql('text', s)} AS toks FROM documents),
{p}_dl AS (SELECT doc_id, len(toks) AS dl FROM {p}_t), {p}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}_dl),
{p}_p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM {p}_t) GROUP BY ALL),
{p}_f AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {p}_p, {p}_c GROUP BY term, n),
{p}_q AS (SELECT item_id AS qid, unnest(list_distinct({tok_sql('text', s)})) AS term FROM benchmark),
{p}_s AS (SELECT qid, doc_id, sum(idf * tf * ({cfg.k1} + 1) / (tf + {cfg.k1} * (1 - {cfg.b} + {cfg.b} * dl / avgdl))) AS score
  FROM {p}_q JOIN {p}_p USING (term) JOIN {p}_f USING (term) JOIN {p}_dl USING (doc_id), {p}_c GROUP BY 1, 2),
{p} AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}_s WHERE score > 0) WHERE rank <= {k})"""


BOTH_SQL = bm25_sql("a", 20) + ",\n" + bm25_sql("b", 20, RAW) + """,
r AS (SELECT qid, 'bm25' AS source, doc_id, score, rank FROM a UNION ALL SELECT qid, 'raw', doc_id, score, rank FROM b),
src AS (SELECT qid, count(DISTINCT source) AS n_src FROM r GROUP BY qid)"""

FUSED_SQL = BOTH_SQL + """,
m AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS score FROM r JOIN src USING (qid) WHERE n_src > 1 GROUP BY 1, 2),
fused AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m
  UNION ALL SELECT qid, doc_id, score, rank FROM r JOIN src USING (qid) WHERE n_src = 1)"""

POOL = 10
RANKED_SQL = FUSED_SQL + f""",
qt AS (SELECT item_id AS qid, list_distinct({tok_sql('text')}) AS qtok FROM benchmark),
own AS (SELECT qid, doc_id, score, rank AS pre_rank, CASE WHEN rank <= {POOL} THEN coalesce(len(list_intersect(qtok, toks)) * 1.0 / nullif(len(qtok), 0), 0) END AS rerank_score
  FROM fused JOIN qt USING (qid) JOIN a_t USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pre_rank > {POOL}, round(rerank_score, 9) DESC NULLS LAST, pre_rank) AS rank FROM own)"""

GOLD_SQL = """g AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gi AS (SELECT qid, count(*) AS n_gold FROM g GROUP BY qid)"""

METRIC_K = (1, 5, 10)
METRICS_SQL = bm25_sql("a", 20) + f""",
{GOLD_SQL},
nr AS (SELECT qid, count(*) AS n_ranked FROM a GROUP BY qid),
h AS (SELECT qid, min(rank) AS first_hit_rank, {', '.join(f'count(*) FILTER (rank <= {k}) AS h{k}' for k in METRIC_K)}, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM a JOIN g USING (qid, doc_id) GROUP BY qid),
it AS (SELECT qid, CASE WHEN n_gold > 1 THEN 'aggregation' ELSE 'factoid' END AS question_type,
  {', '.join(f'coalesce(h{k}, 0) * 1.0 / n_gold AS recall_{k}' for k in METRIC_K)},
  {', '.join(f'CAST(coalesce(h{k}, 0) > 0 AS DOUBLE) AS hit_{k}' for k in METRIC_K)},
  {', '.join(f'coalesce(h{k} * 1.0 / nullif(least({k}, n_ranked), 0), 0) AS precision_{k}' for k in METRIC_K)},
  coalesce(1.0 / first_hit_rank, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, first_hit_rank
  FROM gi LEFT JOIN h USING (qid) LEFT JOIN nr USING (qid))"""

# ---------------------------------------------------------------- text


@register(f"SELECT doc_id, len({tok_sql('text')}) AS n_tokens, len(list_distinct({tok_sql('text')})) AS n_terms, md5(array_to_string({tok_sql('text')}, ' ')) AS digest FROM documents")
def tokenize_terms(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


_ABBR_SQL = "(^|\\s)(" + "|".join(a.replace(".", "\\.") for a in T.ABBREVIATIONS) + "|[A-Z]\\.|\\(?\\d+[.)])$"


@register(f"""WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, E' \\n\\t\\r'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS p FROM documents),
m AS (SELECT doc_id, array_to_string(list_transform(p, lambda x: x || CASE WHEN regexp_matches(x, '{_ABBR_SQL}') THEN ' ' ELSE chr(1) END), '') AS s FROM f),
o AS (SELECT doc_id, list_filter(list_transform(string_split(s, chr(1)), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS s FROM m)
SELECT doc_id, unnest(range(0, len(s))) AS ordinal, unnest(s) AS sentence FROM o""")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ordinal", "sentence"))


_SPACE = "E' \\n\\t\\r\\f\\x0B'"


HTML_SQL = f"""a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis') AS h FROM pages),
b AS (SELECT page_id, string_split(regexp_replace(h, '<h[1-4][^>]*>(.*?)</h[1-4]>', E'\\n\\n## ' || chr(1) || '\\1' || chr(1) || E'\\n\\n', 'gis'), chr(1)) AS p FROM a),
c AS (SELECT page_id, array_to_string(list_transform(p, lambda x, i: regexp_replace(x, '<[^>]+>', CASE WHEN i % 2 = 0 THEN '' ELSE ' ' END, 'g')), '') AS t FROM b),
u AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;?', '&', 'g') AS t FROM c),
s AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), {_SPACE} || chr(160)) AS t FROM u)"""


@register(f"WITH {HTML_SQL} SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM s")
def html_text(spark, d):
    t = T.html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@register(f"""WITH {HTML_SQL},
sm AS (SELECT page_id, string_split(regexp_replace(t, '(?m)^#{{1,4}}\\s+(.+?)\\s*$', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM s),
sl AS (SELECT page_id, len(p) AS n, list_concat([{{'heading': NULL, 'text': p[1]}}], list_transform(range(1, len(p) // 2 + 1), lambda i: {{'heading': trim(p[2 * i], {_SPACE}), 'text': p[2 * i + 1]}})) AS x FROM sm),
sc AS (SELECT page_id, n, list_transform(x, lambda v: {{'heading': v.heading, 'text': trim(regexp_replace(regexp_replace(v.text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), {_SPACE} || chr(160))}}) AS x FROM sl),
sf AS (SELECT page_id, CASE WHEN n = 1 THEN x ELSE list_filter(x, lambda v: v.text <> '') END AS x FROM sc)
SELECT page_id, unnest(range(0, len(x))) AS ordinal, unnest(list_transform(x, lambda v: v.heading)) AS heading, unnest(list_transform(x, lambda v: v.text)) AS text FROM sf""")
def html_sections(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(T.html_sections(F.col("html"))).alias("ordinal", "s")).select("page_id", "ordinal", "s.heading", "s.text")


@register(f"""WITH x AS (SELECT doc_id, '# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || chr(10) || '### tail' || chr(10) || source AS t FROM documents),
m AS (SELECT doc_id, string_split(regexp_replace(t, '(?m)^#{{1,4}}\\s+(.+?)\\s*$', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM x),
c AS (SELECT doc_id, list_transform(p, lambda v: trim(regexp_replace(regexp_replace(v, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), {_SPACE})) AS p FROM m),
e AS (SELECT doc_id, list_filter(list_concat([{{'heading': NULL, 'body': p[1]}}], list_transform(range(1, len(p) // 2 + 1), lambda i: {{'heading': p[2 * i], 'body': p[2 * i + 1]}})), lambda s: s.body <> '') AS s FROM c)
SELECT doc_id, len(s) AS n_sections, md5(array_to_string(list_transform(s, lambda v: coalesce(v.heading, '-') || '=' || v.body), '|')) AS digest FROM e""")
def markdown_sections(spark, d):
    raw = F.concat_ws("\n", F.concat(F.lit("# "), "source"), "text", F.concat(F.lit("## "), "lang"), F.lit(""), F.lit("### tail"), "source")
    s = table(spark, d, "documents").select("doc_id", T.markdown_sections(raw).alias("s"))
    joined = F.array_join(F.transform("s", lambda v: F.concat(F.coalesce(v["heading"], F.lit("-")), F.lit("="), v["text"])), "|")
    return s.select("doc_id", F.size("s").alias("n_sections"), F.md5(joined).alias("digest"))


@register(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), {_SPACE}) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeeze(F.col("text")).alias("cleaned"))


@register(f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS flat FROM pages")
def flatten_markup(spark, d):
    return table(spark, d, "pages").select("page_id", T.flatten_markup(F.col("html")).alias("flat"))


@register("""WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y') ELSE '' END AS y,
  CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y %b-%d') WHEN 1 THEN strftime(ts, '%Y') || '-' || event_type WHEN 2 THEN strftime(ts, '%Y%b') ELSE event_type END AS m FROM events)
SELECT event_id, coalesce(nullif(trim(y), ''), nullif(regexp_extract(m, '^\\s*(\\d+)(-|\\s|$)', 1), '')) AS year FROM x""")
def leading_year(spark, d):
    i, fmt = F.col("event_id"), lambda f: F.date_format("ts", f)
    m = F.when(i % 4 == 0, fmt("yyyy MMM-dd")).when(i % 4 == 1, F.concat(fmt("yyyy"), F.lit("-"), "event_type")).when(i % 4 == 2, fmt("yyyyMMM")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.leading_year(F.when(i % 3 == 0, fmt("yyyy")).otherwise(""), m).alias("year"))


@register("SELECT doc_id, greatest(1, length(text) // 4) AS tokens, length(text) > 400 AND length(substr(text, 1, 400)) > 0 AS cut FROM documents")
def count_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_chars4(F.col("text")).alias("tokens"), (F.length("text") > 400).alias("cut"))


@register(f"""WITH c AS (SELECT doc_id, text, substr(text, 1, 400) AS cut FROM documents),
b AS (SELECT *, regexp_extract(cut, '(?s)^(.*)(?:\\. |\\n)', 1) AS back FROM c)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN length(back) > 0.6 * length(cut) THEN trim(back || CASE WHEN substr(cut, length(back) + 1, 1) = '.' THEN '.' ELSE '' END, {_SPACE}) ELSE trim(cut, {_SPACE}) END AS text FROM b""")
def truncate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_tokens(F.col("text"), 100).alias("text"))


_WITH_RUN = "text || CASE WHEN doc_id % 5 = 0 THEN ' insufficient - context' WHEN doc_id % 5 = 1 THEN 'Insufficient_CONTEXT.' ELSE '' END"


@register(f"SELECT doc_id, regexp_matches({_WITH_RUN}, '(?i)INSUFFICIENT[\\s_-]*CONTEXT') AS abstained FROM documents")
def abstention(spark, d):
    i = F.col("doc_id") % 5
    derived = F.concat("text", F.when(i == 0, " insufficient - context").when(i == 1, "Insufficient_CONTEXT.").otherwise(""))
    return table(spark, d, "documents").select("doc_id", T.is_abstention(derived).alias("abstained"))


@register("SELECT doc_id, regexp_matches(text || repeat('@', CAST(doc_id % 20 AS INT)), '@{12,}') OR len(list_filter(range(1, length(text) - 10), lambda i: substr(text, i, 12) = repeat(substr(text, i, 1), 12) AND substr(text, i, 1) <> chr(10))) > 0 AS degenerate FROM documents")
def degenerate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_degenerate(F.expr("concat(text, repeat('@', cast(doc_id % 20 as int)))")).alias("degenerate"))


@register("""WITH a AS (SELECT doc_id, ['doc ' || doc_id, lang, source] AS valid, text || ' a [doc ' || doc_id || '] b [made up] [ ' || source || ' ] [doc ' || doc_id || '] [' || lang || ']' AS answer FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(answer, '\\[([^\\]]+?)\\]', 1), lambda x: trim(x, E' \\n\\t\\r')), lambda x: list_contains(valid, x)) AS k FROM a)
SELECT doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ';') AS tags FROM t""")
def citations(spark, d):
    tag = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    answer = F.concat("text", F.lit(" a ["), tag, F.lit("] b [made up] [ "), "source", F.lit(" ] ["), tag, F.lit("] ["), "lang", F.lit("]"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.citations(answer, F.array(tag, "lang", "source")), ";").alias("tags"))


@register("SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE event_type END AS kind FROM events")
def json_extract(spark, d):
    body = F.to_json(F.struct("event_type", "value"))
    i = F.col("event_id") % 5
    response = (
        F.when(i == 0, body).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone {x}"))).when(i == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
        .when(i == 3, F.concat(F.lit("```\n"), body, F.lit("```"))).otherwise(F.lit("no {json here"))
    )
    return table(spark, d, "events").select("event_id", F.get_json_object(T.json_text(response), "$.event_type").alias("kind"))


@register("SELECT doc_id, CASE WHEN lang = 'en' THEN '[PMID:' || doc_id || ' §' || lang || '] ' ELSE '[' || doc_id || ' §' || lang || '] ' END || source || ' (2020)' || chr(10) || text AS shown FROM documents")
def render_chunk(spark, d):
    tag = T.citation_tag(F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", "pubmed").otherwise("local"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.render_chunk(tag, F.col("source"), F.lit("2020"), F.col("text")).alias("shown"))


@register("SELECT doc_id, source || chr(10) || text || chr(10) || chr(10) || lang AS body FROM documents")
def document_text(spark, d):
    kind = "array<struct<heading:string,text:string>>"
    sections = F.array(F.struct(F.col("source").alias("heading"), F.col("text").alias("text")), F.struct(F.lit(None).cast("string").alias("heading"), F.col("lang").alias("text"))).cast(kind)
    return table(spark, d, "documents").select("doc_id", T.document_text(sections).alias("body"))


@register("SELECT doc_id, substr(sha1(doc_id || '::0::' || text), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


def found_documents(spark, d) -> DataFrame:
    """Search results: a turn's text is a document's id, a conversation a query, its turns the places."""
    return table(spark, d, "conversations").select(F.col("text").alias("doc_id"), F.col("conv_id").alias("query_ordinal"), F.col("turn").alias("place"))


@register("""SELECT doc_id, query_ordinal, place FROM (SELECT text AS doc_id, conv_id AS query_ordinal, turn AS place, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS nth FROM conversations) WHERE nth = 1""")
def doc_dedupe(spark, d):
    return files.distinct_documents(found_documents(spark, d), "query_ordinal", "place")


@register("""SELECT doc_id, query_ordinal, place FROM (SELECT text AS doc_id, conv_id AS query_ordinal, turn AS place, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS nth FROM conversations) x
WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.role = 'assistant' AND c.text = x.doc_id)""")
def corpus_ids_to_fetch(spark, d):
    """What assistants said stands for documents that are held already."""
    held = table(spark, d, "conversations").where("role = 'assistant'").select(F.col("text").alias("doc_id"))
    return files.ids_to_fetch(found_documents(spark, d), held)


# ---------------------------------------------------------------- chunking


def sectioned(spark, d) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(None).cast("string").alias("heading"), x.alias("text")))
    return table(spark, d, "documents").select("doc_id", lines.alias("sections"))


_SECTION_CHUNKING = Chunking(target_tokens=60, overlap_tokens=10, min_tokens=8)
_CHUNK_COLUMNS = "SELECT substr(sha1(doc_id || '::' || ordinal || '::' || text), 1, 16) AS chunk_id, doc_id, ordinal, text, token_count FROM chunks"
_STRUCTURE_SQL = chunk_sql.structure(60, 10, 8)


@register(f"WITH RECURSIVE {_STRUCTURE_SQL} {_CHUNK_COLUMNS}")
def chunk_structure(spark, d):
    return chunking.chunk_documents(sectioned(spark, d), _SECTION_CHUNKING, "words").drop("section")


@register(f"WITH RECURSIVE {chunk_sql.fixed(60, 10, 8)} {_CHUNK_COLUMNS}")
def chunk_fixed(spark, d):
    cfg = Chunking(strategy="fixed", target_tokens=60, overlap_tokens=10, min_tokens=8)
    return chunking.chunk_documents(sectioned(spark, d), cfg, "words").drop("section")


@register(f"""WITH RECURSIVE {_STRUCTURE_SQL} SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) AS n_chunks, round(avg(token_count), 6) AS mean_tokens,
min(token_count) AS min_tokens, max(token_count) AS max_tokens, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)) AS n_dropped FROM chunks""")
def chunk_statistics(spark, d):
    source = sectioned(spark, d)
    return chunking.chunk_statistics(source, chunking.chunk_documents(source, _SECTION_CHUNKING, "words")).withColumns(r6("mean_tokens"))


@register(f"WITH RECURSIVE {chunk_sql.fixed(40, 25, 0)} SELECT doc_id, ordinal, token_count, md5(text) AS digest FROM chunks")
def greedy_pack(spark, d):
    """Windows of 40 words that carry up to half of the target on; sentences above it are cut by words."""
    cfg = Chunking(strategy="fixed", target_tokens=40, overlap_tokens=25, min_tokens=0)
    packed = chunking.chunk_documents(sectioned(spark, d), cfg, "words")
    return packed.select("doc_id", "ordinal", "token_count", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- lexical, dense


@register(f"""WITH {bm25_sql('a', 10)}, n AS (SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_documents, round(avg(greatest(1, length(text) // 4)), 6) AS mean_tokens, min(greatest(1, length(text) // 4)) AS min_tokens, max(greatest(1, length(text) // 4)) AS max_tokens FROM documents)
SELECT n.*, (SELECT count(*) FROM a_f) AS n_terms, (SELECT max(len(embedding)) FROM embeddings) AS dimension FROM n""")
def corpus_stats(spark, d):
    """Sources stand for documents of several chunks."""
    chunks = docs(spark, d).withColumns({"doc_id": F.col("source_type"), "token_count": T.count_chars4(F.col("text"))})
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return CorpusIndex.build(chunks, Config(), vectors).statistics().withColumns(r6("mean_tokens"))


@register("SELECT source AS source_type, count(*) AS n FROM documents GROUP BY source")
def chunks_by_source(spark, d):
    return docs(spark, d).groupBy("source_type").agg(F.count("*").alias("n"))


@register(f"WITH {bm25_sql('a', 10)} SELECT term, df, round(idf, 6) AS idf FROM a_f")
def term_idf(spark, d):
    return lexical.build_index(docs(spark, d)).terms.withColumns(r6("idf"))


def _flat(r: DataFrame) -> DataFrame:
    return r.select("qid", F.col("chunk_id").alias("doc_id"), F.round("raw_score", 6).alias("score"), "rank")


@register(f"WITH {bm25_sql('a', 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM a")
def bm25_topk(spark, d):
    return _flat(bm25(spark, d, 10))


@register(f"WITH {bm25_sql('b', 20, RAW)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM b")
def bm25_no_stopwords(spark, d):
    return _flat(bm25_raw(spark, d))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(v.embedding[i] AS DOUBLE)))"
_NORM = lambda x: f"sqrt(list_sum(list_transform({x}.embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))"


def dense_sql(score: str, k: int, where: str = "true") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id, {score} AS score FROM embeddings q JOIN embeddings v ON {where} WHERE q.vec_id % 100 = 0)
SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


def query_vectors(spark, d) -> DataFrame:
    """Queries of a search are the vectors whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").withColumn("qid", F.col("vec_id"))


def _dense(found: DataFrame) -> DataFrame:
    return found.select("qid", "vec_id", F.round("raw_score", 6).alias("score"), "rank")


@register(dense_sql(_DOT, 10))
def dense_topk(spark, d):
    return _dense(dense.search(table(spark, d, "embeddings"), query_vectors(spark, d), 10, id_col="vec_id"))


@register(dense_sql(f"({_DOT}) * 2 * (q.label + 1) / (2 * ({_NORM('q')}) * (q.label + 1) * ({_NORM('v')}))", 10))
def cosine_unnormalized(spark, d):
    longer = F.transform("embedding", lambda x: x * (F.col("label") + 1) * 2)
    vectors = table(spark, d, "embeddings").withColumn("embedding", longer)
    return _dense(dense.search(vectors, query_vectors(spark, d).withColumn("embedding", longer), 10, normalized=False, id_col="vec_id"))


@register(dense_sql(_DOT, 1, "q.label <> v.label"))
def related_chunk(spark, d):
    found = golden.related(table(spark, d, "embeddings"), query_vectors(spark, d), "vec_id", "label")
    return found.select("qid", "vec_id", F.round("raw_score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- fusion, reranking, assembly


def _fused(f: DataFrame) -> DataFrame:
    return f.select("qid", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@register(f"""WITH {BOTH_SQL}, m AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m""")
def rrf_fusion(spark, d):
    return _fused(fusion.reciprocal_rank(both_rankings(spark, d)))


@register(f"""WITH {BOTH_SQL}, lo AS (SELECT *, min(score) OVER w AS a0, max(score) OVER w AS a1 FROM r WINDOW w AS (PARTITION BY qid, source)),
m AS (SELECT qid, doc_id, sum(CASE WHEN a1 - a0 < 1e-12 THEN 1.0 ELSE (score - a0) / (a1 - a0) END) AS score FROM lo GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m""")
def normsum_fusion(spark, d):
    return _fused(fusion.normalized_sum(both_rankings(spark, d)))


@register(f"WITH {FUSED_SQL} SELECT qid, doc_id, round(score, 6) AS score, rank FROM fused")
def single_source_passthrough(spark, d):
    return _fused(fusion.fuse(both_rankings(spark, d)))


def dense_documents(spark, d) -> DataFrame:
    """Vectors whose number is a document's or a question's stand for them."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    asked = questions(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid").select("qid", "embedding")
    return dense.search(vectors, asked, 20)


DENSE_SQL = f"""dv AS (SELECT b.item_id AS qid, v.vec_id AS doc_id, {_DOT} AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
dn AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dv) WHERE rank <= 20)"""


@register(f"""WITH {bm25_sql('a', 20)}, {DENSE_SQL},
r AS (SELECT qid, 'bm25' AS source, doc_id, score, rank FROM a UNION ALL SELECT qid, 'dense', doc_id, score, rank FROM dn), src AS (SELECT qid, count(DISTINCT source) AS n_src FROM r GROUP BY qid),
m AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS score FROM r JOIN src USING (qid) WHERE n_src > 1 GROUP BY 1, 2),
fused AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m UNION ALL SELECT qid, doc_id, score, rank FROM r JOIN src USING (qid) WHERE n_src = 1)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM fused""")
def hybrid_fusion(spark, d):
    """Lexical and dense rankings fused; a question without a vector keeps its lexical one."""
    return _fused(fusion.fuse(bm25(spark, d).unionByName(dense_documents(spark, d))))


@register("""WITH v AS (SELECT conv_id AS qid, turn AS ordinal, text AS query FROM conversations WHERE role = 'user'),
k AS (SELECT *, lower(trim(query)) AS key FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY ordinal) AS nth FROM k WHERE key <> '' OR ordinal = 0),
p AS (SELECT qid, query, row_number() OVER (PARTITION BY qid ORDER BY ordinal) - 1 AS query_idx FROM f WHERE nth = 1)
SELECT qid, query_idx, CASE WHEN query_idx = 0 THEN query ELSE trim(query) END AS query FROM p WHERE query_idx < 3""")
def query_variant_dedupe(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("ordinal"), F.col("text").alias("query"))
    return fusion.distinct_variants(turns, 3)


@register("""SELECT conv_id AS qid, i AS query_idx, CASE WHEN n > 1 THEN 'bm25#' || i ELSE 'bm25' END AS source FROM (
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user')""")
def query_fan_out(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("variants"))
    each = fusion.fan_out(turns).join(turns.select("qid", F.size("variants").alias("n")), "qid")
    return each.select("qid", "query_idx", fusion.source_name("bm25", F.col("query_idx"), F.col("n")).alias("source"))


def reranked(spark, d) -> DataFrame:
    fused = fusion.fuse(both_rankings(spark, d)).persist()  # a few rows a question, used twice
    asked = questions(spark, d).select("qid", F.array_distinct(T.tokens(F.col("query"))).alias("qtok"))
    pool = fused.where(F.col("rank") <= POOL)
    pool = F.broadcast(pool) if pool.count() <= lexical.BROADCAST_TERMS else pool  # so that texts need not be shuffled
    # texts join first, so only those of a pool are tokenised
    pool = docs(spark, d).select("chunk_id", "text").join(pool, "chunk_id").join(asked, "qid")
    pool = pool.select("qid", "chunk_id", ranking.overlap_score(F.col("qtok"), T.tokens(F.col("text"))).alias("own"))
    return ranking.rerank(fused.join(pool, ["qid", "chunk_id"], "left"), F.col("own"), POOL).drop("own")


@register(f"WITH {RANKED_SQL} SELECT qid, doc_id, pre_rank, round(rerank_score, 6) AS rerank_score, rank FROM ranked")
def rerank_pool_tail(spark, d):
    return reranked(spark, d).select("qid", F.col("chunk_id").alias("doc_id"), "pre_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@register(f"WITH {RANKED_SQL} SELECT qid, doc_id, rank FROM ranked WHERE rank <= 5")
def context_cut(spark, d):
    return ranking.context_cut(reranked(spark, d), 5).select("qid", F.col("chunk_id").alias("doc_id"), "rank")


CONTEXT, BUDGET, SAME = 8, 900, 0.92


def candidates(spark, d) -> DataFrame:
    found = bm25(spark, d, CONTEXT).join(docs(spark, d).select("chunk_id", "text"), "chunk_id")
    own = {"token_count": T.count_chars4(F.col("text")), "tokens": F.array_distinct(T.tokens(F.col("text"))), "rendered": F.col("chunk_id").cast("string")}
    return found.withColumns(own).drop("text")


_ITEMS_SQL = bm25_sql("a", CONTEXT) + f""",
i AS (SELECT qid, list({{'rank': rank, 'id': doc_id, 'tc': greatest(1, length(text) // 4), 'toks': list_distinct(toks)}} ORDER BY rank) AS items FROM a JOIN documents USING (doc_id) JOIN a_t USING (doc_id) GROUP BY qid)"""
_KEPT_SQL = _ITEMS_SQL + f""",
k AS (SELECT qid, items, list_reduce(list_transform(items, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: len(y.toks) > 0 AND len(x[1].toks) > 0
  AND len(list_intersect(y.toks, x[1].toks)) * 1.0 / len(list_distinct(list_concat(y.toks, x[1].toks))) >= {SAME})) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM i)"""


@register(f"WITH {_KEPT_SQL} SELECT qid, unnest(list_transform(kept, lambda x: x.id)) AS doc_id FROM k")
def greedy_dedup(spark, d):
    items = ranking.candidate_arrays(candidates(spark, d), ["chunk_id", "tokens"])
    return items.select("qid", F.explode(F.transform(ranking.deduplicate(F.col("items"), SAME), lambda x: x["chunk_id"])).alias("doc_id"))


ALIKE = 0.25
_EITHER_SQL = f"""{bm25_sql("a", CONTEXT)},
i AS (SELECT qid, list({{'rank': rank, 'id': doc_id, 'toks': list_distinct(toks), 'e': embedding}} ORDER BY rank) AS items FROM a JOIN a_t USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id GROUP BY qid),
y AS (SELECT qid, items, len(list_filter(items, lambda x: x.e IS NULL)) = 0 AS whole FROM i),
k AS (SELECT qid, list_reduce(list_transform(items, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: CASE WHEN whole THEN list_sum(list_transform(range(1, 65), lambda j: CAST(y.e[j] AS DOUBLE) * CAST(x[1].e[j] AS DOUBLE))) >= {ALIKE}
  ELSE len(y.toks) > 0 AND len(x[1].toks) > 0 AND len(list_intersect(y.toks, x[1].toks)) * 1.0 / len(list_distinct(list_concat(y.toks, x[1].toks))) >= {ALIKE} END)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM y)"""


@register(f"WITH {_EITHER_SQL} SELECT qid, unnest(list_transform(kept, lambda x: x.id)) AS doc_id FROM k")
def vector_dedup(spark, d):
    """By vectors where all candidates of a question have one, else by tokens."""
    rows = candidates(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    items = ranking.candidate_arrays(rows, ["chunk_id", "tokens", "embedding"])
    return items.select("qid", F.explode(F.transform(ranking.deduplicate_either(F.col("items"), ALIKE), lambda x: x["chunk_id"])).alias("doc_id"))


@register(f"""WITH {_ITEMS_SQL}, b AS (SELECT qid, list_reduce(list_transform(items, lambda x: {{'u': 0::BIGINT, 'ids': [x.id], 'tc': x.tc}}), lambda a, x: CASE WHEN a.u + x.tc <= {BUDGET} THEN {{'u': a.u + x.tc, 'ids': list_concat(a.ids, x.ids), 'tc': 0::BIGINT}} ELSE a END, {{'u': 0::BIGINT, 'ids': []::BIGINT[], 'tc': 0::BIGINT}}) AS r FROM i)
SELECT qid, r.u AS used, len(r.ids) AS n_kept, array_to_string(r.ids, ',') AS ids FROM b""")
def token_budget(spark, d):
    items = ranking.candidate_arrays(candidates(spark, d), ["chunk_id", "token_count"])
    kept = items.select("qid", ranking.within_budget(F.col("items"), BUDGET).alias("k"))
    used = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x["token_count"])
    return kept.select("qid", used.alias("used"), F.size("k").alias("n_kept"), F.array_join(F.transform("k", lambda x: x["chunk_id"].cast("string")), ",").alias("ids"))


@register(f"WITH {bm25_sql('a', CONTEXT)}, n AS (SELECT qid, count(*) AS n FROM a GROUP BY qid) SELECT qid, string_agg(doc_id, ',' ORDER BY CASE WHEN n <= 2 THEN rank WHEN (rank - 1) % 2 = 0 THEN rank ELSE 1000 - rank END) AS ids FROM a JOIN n USING (qid) GROUP BY qid")
def edge_order(spark, d):
    items = ranking.candidate_arrays(bm25(spark, d, CONTEXT), ["chunk_id"])
    return items.select("qid", F.array_join(F.transform(ranking.edge_order(F.col("items")), lambda x: x["chunk_id"].cast("string")), ",").alias("ids"))


@register(f"""WITH {_KEPT_SQL}, b AS (SELECT qid, len(items) AS n_candidates, len(kept) AS n_kept, list_reduce(list_transform(kept, lambda x: {{'u': 0::BIGINT, 'ids': [x.id], 'tc': x.tc}}), lambda a, x: CASE WHEN a.u + x.tc <= {BUDGET} THEN {{'u': a.u + x.tc, 'ids': list_concat(a.ids, x.ids), 'tc': 0::BIGINT}} ELSE a END, {{'u': 0::BIGINT, 'ids': []::BIGINT[], 'tc': 0::BIGINT}}) AS r FROM k),
o AS (SELECT *, CASE WHEN len(r.ids) <= 2 THEN r.ids ELSE list_concat(list_filter(r.ids, lambda x, i: i % 2 = 1), list_reverse(list_filter(r.ids, lambda x, i: i % 2 = 0))) END AS ids FROM b)
SELECT qid, array_to_string(ids, ',') AS ids, array_to_string(ids, E'\\n\\n---\\n\\n') AS context_text, n_candidates, n_candidates - n_kept AS n_duplicates, n_kept - len(ids) AS n_over_budget, len(ids) AS n_selected, r.u AS tokens_used FROM o""")
def render_context(spark, d):
    out = ranking.assemble(candidates(spark, d), BUDGET, SAME)
    return out.select("qid", F.array_join(F.transform("context_ids", lambda x: x.cast("string")), ",").alias("ids"), "context_text", "n_candidates", "n_duplicates", "n_over_budget", "n_selected", "tokens_used")


@register(f"""WITH t AS (SELECT item_id AS qid, list_distinct({tok_sql('text')}) AS q FROM benchmark), {bm25_sql('a', 10)}
SELECT qid, doc_id, round(CASE WHEN len(q) = 0 OR len(toks) = 0 THEN 0 ELSE len(list_intersect(q, toks)) * 1.0 / len(list_distinct(list_concat(q, toks))) END, 6) AS jaccard FROM a JOIN t USING (qid) JOIN a_t USING (doc_id)""")
def jaccard_pairs(spark, d):
    asked = questions(spark, d).select("qid", T.tokens(F.col("query")).alias("q"))
    found = bm25(spark, d, 10).join(asked, "qid").join(docs(spark, d).select("chunk_id", "text"), "chunk_id")
    return found.select("qid", F.col("chunk_id").alias("doc_id"), T.tokens(F.col("text")).alias("t"), "q").select("qid", "doc_id", F.round(T.jaccard(F.col("q"), F.col("t")), 6).alias("jaccard"))


# ---------------------------------------------------------------- golden labels and metrics


@register(f"WITH {GOLD_SQL} SELECT qid, doc_id FROM g")
def gold_labels(spark, d):
    return golden.containing(docs(spark, d), questions(spark, d)).select("qid", F.col("chunk_id").alias("doc_id"))


def scored(spark, d) -> DataFrame:
    return metrics.score_items(gold(spark, d), bm25(spark, d), METRIC_K)


def _metric(name: str, columns: list[str], doc: str) -> None:
    def query(spark, d):
        return scored(spark, d).select("qid", *[F.round(c, 6).alias(c) for c in columns])

    query.__name__, query.__doc__ = name, doc
    register(f"WITH {METRICS_SQL} SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM it")(query)


_metric("recall_at_k", [f"recall_{k}" for k in METRIC_K], "Share of gold in the first k.")
_metric("hit_rate_at_k", [f"hit_{k}" for k in METRIC_K], "Whether any gold is in the first k.")
_metric("precision_at_k", [f"precision_{k}" for k in METRIC_K], "Gold among the results there are, at most k.")
_metric("mrr", ["mrr"], "Reciprocal rank of the first hit.")
_metric("ndcg", ["ndcg"], "Binary gain with a capped ideal.")

_NAMES = [f"{m}_{k}" for m in ("recall", "hit", "precision") for k in METRIC_K] + ["mrr", "ndcg"]


@register(f"WITH {METRICS_SQL} SELECT {', '.join(f'round(coalesce(avg({c}), 0), 6) AS {c}' for c in _NAMES)}, count(*) AS n_evaluated, (SELECT count(*) FROM benchmark) - count(*) AS n_skipped FROM it")
def macro_metrics(spark, d):
    return metrics.macro_average(scored(spark, d), gold(spark, d)).withColumns(r6(*_NAMES))


@register(f"WITH {METRICS_SQL} SELECT question_type, count(*) AS n, round(avg(recall_10), 4) AS recall, round(avg(hit_10), 4) AS hit_rate, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM it GROUP BY question_type")
def metrics_by_type(spark, d):
    return metrics.by_question_type(scored(spark, d))


@register(f"""WITH {GOLD_SQL}, o AS (SELECT doc_id, list_distinct({tok_sql('text')}) AS was FROM documents WHERE doc_id IN (SELECT doc_id FROM g)),
h AS (SELECT doc_id, 0 AS ordinal, substr(text, 1, CAST(ceil(length(text) * 0.75) AS INT)) AS text FROM documents UNION ALL SELECT doc_id, 1, substr(text, CAST(ceil(length(text) * 0.75) AS INT) + 1) FROM documents),
f AS (SELECT g.qid, h.doc_id || '-' || h.ordinal AS new_id FROM g JOIN o USING (doc_id) JOIN h USING (doc_id) WHERE len(was) > 0 AND len(list_intersect(was, {tok_sql('h.text')})) * 1.0 / len(was) >= 0.6),
l AS (SELECT qid, count(DISTINCT new_id) AS n FROM f GROUP BY qid)
SELECT b.item_id AS qid, CASE WHEN n_gold IS NULL THEN 'passed' WHEN n IS NULL THEN 'dropped' WHEN n > n_gold THEN 'expanded' ELSE 'remapped' END AS outcome, coalesce(n, 0) AS n_gold
FROM benchmark b LEFT JOIN gi ON gi.qid = b.item_id LEFT JOIN l ON l.qid = b.item_id""")
def remap_golden(spark, d):
    """Each document is cut after three quarters; labels move to the part that holds the words."""
    items = gold(spark, d).withColumn("gold_chunk_ids", F.transform("gold_chunk_ids", lambda x: x.cast("string")))
    old = docs(spark, d).select(F.col("chunk_id").cast("string").alias("chunk_id"), "doc_id", "text")
    at = F.ceil(F.length("text") * F.lit(0.75).cast("double")).cast("int")
    parts = F.array(F.substring(F.col("text"), F.lit(1), at), F.substring(F.col("text"), at + 1, F.length("text")))
    new = docs(spark, d).select("doc_id", F.posexplode(parts).alias("ordinal", "text")).select(F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), "doc_id", "ordinal", "text")
    return golden.remap(items, old, new).select("qid", "outcome", F.coalesce(F.when(F.col("outcome") != "dropped", F.size("gold_chunk_ids")), F.lit(0)).alias("n_gold"))


@register("SELECT c.conv_id AS qid, c.turn AS doc_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.turn)")
def gold_integrity(spark, d):
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.array("turn").alias("gold_chunk_ids"))
    return golden.missing_gold(items, table(spark, d, "labels"), "doc_id")


@register("""SELECT conv_id AS qid, count(DISTINCT length(text) % 3) AS n_documents FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING count(DISTINCT length(text) % 3) < 2""")
def multihop_check(spark, d):
    """A conversation's user turns are an item's gold chunks; the length of a turn modulo 3 stands for its document."""
    turns = table(spark, d, "conversations").where("role = 'user'").withColumn("chunk_id", F.col("conv_id") * 100_000 + F.col("turn"))
    items = turns.groupBy(F.col("conv_id").alias("qid")).agg(F.collect_list("chunk_id").alias("gold_chunk_ids")).withColumn("question_type", F.lit("multi_hop"))
    return golden.single_document_multi_hop(items, turns.select("chunk_id", (F.length("text") % 3).alias("doc_id")))


@register("""WITH h AS (SELECT p_partkey AS id, p_brand AS term, md5('g:' || p_partkey) AS h FROM part UNION SELECT p_partkey, p_type, md5('g:' || p_partkey) FROM part),
t AS (SELECT term, count(*) AS n FROM h GROUP BY term),
s AS (SELECT h.*, CAST('0x' || substr(h, 9, 6) AS BIGINT) % CAST(ceil(n / 1000) AS BIGINT) AS b FROM h JOIN t USING (term)),
l AS (SELECT *, row_number() OVER (PARTITION BY term, b ORDER BY h, id) AS nth, count(*) OVER (PARTITION BY term, b) AS c FROM s),
w AS (SELECT term, b, id, (nth - 1 + j) % c + 1 AS nth FROM (SELECT *, unnest(range(1, least(4, c))) AS j FROM l)),
p AS (SELECT w.id, l.id AS other, min(md5(l.h || w.id)) AS h FROM w JOIN l ON w.term = l.term AND w.b = l.b AND w.nth = l.nth WHERE w.id <> l.id GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h, other) AS nth FROM p) WHERE nth < 4),
o AS (SELECT id, count(*) AS n, string_agg(other, ',' ORDER BY nth) AS others FROM c GROUP BY id)
SELECT id AS p_partkey, id || ',' || others AS members FROM o WHERE n = 3""")
def aggregation_groups(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("terms"))
    groups = golden.sharing_terms(parts, 4, "g", "p_partkey")
    return groups.select("p_partkey", F.array_join(F.transform("group", lambda x: x.cast("string")), ",").alias("members"))


@register("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('20260806:' || doc_id), doc_id) - 1 AS place FROM documents)
SELECT doc_id, place, CASE WHEN place < 240 THEN 'factoid' WHEN place < 360 THEN 'multi_hop' WHEN place < 420 THEN 'aggregation' ELSE 'unanswerable' END AS question_type FROM p WHERE place < 540""")
def golden_seeds(spark, d):
    return golden.seeds(table(spark, d, "documents"), golden.Quotas(), "doc_id").select("doc_id", "place", "question_type")


_RULES_SQL = "CASE r.n " + " ".join(f"WHEN {n} THEN '{t.replace(chr(39), chr(39) * 2)}'" for n, t in golden.RULES.items()) + " ELSE 'rule ' || r.n END"


@register(f"""WITH r AS (SELECT doc_id, unnest([1 + doc_id % 5, 5 + doc_id % 2]) AS n FROM labels WHERE toxic = 1),
n AS (SELECT {_RULES_SQL} AS reason FROM r UNION ALL SELECT 'rejected without a stated rule' FROM labels WHERE toxic <> 1 AND quality = 0)
SELECT reason, count(*) AS n FROM n GROUP BY reason""")
def rejection_histogram(spark, d):
    c = F.col
    rules = F.concat(F.lit("["), (1 + c("doc_id") % 5).cast("string"), F.lit(', "'), (5 + c("doc_id") % 2).cast("string"), F.lit('."]'))
    body = F.concat(F.lit('{"keep": '), F.when((c("toxic") == 1) | (c("quality") == 0), "false").otherwise("true"), F.lit(', "violated_rules": '), F.when(c("toxic") == 1, rules).otherwise("[]"), F.lit("}"))
    rows = table(spark, d, "labels").select(c("doc_id").alias("qid"), F.lit("factoid").alias("question_type"), body.alias("response"))
    return golden.rejection_counts(golden.screen(rows))


# ---------------------------------------------------------------- generation, judging, failures


def judged(spark, d) -> DataFrame:
    """A judge's responses made up from labels: claims, a relevance score, verdicts on passages."""
    c = F.col
    claims = F.transform(F.sequence(F.lit(1), (c("doc_id") % 4).cast("int") + 1), lambda i: F.struct(F.lit("c").alias("claim"), F.when(i % 3 == c("quality"), F.lit("Supported ")).when(i % 3 == 2, F.lit("contradicted")).otherwise("unsupported").alias("verdict")))
    verdicts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.alias("index"), ((i + c("doc_id")) % 2 == 0).alias("useful")))
    answer = F.when(c("doc_id") % 7 == 0, "INSUFFICIENT CONTEXT").when(c("doc_id") % 11 == 0, F.lit("@" * 15)).otherwise("fine")
    return table(spark, d, "labels").select(
        c("doc_id").alias("qid"), F.lit("factoid").alias("question_type"), answer.alias("answer"), (c("quality") == 1).alias("answerable"),
        F.when(c("doc_id") % 13 == 0, "not json").otherwise(F.to_json(F.struct(claims.alias("claims")))).alias("claims_json"),
        F.to_json(F.struct(((c("doc_id") % 8) / 5.0 - 0.1).alias("score"))).alias("score_json"), F.to_json(F.struct(verdicts.alias("verdicts"))).alias("verdicts_json"), F.lit(3).alias("n_passages"),
    )


JUDGED_SQL = """c AS (SELECT doc_id AS qid, quality, doc_id % 11 = 0 AND doc_id % 7 <> 0 AS deg, doc_id % 7 = 0 AS abst, range(1, CAST(doc_id % 4 AS INT) + 2) AS cl, doc_id FROM labels),
j AS (SELECT qid, deg AS degenerate, abst AS abstained, CASE WHEN NOT deg THEN abst <> (quality = 1) END AS abstention_correct, NOT deg AND NOT abst AS ok, doc_id % 13 = 0 AS bad,
  len(cl) AS n, len(list_filter(cl, lambda i: i % 3 = quality)) AS good, greatest(0.0, least(1.0, (doc_id % 8) / 5.0 - 0.1)) AS rel, CASE WHEN doc_id % 2 = 0 THEN 1.0 / 3 ELSE 2.0 / 3 END AS prec FROM c),
items AS (SELECT qid, degenerate, abstained, abstention_correct, CASE WHEN ok AND NOT bad THEN good * 1.0 / n WHEN abstained THEN 1.0 END AS faithfulness, CASE WHEN ok THEN rel END AS answer_relevance,
  CASE WHEN ok THEN prec END AS context_precision, CASE WHEN ok AND NOT bad THEN n ELSE 0 END AS n_claims, CASE WHEN ok AND NOT bad THEN n - good ELSE 0 END AS n_unsupported,
  CAST(degenerate OR (ok AND bad) AS BIGINT) AS n_errors FROM j)"""


@register(f"WITH {JUDGED_SQL} SELECT qid, degenerate, abstained, abstention_correct, round(faithfulness, 6) AS faithfulness, round(answer_relevance, 6) AS answer_relevance, round(context_precision, 6) AS context_precision, n_claims, n_unsupported, n_errors FROM items")
def score_generation(spark, d):
    items = generation.score_items(judged(spark, d)).withColumns(r6("faithfulness", "answer_relevance", "context_precision"))
    return items.withColumn("n_errors", F.size("errors")).drop("errors", "question_type")


_GEN = ["faithfulness", "answer_relevance", "context_precision", "abstention_accuracy", "hallucination_rate"]
_HALL = "round(sum(n_unsupported) FILTER (NOT abstained AND NOT degenerate AND n_claims > 0) * 1.0 / sum(n_claims) FILTER (NOT abstained AND NOT degenerate AND n_claims > 0), 6) AS hallucination_rate"


@register(f"""WITH {JUDGED_SQL} SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance, round(avg(context_precision), 6) AS context_precision,
round(avg(CAST(abstention_correct AS INT)), 6) AS abstention_accuracy, {_HALL}, count(*) AS n_evaluated, count(*) FILTER (n_errors > 0) AS n_errors, count(*) FILTER (degenerate) AS n_degenerate FROM items""")
def generation_aggregate(spark, d):
    return generation.aggregate_items(generation.score_items(judged(spark, d))).withColumns(r6(*_GEN))


@register(f"WITH {JUDGED_SQL} SELECT {_HALL} FROM items")
def hallucination_rate(spark, d):
    return generation.aggregate_items(generation.score_items(judged(spark, d))).select(F.round("hallucination_rate", 6).alias("hallucination_rate"))


@register("SELECT conv_id, turn, regexp_matches(text, '(?i)INSUFFICIENT[\\s_-]*CONTEXT') AS abstained, regexp_matches(text, '(?i)INSUFFICIENT[\\s_-]*CONTEXT') <> (turn > 1) AS correct FROM conversations WHERE role = 'assistant'")
def abstention_rescore(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("answer"), (F.col("turn") > 1).alias("answerable"))
    return generation.rescore_abstention(rows).select("qid.conv_id", "qid.turn", "abstained", "correct")


_PROMPT_SQL = "'" + generation.TEMPLATE.replace("'", "''").replace("{sentinel}", T.ABSTENTION_SENTINEL).replace("{context}", "' || '[doc ' || item_id || '] ' || text || '").replace("{question}", "' || text || '") + "'"


@register(f"SELECT item_id AS qid, length({_PROMPT_SQL}) AS n_chars, md5({_PROMPT_SQL}) AS digest FROM benchmark")
def build_prompt(spark, d):
    own = questions(spark, d).select("qid", generation.prompt(F.col("query"), F.concat(F.lit("[doc "), F.col("qid").cast("string"), F.lit("] "), "query")).alias("p"))
    return own.select("qid", F.length("p").alias("n_chars"), F.md5("p").alias("digest"))


def human_labels(spark, d) -> DataFrame:
    c = F.col
    parts = [F.struct(F.lit(m).alias("metric"), s.cast("double").alias("score")) for m, s in (("faithfulness", c("quality")), ("answer_relevance", c("toxic")))]
    return table(spark, d, "labels").select(c("doc_id").alias("qid"), F.inline(F.array(*parts)))


PAIRS_SQL = JUDGED_SQL + """,
hl AS (SELECT doc_id AS qid, 'faithfulness' AS metric, CAST(quality AS DOUBLE) AS human FROM labels UNION ALL SELECT doc_id, 'answer_relevance', CAST(toxic AS DOUBLE) FROM labels),
jl AS (SELECT qid, 'faithfulness' AS metric, CAST(faithfulness AS DOUBLE) AS judge FROM items UNION ALL SELECT qid, 'answer_relevance', CAST(answer_relevance AS DOUBLE) FROM items),
pairs AS (SELECT metric, qid, judge, human FROM hl JOIN jl USING (qid, metric) WHERE judge IS NOT NULL),
v AS (SELECT metric, count(*) AS n, avg(CASE WHEN abs(judge - human) <= 0.25 THEN 1.0 ELSE 0.0 END) AS agreement, avg(judge) AS mean_judge, avg(human) AS mean_human, (sum(judge) - sum(human)) / count(*) AS bias,
  avg(abs(judge - human)) AS mae, CASE WHEN count(*) >= 3 AND stddev_pop(judge) > 1e-12 AND stddev_pop(human) > 1e-12 THEN covar_pop(judge, human) / (stddev_pop(judge) * stddev_pop(human)) END AS correlation FROM pairs GROUP BY metric)"""


def judge_pairs(spark, d) -> DataFrame:
    return judging.paired(generation.score_items(judged(spark, d)), human_labels(spark, d))


@register(f"""WITH {PAIRS_SQL}, w AS (SELECT *, 1.96 * sqrt(greatest(agreement * (1 - agreement), 1e-9) / n) AS half FROM v)
SELECT metric, n, round(agreement, 6) AS agreement, round(mean_judge, 6) AS mean_judge, round(mean_human, 6) AS mean_human, round(bias, 6) AS bias, round(mae, 6) AS mae,
round(greatest(0, agreement - half), 6) AS ci_low, round(least(1, agreement + half), 6) AS ci_high,
CASE WHEN n < 20 THEN 'unvalidated' ELSE CASE WHEN agreement >= 0.8 THEN 'usable' WHEN agreement >= 0.65 THEN 'weak' ELSE 'unreliable' END || ', ' || CASE WHEN bias > 0.05 THEN 'generous' WHEN bias < -0.05 THEN 'harsh' ELSE 'unbiased' END END AS verdict FROM w""")
def judge_agreement(spark, d):
    return judging.validate(judge_pairs(spark, d)).drop("correlation").withColumns(r6("agreement", "mean_judge", "mean_human", "bias", "mae", "ci_low", "ci_high"))


@register(f"WITH {PAIRS_SQL} SELECT metric, round(correlation, 6) AS correlation FROM v")
def judge_pearson(spark, d):
    return judging.validate(judge_pairs(spark, d)).select("metric", F.round("correlation", 6).alias("correlation"))


@register(f"""WITH {PAIRS_SQL}, w AS (SELECT *, round(judge - human, 3) AS delta FROM pairs WHERE abs(judge - human) > 0.25)
SELECT metric, qid, delta, nth FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(delta) DESC, qid) AS nth FROM w) WHERE nth <= 10""")
def judge_disagreements(spark, d):
    return judging.disagreements(judge_pairs(spark, d)).select("metric", "qid", "delta", "nth")


@register("SELECT doc_id AS qid, 'faithfulness' AS metric, text AS question, lang AS answer, CAST(NULL AS DOUBLE) AS score, '' AS note FROM documents WHERE doc_id IN (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 50)")
def labeling_template(spark, d):
    records = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"), F.col("lang").alias("answer"))
    return judging.labeling_template(generation.score_items(judged(spark, d)), records)


def failure_records(spark, d) -> DataFrame:
    ranked = bm25(spark, d)
    lists = ranked.groupBy("qid").agg(F.collect_list("chunk_id").alias("ranked_ids"), F.collect_list(F.when(F.col("rank") <= 2, F.col("chunk_id"))).alias("context_ids"))
    items = scored(spark, d).select("qid", F.col("recall_10").alias("recall"), "first_hit_rank")
    q = F.col("qid")
    none = F.array().cast("array<bigint>")
    return (
        gold(spark, d).join(lists, "qid", "left").join(items, "qid", "left")
        .withColumns({"ranked_ids": F.coalesce("ranked_ids", none), "context_ids": F.coalesce("context_ids", none), "answer": F.when(q % 9 == 8, F.lit(None).cast("string")).otherwise(F.col("question"))})
        .withColumns({"abstained": q % 6 == 0, "error": F.when(q % 10 == 9, "boom"), "n_claims": F.lit(4), "n_unsupported": (q % 5).cast("int"), "faithfulness": 1 - (q % 5) / 4.0})
    )


FAILURE_SQL = METRICS_SQL + """,
rec AS (SELECT b.item_id AS qid, n_gold, recall_10 AS recall, first_hit_rank, b.item_id % 6 = 0 AS abstained, CASE WHEN b.item_id % 9 = 8 THEN NULL ELSE b.text END AS answer, b.item_id % 10 = 9 AS err, 1 - (b.item_id % 5) / 4.0 AS faith, b.item_id % 5 AS uns
  FROM benchmark b LEFT JOIN gi ON gi.qid = b.item_id LEFT JOIN it ON it.qid = b.item_id),
cls AS (SELECT *, CASE WHEN err THEN 'error' WHEN n_gold IS NULL AND NOT abstained AND answer IS NOT NULL THEN 'abstention' WHEN n_gold IS NULL THEN NULL WHEN first_hit_rank IS NULL THEN 'retrieval' WHEN first_hit_rank > 2 THEN 'ranking'
  WHEN abstained THEN 'abstention' WHEN faith < 0.8 THEN 'generation' WHEN recall < 0.5 THEN 'retrieval' END AS category FROM rec)"""


@register(f"""WITH {FAILURE_SQL} SELECT qid, category, CASE WHEN err THEN 'boom' WHEN category IS NULL THEN NULL WHEN n_gold IS NULL THEN 'answered a question the corpus cannot support (hallucination risk)'
WHEN first_hit_rank IS NULL THEN 'no gold chunk appeared anywhere in the ranked list' WHEN category = 'ranking' THEN 'gold chunk was retrieved at rank ' || first_hit_rank || ' but fell below the context cutoff'
WHEN category = 'abstention' THEN 'refused despite the gold chunk being present in the context' WHEN category = 'generation' THEN uns || '/4 claims unsupported despite correct context'
ELSE printf('partial recall (%.2f): some gold chunks were never retrieved', recall) END AS detail FROM cls""")
def classify_failures(spark, d):
    return failures.classify(failure_records(spark, d)).select("qid", "category", "detail")


@register(f"WITH {FAILURE_SQL} SELECT k.category, count(cls.qid) AS n FROM (SELECT unnest(['retrieval', 'ranking', 'abstention', 'generation', 'error', 'clean']) AS category) k LEFT JOIN cls ON coalesce(cls.category, 'clean') = k.category GROUP BY k.category")
def failure_counts(spark, d):
    return failures.category_counts(failures.classify(failure_records(spark, d)))


@register(f"WITH {FAILURE_SQL} SELECT qid, category FROM cls WHERE category IS NOT NULL ORDER BY category <> 'error', coalesce(CASE WHEN err OR n_gold IS NULL THEN recall ELSE recall END, 0), coalesce(faith, 0), qid LIMIT 20")
def worst_failures(spark, d):
    return failures.worst(failures.classify(failure_records(spark, d))).select("qid", "category")


@register(f"WITH {GOLD_SQL}, {bm25_sql('a', 20)} SELECT b.item_id AS qid, coalesce(bool_or(a.rank <= 5), false) AS in_context, count(a.rank) > 0 AS in_ranked FROM benchmark b LEFT JOIN g ON g.qid = b.item_id LEFT JOIN a ON a.qid = g.qid AND a.doc_id = g.doc_id GROUP BY b.item_id")
def gold_reached(spark, d):
    hits = bm25(spark, d).join(golden.containing(docs(spark, d), questions(spark, d)), ["qid", "chunk_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    return questions(spark, d).join(hits, "qid", "left").select("qid", F.coalesce(F.col("first") <= 5, F.lit(False)).alias("in_context"), F.col("first").isNotNull().alias("in_ranked"))


# ---------------------------------------------------------------- telemetry, gates, ablation


def spans(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"), "event_id")


STAGES = ("click", "view")
_LAT = """t AS (SELECT user_id, event_type AS stage, sum(value) AS ms FROM events GROUP BY 1, 2),
u AS (SELECT user_id, sum(ms) AS total, sum(CASE WHEN stage IN ('click', 'view') THEN ms ELSE 0 END) AS part FROM t GROUP BY 1),
l AS (SELECT stage, ms FROM t UNION ALL SELECT 'TOTAL', total FROM u UNION ALL SELECT 'TOTAL_RETRIEVAL', part FROM u),
s AS (SELECT stage, list_sort(list(ms)) AS v FROM l GROUP BY stage)"""


@register(f"WITH {_LAT} SELECT stage, len(v) AS n, round(list_avg(v), 2) AS mean_ms, round(v[CAST(floor((len(v) - 1) * 0.5) AS INT) + 1], 2) AS p50_ms, round(v[CAST(floor((len(v) - 1) * 0.95) AS INT) + 1], 2) AS p95_ms FROM s")
def latency_percentiles(spark, d):
    return telemetry.latency_summary(spans(spark, d), STAGES)


@register(f"WITH {_LAT} SELECT CAST(user_id AS VARCHAR) AS trace_id, round(total, 2) AS total_ms, round(part, 2) AS retrieval_ms, (SELECT count(*) FROM events e WHERE e.user_id = u.user_id) AS n_spans FROM u")
def latency_rollup(spark, d):
    return telemetry.trace_totals(spans(spark, d), STAGES)


@register("SELECT CAST(user_id AS VARCHAR) AS trace_id, round(sum(value), 2) AS total_ms, string_agg(event_type || '=' || CAST(round(value, 2) AS DOUBLE), ';' ORDER BY event_id) AS spans FROM events GROUP BY user_id")
def trace_export(spark, d):
    out = telemetry.trace_export(spans(spark, d), "event_id")
    return out.select("trace_id", "total_ms", F.array_join(F.transform("spans", lambda s: F.concat(s["stage"], F.lit("="), s["ms"].cast("string"))), ";").alias("spans"))


@register(f"""WITH {METRICS_SQL}, {_LAT}, m AS (SELECT avg(recall_10) AS recall_10, avg(ndcg) AS ndcg FROM it), p AS (SELECT v[CAST(floor((len(v) - 1) * 0.95) AS INT) + 1] AS p95 FROM s WHERE stage = 'TOTAL_RETRIEVAL')
SELECT gate, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold, passed FROM (SELECT 'recall@10' AS gate, recall_10 AS value, 0.8 AS threshold, recall_10 >= 0.8 AS passed FROM m UNION ALL SELECT 'ndcg', ndcg, 0.6, ndcg >= 0.6 FROM m
UNION ALL SELECT 'faithfulness', NULL, 0.7, true UNION ALL SELECT 'p95_ms', round(p95, 2), 1500, round(p95, 2) <= 1500 FROM p)""")
def gates(spark, d):
    totals = metrics.macro_average(scored(spark, d), gold(spark, d)).select("recall_10", "ndcg", F.lit(None).cast("double").alias("faithfulness"))
    p95 = telemetry.latency_summary(spans(spark, d), STAGES).where("stage = 'TOTAL_RETRIEVAL'").select("p95_ms")
    return evaluation.gates(totals.join(p95), Config()).withColumns(r6("value"))


@register(f"""WITH {FUSED_SQL}, {GOLD_SQL}, nt AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id) AS rank FROM (
 SELECT qid, doc_id, sum(CASE WHEN a1 - a0 < 1e-12 THEN 1.0 ELSE (score - a0) / (a1 - a0) END) AS s FROM (SELECT *, min(score) OVER w AS a0, max(score) OVER w AS a1 FROM r WINDOW w AS (PARTITION BY qid, source)) JOIN src USING (qid) WHERE n_src > 1 GROUP BY 1, 2)
 UNION ALL SELECT qid, doc_id, rank FROM r JOIN src USING (qid) WHERE n_src = 1),
allr AS (SELECT 'bm25' AS label, qid, doc_id, rank FROM a UNION ALL SELECT 'raw', qid, doc_id, rank FROM b UNION ALL SELECT 'rrf', qid, doc_id, rank FROM fused UNION ALL SELECT 'normalized_sum', qid, doc_id, rank FROM nt),
lab AS (SELECT unnest(['bm25', 'raw', 'rrf', 'normalized_sum']) AS label),
x AS (SELECT label, gi.qid, n_gold, count(allr.rank) FILTER (allr.rank <= 10) AS h, min(allr.rank) AS f FROM lab CROSS JOIN gi JOIN g USING (qid) LEFT JOIN allr USING (label, qid, doc_id) GROUP BY 1, 2, 3)
SELECT label, round(avg(h * 1.0 / n_gold), 6) AS recall_10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, count(*) AS n_evaluated FROM x GROUP BY label""")
def ablation_matrix(spark, d):
    """Configurations over shared rankings."""
    items, first, second = gold(spark, d), bm25(spark, d), bm25_raw(spark, d)
    lists = {"bm25": first, "raw": second, "rrf": fusion.fuse(first.unionByName(second)), "normalized_sum": fusion.fuse(first.unionByName(second), "normalized_sum")}
    out = None
    for label, ranked in lists.items():
        row = metrics.macro_average(metrics.score_items(items, ranked, (10,)), items).select(F.lit(label).alias("label"), *[F.round(c, 6).alias(c) for c in ("recall_10", "mrr")], "n_evaluated")
        out = row if out is None else out.unionByName(row)
    return out
