"""Readers and writers: local documents, JSON Lines, literature XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions import text as T

# Suffixes that count as documents.
SUFFIXES = ("md", "markdown", "txt", "html", "htm")
MAX_AUTHORS = 12


def read_local(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder and its subfolders; bytes that are not UTF-8 become U+FFFD.

    The title is the first heading, else the file's stem with spaces for underscores; files
    without text are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    root = F.lit("/" + folder.split("://")[-1].strip("/") + "/")
    rows = raw.select(path.alias("path"), F.col("length").alias("bytes"), "content")
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.decode("utf-8", "replace") for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["path", "bytes", "body"])

    texts = rows.mapInArrow(decode, "path string, bytes long, body string")
    is_html = F.lower("path").rlike(r"\.html?$")
    sections = F.when(is_html, T.html_sections(F.col("body"))).otherwise(T.markdown_sections(F.col("body")))
    relative = F.expr("CASE WHEN startswith(path, root) THEN substring(path, length(root) + 1) ELSE path END")
    stem = F.replace(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), F.lit("_"), F.lit(" "))
    docs = texts.withColumn("root", root).withColumn("sections", sections).withColumn("relative", relative)
    docs = docs.where(F.exists("sections", lambda s: s["text"] != ""))
    heading = F.get(F.filter(F.transform("sections", lambda s: s["heading"]), lambda h: h.isNotNull()), F.lit(0))
    meta = F.from_json(F.to_json(F.struct("path", "bytes")), schemas.META)
    return docs.select(
        F.concat(F.lit("local:"), "relative").alias("doc_id"), F.coalesce(heading, stem).alias("title"), F.lit("local").alias("source_type"), "sections",
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("date"), meta.alias("meta"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file; a missing file is an empty table, blank lines are skipped."""
    try:
        rows = spark.read.schema(schema).json(path)
        return rows.where(F.to_json(F.struct("*")) != "{}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_jsonl(rows: DataFrame, path: str) -> int:
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path).count()


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.GOLDEN)


def _flat(node: ET.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _year(article: ET.Element) -> str | None:
    date = article.find(".//Journal/JournalIssue/PubDate")
    if date is None:
        return None
    if own := _flat(date.find("Year")):
        return own
    words = _flat(date.find("MedlineDate")).split()
    lead = words[0].partition("-")[0] if words else ""
    return lead if lead.isdigit() else None


def _sections(article: ET.Element) -> list[dict]:
    parts = article.findall("Abstract/AbstractText")
    named = [((p.get("Label") or p.get("NlmCategory") or "").strip().title() or None, _flat(p)) for p in parts]
    kept = [{"heading": h, "text": t} for h, t in named if t]
    if len(kept) == 1 and kept[0]["heading"] is None:
        kept[0]["heading"] = "Abstract"
    return kept


def parse_record(node: ET.Element) -> dict | None:
    """A literature record as a document row; None without an id, an article or an abstract."""
    pmid, article = _flat(node.find(".//MedlineCitation/PMID")), node.find(".//MedlineCitation/Article")
    sections = _sections(article) if article is not None else []
    if not pmid or not sections:
        return None
    listed = lambda at, path: [t for t in map(_flat, at.findall(path)) if t]
    doi = next((_flat(i) for i in node.findall(".//ArticleIdList/ArticleId") if i.get("IdType") == "doi"), "")
    people = [(_flat(a.find("LastName")), _flat(a.find("Initials"))) for a in article.findall(".//AuthorList/Author")[:MAX_AUTHORS]]
    meta = {
        "pmid": pmid, "journal": _flat(article.find(".//Journal/Title")), "doi": doi, "publication_types": listed(article, ".//PublicationTypeList/PublicationType"),
        "mesh_terms": listed(node, ".//MeshHeadingList/MeshHeading/DescriptorName"), "authors": [f"{last} {first}".strip() for last, first in people if last], "path": None, "bytes": None,
    }
    return {
        "doc_id": f"pmid:{pmid}", "title": _flat(article.find("ArticleTitle")) or "(untitled)", "source_type": "pubmed", "sections": sections,
        "url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/", "date": _year(article), "meta": meta,
    }


def parse_records(xml: str) -> list[dict]:
    """All usable records of one response; a response that is not XML has none."""
    try:
        tree = ET.fromstring(xml)
    except ET.ParseError:
        return []
    return [row for row in map(parse_record, tree.iter("PubmedArticle")) if row]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read_literature_xml(spark: SparkSession, path: str) -> DataFrame:
    """Documents of saved literature responses, one XML file each."""
    kind = arrow_schema(schemas.DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xml in batch.column(0).to_pylist():
                if rows := parse_records(xml):
                    yield from pa.Table.from_pylist(rows, schema=kind).to_batches()

    return spark.read.text(path, wholetext=True).mapInArrow(run, schemas.DOCUMENTS)


def distinct_documents(docs: DataFrame, *order: str) -> DataFrame:
    """One row per doc_id, that of the first query which found it (``order``, by default its ordinal)."""
    from pyspark.sql import Window

    first = Window.partitionBy("doc_id").orderBy(*(order or ("query_ordinal",)))
    return docs.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def ids_to_fetch(found: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``found(doc_id, query_ordinal, place)`` of several searches to the ids that must be fetched.

    Each id once, by the query that found it first, and none that ``held(doc_id)`` has already.
    """
    once = distinct_documents(found, "query_ordinal", "place")
    return once if held is None else once.join(held.select("doc_id").distinct(), "doc_id", "left_anti")
