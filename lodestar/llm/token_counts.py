"""Token counts of documents in flat token files that have no index.

A flat file is a run of little-endian token ids in which an end-of-document id closes each document;
nothing says where documents begin.  Files are read in blocks of ids that ignore documents.
Each block is searched for the end id in one vectorised comparison; a prefix scan over the
block summaries (ids, end ids, last end) then gives each block the place and the
length of the document that runs into it.

**Writing.**  ``write_flat`` writes such files with Spark's own text sink: a row is some documents' ids as raw
bytes, and the line separator is the end id.  So files go to any store that Spark writes to.
Ids of documents, in the order of the file, lie beside it in a file of the same number.
Texts are encoded as plain text: a text that spells a special token gets ordinary ids, so the end id
can only close documents.  An end id that texts do encode to is refused.

**Reading.**  Files that tasks can open (a shared mount) are read by ranges, whatever their size.  In
stores that only Spark reads, a file is one row of at most 2 GB and is cut into blocks in its task.

**Scale.**  The search has no shuffle of ids; the prefix scan sees one small row per block and is done
per file.  Output is one row per document.

**Defined cases.**  Ids after the last end id of a file are a document with ``closed`` false; an
empty document (two end ids in a row, or the text is null or empty) has one token; empty files give no rows.
Repeated rows are written as often as they occur; ids of documents are passed on as they
are, null ones too.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Batches, materialize, release_memory
from lodestar.llm.encode import encoder
from lodestar.llm.token_files import binary_rows
from lodestar.llm.wordhash import text_slices

BLOCK_IDS = 1 << 20
#: Bytes of files that one task searches.
TASK_BYTES = 1 << 26
KINDS = {1: "u1", 2: "<u2", 4: "<u4", 8: "<u8"}
SUMMARY = "file string, block int, n long, ends array<long>"


def write_flat(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_bytes: int = 4) -> DataFrame:
    """Writes the flat files of ``docs(doc_id, text)`` under ``path``, and returns (file, ordinal, doc_id).

    ``file`` is the number in a file's name, ``ordinal`` the place of the document in it.  A task writes two
    files of its number: the flat one in ``kind=flat``, and its documents' ids, in order, in ``kind=docs``.
    """
    spark, kind = docs.sparkSession, KINDS[id_bytes]

    def run(batches: Batches) -> Batches:
        enc, seq, ordinal = encoder(tokenizer_path, plain=True), 0, 0
        if enc.vocab_size > 1 << (8 * id_bytes):
            raise ValueError(f"{enc.vocab_size} ids do not fit into {id_bytes} bytes")
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, _ = enc.encode(data, offsets, end_id)
                if int((ids == end_id).sum()) != hi - lo:
                    raise ValueError(f"texts encode to the end id {end_id}")
                names = ",".join("" if i is None else str(i) for i in batch.column(0).slice(lo, hi - lo).to_pylist())
                values = [ids[:-1].astype(kind).tobytes(), f"{ordinal}:{names}".encode()]  # the sink writes the last end id
                yield pa.RecordBatch.from_arrays([pa.array(["flat", "docs"]), pa.array([seq, seq]), pa.array(values, pa.binary())], names=["kind", "seq", "value"])
                seq, ordinal = seq + 1, ordinal + hi - lo
        encoder.cache_clear()
        release_memory()

    # a byte is a character of ISO-8859-1, so the separator is written as it is
    raw = {"encoding": "ISO-8859-1", "lineSep": end_id.to_bytes(id_bytes, "little").decode("latin-1")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind string, seq long, value binary")
    rows.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").options(**raw).text(path)
    if not has_folder(spark, f"{path}/kind=docs"):  # an empty table writes no files
        return spark.createDataFrame([], "file int, ordinal long, doc_id long")
    lists = spark.read.options(**raw).text(f"{path}/kind=docs").select(file_number(F.col("_metadata.file_name")).alias("file"), F.split("value", "[:,]").alias("ids"))
    each = lists.select("file", F.element_at("ids", 1).cast("long").alias("first"), F.posexplode(F.slice("ids", 2, F.size("ids"))).alias("i", "id"))
    return each.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.expr("try_cast(id AS BIGINT)").alias("doc_id"))


def file_number(name) -> F.Column:
    return F.regexp_extract(name, r"part-(\d+)-[^/]*$", 1).cast("int")


def has_folder(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def summaries(spark: SparkSession, path: str, end_id: int, id_bytes: int = 4, block_ids: int = BLOCK_IDS, ranged: bool | None = None) -> DataFrame:
    """(file, block, n, ends) of each block of raw files: ids in it, and the places of end ids."""
    kind, step = KINDS[id_bytes], block_ids * id_bytes
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content").where("length > 0")
    if ranged is None:
        ranged = urlparse(path).scheme in ("", "file")

    def row(file: str, block: int, raw) -> pa.RecordBatch:
        ids = np.frombuffer(raw, kind)
        return pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([np.flatnonzero(ids == end_id)], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"]
        )

    def by_range(batches: Batches) -> Batches:
        encoder.cache_clear()  # a reused worker may still hold units
        release_memory()
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(unquote(urlparse(file).path), "rb") as f:
                    f.seek(block * step)
                    yield row(file, block, f.read(step))

    def by_content(batches: Batches) -> Batches:
        encoder.cache_clear()
        release_memory()
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = memoryview(content.as_buffer())
                for block in range(-(-len(held) // step)):
                    yield row(file, block, held[block * step : (block + 1) * step])

    if not ranged:
        return files.select("path", "content").mapInArrow(by_content, SUMMARY)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = files.select("path", F.explode(F.expr(f"sequence(0, cast((length - 1) div {step} as int))")).alias("block"))
    return blocks.repartition(max(1, -(-total // TASK_BYTES)), "path", "block").mapInArrow(by_range, SUMMARY)


def scan(blocks: DataFrame) -> DataFrame:
    """``summaries`` to (file, ordinal, start, n_tokens, closed) of every document."""
    found = materialize(blocks, "flat-blocks")
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    placed = (
        found.select("file", "block", "n", F.size("ends").alias("n_ends"), last.alias("last"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("docs_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("last_end", F.col("base") + F.col("last"))
        .withColumn("open_at", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
        .withColumn("final", F.lead("block").over(in_order).isNull())
    )
    closed = found.select("file", "block", "ends").join(placed.select("file", "block", "base", "docs_before", "open_at"), ["file", "block"]).select(
        "file",
        F.expr(
            "inline(transform(ends, (e, i) -> struct(docs_before + i AS ordinal,"
            " IF(i = 0, open_at, base + try_element_at(ends, i) + 1) AS start, base + e + 1 AS stop, true AS closed)))"
        ),
    )
    tail_start = F.coalesce(F.col("last_end") + 1, F.col("open_at"))
    tail = placed.where(F.col("final") & (tail_start < F.col("base") + F.col("n"))).select(
        "file", (F.col("docs_before") + F.col("n_ends")).alias("ordinal"), tail_start.alias("start"), (F.col("base") + F.col("n")).alias("stop"), F.lit(False).alias("closed")
    )
    return closed.unionByName(tail).select("file", F.col("ordinal").cast("long").alias("ordinal"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def count_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_bytes: int = 4, block_ids: int = BLOCK_IDS, ranged: bool | None = None) -> DataFrame:
    """Writes ``docs`` as flat files and counts them back: (doc_id, file, ordinal, start, n_tokens)."""
    order = write_flat(docs, path, tokenizer_path, end_id, id_bytes)
    if not has_folder(docs.sparkSession, f"{path}/kind=flat"):
        return order.selectExpr("doc_id", "file", "ordinal", "0L AS start", "0L AS n_tokens")
    places = scan(summaries(docs.sparkSession, f"{path}/kind=flat", end_id, id_bytes, block_ids, ranged))
    return order.join(places.select(file_number(F.col("file")).alias("file"), "ordinal", "start", "n_tokens"), ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "start", "n_tokens")
