"""Exact dense retrieval and a model-free embedder.

Query vectors are sent to the tasks, up to ``PASS_QUERIES`` in one pass over the vectors; every task multiplies
blocks of them with its part of the matrix and keeps its own top k, and the tasks' lists are merged
by a window.  No approximation and no cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lexical import top_k

#: Query vectors sent to the executors for one pass over the vectors, and multiplied at once.
PASS_QUERIES = 1 << 17
QUERY_BLOCK = 4096
#: Floor of the denominator of cosine similarity.
TINY = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), TINY)


def search(vectors: DataFrame, queries: DataFrame, k: int, normalized: bool = True, source: str = "dense", block: int = QUERY_BLOCK, id_col: str = "chunk_id", other_than: str | None = None) -> DataFrame:
    """``queries(qid, embedding)`` against ``vectors(id, embedding)``: (qid, source, id, raw_score, rank).

    The score is the inner product, or the cosine if the vectors are not normalized.  Always gives
    min(k, rows) rows a query.  ``other_than`` names a column of both sides that must differ.
    """
    spark = vectors.sparkSession
    extra = [other_than] if other_than else []
    id_type = vectors.schema[id_col].dataType.simpleString()
    qid_type = queries.schema["qid"].dataType.simpleString()
    columns = ["qid", "embedding", *extra]
    n = queries.count()
    n_blocks = max(1, -(-n // PASS_QUERIES))
    parts = []
    for b in range(n_blocks):
        own = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b)
        rows = own.select(*columns).toArrow()
        q = matrix(rows.column("embedding"))
        held = spark.sparkContext.broadcast((rows.column("qid").to_pylist(), q if normalized else unit(q), rows.column(extra[0]).to_numpy() if extra else None))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, q, qx = held.value
            for batch in batches:
                if not batch.num_rows or not len(qids):
                    continue
                m = matrix(batch.column(1))
                m = (m if normalized else unit(m)).T
                for lo in range(0, len(qids), block):
                    scores = q[lo : lo + block] @ m
                    if qx is not None:
                        scores[qx[lo : lo + block, None] == batch.column(2).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                    keep = min(k, scores.shape[1])
                    # everything that ties with the k-th score stays, so ties are broken by id later
                    floor = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
                    i, j = np.nonzero((scores >= floor[:, None] - 1e-9) & np.isfinite(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(qids[lo : lo + block]).take(pa.array(i)), batch.column(0).take(pa.array(j)), pa.array(scores[i, j])], names=["qid", id_col, "raw_score"])

        parts.append(vectors.select(id_col, "embedding", *extra).mapInArrow(run, f"qid {qid_type}, {id_col} {id_type}, raw_score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top_k(found, k, ["qid"], tie=id_col).select("qid", F.lit(source).alias("source"), id_col, "raw_score", "rank")


def hashing_embedder(texts: DataFrame, id_col: str, text_col: str = "text", dim: int = 64, prefix: str = "", normalize: bool = True) -> DataFrame:
    """(id, embedding): deterministic signed feature hashing of words.

    Stands where a bi-encoder would; any function of this shape can replace it.
    """
    import zlib

    id_type = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), np.float32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for word in (prefix + (text or "")).lower().split():
                    h = zlib.crc32(word.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            out = unit(out).astype(np.float32) if normalize else out
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, embedding array<float>")


def embed_queries_once(queries: DataFrame, **options) -> DataFrame:
    """Embeds each distinct query text once and gives it to all its rows."""
    distinct = queries.select(F.col("query").alias("text")).distinct()
    return queries.join(hashing_embedder(distinct, "text", "text", **options), queries["query"] == F.col("text"), "left").drop("text")
