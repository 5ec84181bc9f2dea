"""Token ids in Huffman-coded block files.

**Format.**  A folder holds two Parquet tables.

* ``codebook``: ``token_id``, ``length``.  The code is canonical: codes are given out by
  (length, token_id), most significant bit first; no code is longer than ``MAX_BITS`` (or the
  fewest bits that can tell the ids apart).
* ``blocks``: one row per independent block, in ascending (``shard``, ``block``) order, with
  ``doc_ids``, ``n_tokens`` and ``sizes`` (bytes) of its documents, ``payload`` (the documents'
  bit strings, each starting on a byte) and ``marks``: for every ``MARK_EVERY`` ids of a
  document the bits they take, as little-endian uint16.  Summed up, these are bit-offset
  checkpoints from which all runs of a block are decoded at once.

Documents are in ascending id order across shards and blocks.

**Scale.**  Ids are encoded once and kept as a table in the shared folder; the counts that go to
the driver are one row per vocabulary entry.  Only coded documents (about 9 bits an id) are
shuffled, by ranges of ids with about equal numbers of tokens; their bounds come from a sample of at most
``SAMPLE_ROWS`` rows, which decides nothing but balance.  An id that fills several ranges is spread over
them.  Each task packs and decodes one block at a time.  Each shard's ids are a sum on the driver:
one number per shard.

**Defined cases.**  Null text counts as empty and still gets its end id.  Null document ids come
first and stay null.  Rows with equal ids are all written, next to each other, in no stated order among
themselves.  An empty table writes an empty codebook and no blocks.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Batches, materialize, release_memory
from lodestar.llm.encode import encoder
from lodestar.llm.wordhash import text_slices

MAX_BITS = 16
MARK_EVERY = 128
BLOCK_BYTES = 1 << 20
#: Tokens of a shard: fewer while there are fewer shards than cores to read them.
TOKENS_PER_SHARD = (1 << 23, 1 << 27)
SAMPLE_ROWS = 1_000_000
_NULL_ID = np.iinfo(np.int64).min
#: Ids coded by one vectorised step.
STEP_IDS = 200_000

IDS_SCHEMA = "doc_id long, n_tokens int, ids binary"
CODED_SCHEMA = "shard int, doc_id long, n_tokens int, marks binary, payload binary"
BLOCK_SCHEMA = "shard int, block int, doc_ids array<bigint>, n_tokens array<int>, sizes array<int>, marks binary, payload binary"


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes cut from one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian uint32 bytes, with the end id."""

    def run(batches: Batches) -> Batches:
        release_memory()
        enc = encoder(tokenizer_path)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, count = enc.encode(data, offsets, end_id)
                cut = np.concatenate([[0], np.cumsum(count)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(count.astype(np.int32)), binary_rows(ids.view(np.uint8), cut)],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, IDS_SCHEMA)


def flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column as one array, and the bounds of its rows in values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def row_ranges(bounds: np.ndarray, limit: int = STEP_IDS) -> Iterator[tuple[int, int]]:
    """Consecutive rows with about ``limit`` values, at least one row each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1))
        yield lo, hi
        lo = hi


def id_counts(tokens: DataFrame) -> DataFrame:
    """(token_id, n) over all documents; each task sends one row per distinct id."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids, _ = flat(batch.column(0), "<u4")
            for lo in range(0, len(ids), STEP_IDS):
                n = np.bincount(ids[lo : lo + STEP_IDS])
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token_id", "n"])

    return tokens.select("ids").mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, int(n - 1).bit_length())
    order = np.lexsort((np.arange(n), counts))
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        by = np.argsort(merged, kind="stable")
        level = merged[by]
        is_leaf.append(by < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for mask in reversed(is_leaf):
        own = int(mask[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical code: ids in ascending order, their lengths and codes."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.ids, self.lengths))
        self.bits = int(self.lengths.max(initial=1))
        step = np.left_shift(np.int64(1), self.bits - self.lengths[order])
        codes = np.empty(len(order), np.int64)
        codes[order] = (np.cumsum(step) - step) >> (self.bits - self.lengths[order])
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.length_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = codes, self.lengths
        self.table_id = np.zeros(1 << self.bits, np.uint32)
        self.table_length = np.ones(1 << self.bits, np.uint8)
        used = int(step.sum())
        self.table_id[:used] = np.repeat(self.ids[order], step)
        self.table_length[:used] = np.repeat(self.lengths[order], step)

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and byte bounds of documents, and their marks with bounds (in marks)."""
        length = self.length_of[ids]
        done = np.concatenate([[0], np.cumsum(length)])
        doc_bits = done[bounds[1:]] - done[bounds[:-1]]
        byte_at = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])
        per_doc = np.diff(bounds)
        at = done[:-1] + np.repeat(byte_at[:-1] * 8 - done[bounds[:-1]], per_doc)
        width = (self.bits + 7 + 7) // 8
        value = self.code_of[ids] << (8 * width - (at & 7) - length)
        first = at >> 3
        out = np.zeros(int(byte_at[-1]) + width, np.float64)
        for j in range(width):
            out += np.bincount(first + j, weights=(value >> (8 * (width - 1 - j))) & 255, minlength=len(out))
        runs = (per_doc + MARK_EVERY - 1) // MARK_EVERY
        mark_at = np.concatenate([[0], np.cumsum(runs)])
        nth = np.arange(mark_at[-1]) - np.repeat(mark_at[:-1], runs)
        begin = np.repeat(bounds[:-1], runs) + nth * MARK_EVERY
        end = np.minimum(begin + MARK_EVERY, np.repeat(bounds[1:], runs))
        return out[: byte_at[-1]].astype(np.uint8), byte_at, (done[end] - done[begin]).astype("<u2"), mark_at

    def decode(self, payload: np.ndarray, n_tokens: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Ids of a block; all runs between checkpoints advance together."""
        n_tokens = n_tokens.astype(np.int64)
        runs = (n_tokens + MARK_EVERY - 1) // MARK_EVERY
        first_run = np.cumsum(runs) - runs
        taken = np.cumsum(marks.astype(np.int64)) - marks
        base = (np.cumsum(sizes.astype(np.int64)) - sizes) * 8
        lane_doc = np.repeat(np.arange(len(runs)), runs)
        pos = base[lane_doc] + taken - taken[first_run[lane_doc]] if len(lane_doc) else np.empty(0, np.int64)
        nth = np.arange(len(lane_doc)) - first_run[lane_doc]
        left = np.minimum(n_tokens[lane_doc] - nth * MARK_EVERY, MARK_EVERY)
        to = np.cumsum(left) - left
        by = np.argsort(-left, kind="stable")
        pos, left, to = pos[by], left[by], to[by]
        b = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.int64)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        out = np.empty(int(n_tokens.sum()), np.uint32)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
        for step, n in enumerate(alive.tolist()):
            p = pos[:n]
            peek = (window[p >> 3] >> (shift - (p & 7))) & mask
            out[to[:n] + step] = self.table_id[peek]
            pos[:n] += self.table_length[peek]
        return out


def build_code(tokens: DataFrame) -> Code:
    rows = id_counts(tokens).toPandas()
    ids = rows["token_id"].to_numpy(np.int64)
    order = np.argsort(ids)
    return Code(ids[order], code_lengths(rows["n"].to_numpy(np.int64)[order]))


def shard_bounds(tokens: DataFrame, per_shard: tuple[int, int] = TOKENS_PER_SHARD) -> np.ndarray:
    """Upper ids of all shards but the last, weighted by tokens; an id that fills several shards is repeated."""
    size = tokens.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0)).alias("tokens")).first()
    least, most = (-(-size["tokens"] // x) for x in reversed(per_shard))
    n = max(1, least, min(most, 2 * tokens.sparkSession.sparkContext.defaultParallelism))
    if n == 1:
        return np.empty(0, np.int64)
    share = min(1.0, min(256 * n, SAMPLE_ROWS) / size["rows"])
    rows = tokens.select(F.coalesce("doc_id", F.lit(int(_NULL_ID))).alias("id"), "n_tokens")
    drawn = (rows if share == 1 else rows.sample(share, seed=11)).toPandas().sort_values("id")
    done = drawn["n_tokens"].to_numpy(np.int64).cumsum()
    if not len(done):
        return np.empty(0, np.int64)
    return drawn["id"].to_numpy(np.int64)[np.searchsorted(done, done[-1] * np.arange(1, n) / n)]


def shards_of(ids: np.ndarray, bounds: np.ndarray, at: int) -> np.ndarray:
    """Shard of each id; rows of an id that fills several shards take turns (``at``: rows before these)."""
    first, end = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    return (first + (at + np.arange(len(ids))) % np.maximum(end - first, 1)).astype(np.int32)


def write_token_files(tokens: DataFrame, path: str, per_shard: tuple[int, int] = TOKENS_PER_SHARD, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes a ``token_table`` that was materialized (it is read twice) in the block format."""
    spark = tokens.sparkSession
    code = build_code(tokens)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(code.ids, code.lengths)], "token_id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    bounds = shard_bounds(tokens, per_shard)
    held = spark.sparkContext.broadcast((code.ids, code.lengths))

    def coded(batches: Batches) -> Batches:
        encoder.cache_clear()  # a reused worker may still hold units
        release_memory()
        own, done = Code(*held.value), 0
        for batch in batches:
            all_ids, bound = flat(batch.column(2), "<u4")
            shard = shards_of(batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False), bounds, done)
            done += batch.num_rows
            for lo, hi in row_ranges(bound):
                data, at, marks, mark_at = own.encode(all_ids[bound[lo] : bound[hi]], bound[lo : hi + 1] - bound[lo])
                doc_ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[lo:hi]), doc_ids, batch.column(1).slice(lo, hi - lo), binary_rows(marks.view(np.uint8), mark_at * 2), binary_rows(data, at)],
                    names=["shard", "doc_id", "n_tokens", "marks", "payload"],
                )

    def packed(batches: Batches) -> Batches:
        number, parts, size = 0, [], 0

        def block() -> pa.RecordBatch:
            shard, doc_ids, n, marks, payload = (c.combine_chunks() for c in pa.Table.from_batches(parts).columns)
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            joined = lambda x: pa.array([flat(x, "u1")[0].tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [shard[:1], pa.array([number], pa.int32()), lists(doc_ids), lists(n), lists(pc.binary_length(payload).cast(pa.int32())), joined(marks), joined(payload)],
                names=["shard", "block", "doc_ids", "n_tokens", "sizes", "marks", "payload"],
            )

        for batch in batches:
            done = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False), dtype=np.int64)])
            lo = 0
            while lo < batch.num_rows:  # a block ends with the row that fills it
                hi = min(batch.num_rows, int(np.searchsorted(done, done[lo] + block_bytes - size, side="left")))
                hi = max(hi, lo + 1)
                parts.append(batch.slice(lo, hi - lo))
                size += int(done[hi] - done[lo])
                lo = hi
                if size >= block_bytes:
                    yield block()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield block()

    rows = tokens.mapInArrow(coded, CODED_SCHEMA)
    placed = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens")
    placed.mapInArrow(packed, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.parquet(f"{path}/codebook").orderBy("token_id").toPandas()
    return Code(rows["token_id"].to_numpy(np.int64), rows["length"].to_numpy(np.int64))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): what the files hold; start counts the ids before a document.

    With ``digest``, ids_crc32 stands for ids: the unsigned CRC-32 of a document's ids as
    little-endian uint32.
    """
    code = read_code(spark, path)
    held = spark.sparkContext.broadcast((code.ids, code.lengths))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    by_shard = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    before, start_of = 0, {}
    for shard in sorted(by_shard):
        start_of[shard], before = before, before + by_shard[shard]
    first = spark.createDataFrame([(s, n) for s, n in start_of.items()], "shard int, shard_start long")
    in_shard = sizes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("b"))
    starts = in_shard.join(first, "shard").selectExpr(
        "shard", "posexplode(transform(b, (x, i) -> struct(x.block AS block, shard_start + aggregate(slice(b, 1, i), 0L, (a, y) -> a + y.n) AS start))) AS (i, s)"
    ).select("shard", F.col("s.block").alias("block"), F.col("s.start").alias("block_start"))

    last = "ids_crc32" if digest else "ids"

    def run(batches: Batches) -> Batches:
        encoder.cache_clear()
        release_memory()
        own = Code(*held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                n = row["n_tokens"].values.to_numpy().astype(np.int64)
                ids = own.decode(
                    np.frombuffer(row["payload"].as_py(), np.uint8), n, row["sizes"].values.to_numpy(), np.frombuffer(row["marks"].as_py(), "<u2")
                )
                cut = np.concatenate([[0], np.cumsum(n)])
                raw = ids.astype("<u4").view(np.uint8)
                if digest:
                    value = pa.array([zlib.crc32(raw[a:b]) for a, b in zip((cut[:-1] * 4).tolist(), (cut[1:] * 4).tolist())], pa.int64())
                else:
                    value = binary_rows(raw, cut * 4)
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(cut[:-1] + row["block_start"].as_py()), pa.array(n), value], names=["doc_id", "start", "n_tokens", last])

    return blocks.join(starts, ["shard", "block"]).mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")


def roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, digest: bool = False) -> DataFrame:
    """Encodes, writes, reads back."""
    tokens = materialize(token_table(docs, tokenizer_path, end_id), "token-ids")
    write_token_files(tokens, path)
    return read_token_files(docs.sparkSession, path, digest)
