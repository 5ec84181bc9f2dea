"""Language-model scores from a probabilistic suffix tree, beside a unigram baseline.

**Tokens.**  Words with A-Z lower-cased, then one end token.  A word's identity is its 64-bit hash.

**Model.**  The tree's symbols are bytes: a document's words joined by one space and closed by a
line feed, read after ``DEPTH`` line feeds.  Every run of up to ``DEPTH`` symbols is a context; it
is kept as a state when

* it occurs at least ``MIN_COUNT`` times in training, so states grow with the corpus, and
* the Kullback-Leibler divergence of its next-symbol distribution from that of its longest kept
  suffix is at least ``MIN_DIVERGENCE`` bits.

A state's distribution is smoothed with its parent's (weight ``SMOOTHING``), the root's with the
uniform one.  Each symbol is scored by the longest state that is a suffix of what precedes it;
the score is the log10 probability of the whole text with its end.

**Scale.**  Rows are dealt to blocks of about ``BLOCK_BYTES`` of text by their place in a file, long texts to
blocks of their own size class, so a block is bounded in bytes and rows are read in order.
Words and runs are counted per block, so a block sends each of its words and runs once,
however often it holds them; answers meet the block's texts, packed, in one cogroup.  Answers are bare values: a
block finds its words and runs in its texts again and knows their order, so no key travels back.  Keys are sent in an
order in which those of a bucket are near each other, so they take little more room the more buckets there are.  The tree is grown in two parts.  Contexts of up to ``HEAD`` bytes are bounded by the
alphabet, pass through the driver and are sent to all tasks.  Longer ones are spread over tasks by
their last ``HEAD + 1`` bytes: contexts that end alike are one subtree, whose runs, counted per block,
meet in one group; it grows the subtree and answers each block with the probabilities of the
block's own runs.  No task or driver holds the whole tree.

**Defined cases.**  Null and empty texts are one end token.  A null id counts as the id ''.
Rows are scored each on its own; repeated rows count as often as they occur.  Without training
documents c, N and V are 0 and the tree is the uniform distribution.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Batches, materialize, release_memory
from lodestar.llm.wordhash import MASK64, U64, mix, space_separated, split_words, text_slices

DEPTH = 6
#: Bytes of context up to which states are held by the driver; longer ones stay distributed.
HEAD = 3
MIN_COUNT = 8
MIN_DIVERGENCE = 0.005
SMOOTHING = 2.0
BLOCK_BYTES = 1 << 25
#: Bytes of text that are packed together on their way to their block.
PACK_BYTES = 1 << 22
SUFFIX = U64((1 << (8 * (HEAD + 1))) - 1)
_SPACE = space_separated()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def fold_number(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def spaced_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words joined by one space, in lower case: bytes, bounds of the texts, word counts."""
    inside = _SPACE[data]
    begins = inside.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins[1:] &= ~inside[:-1] | cut[1:-1]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    later = np.ones(len(starts), bool)  # words that follow another one of their text
    later[first[:-1][first[1:] > first[:-1]]] = False
    gap = starts[later] - 1
    out, keep = _LOWER[data], inside
    out[gap], keep[gap] = 0x20, True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], np.diff(first)


def symbols(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context << 8 | symbol of every scored place, bounds of the texts among them, word counts)."""
    body, cut, n_words = spaced_bytes(data, offsets)
    n = len(cut) - 1
    out = np.full(8 + len(body) + n * (depth + 1), 0x0A, np.uint8)
    out[np.arange(len(body)) + np.repeat(8 + np.arange(n) * (depth + 1) + depth, np.diff(cut))] = body
    # the eight bytes that end with a place, as one number
    key = np.ndarray((len(out) - 8,), ">u8", out, 1, (1,)).astype(U64) & U64((1 << (8 * (depth + 1))) - 1)
    scored = np.ones(len(key), bool)
    begin = cut[:-1] + np.arange(n) * (depth + 1)
    for j in range(depth):
        scored[begin + j] = False
    return key[scored], cut + np.arange(n + 1), n_words


def run_counts(packed: DataFrame, depth: int) -> DataFrame:
    """(run, n): training counts of the runs of up to ``depth`` symbols of context, of ``block_runs``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                keys, n = unrotated(np.cumsum(unpack(r["runs"], r["size"], U64), dtype=U64)) & U64((1 << (8 * (depth + 1))) - 1), unpack(r["n"], r["size"], np.int32).astype(np.int64)
                sums = Sums()
                sums.add(keys[n > 0], n[n > 0])
                keys, n = sums.take()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["run", "n"])

    return packed.select("size", "runs", "n").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


class Sums:
    """Counts by key, merged now and then; ``full`` asks to be emptied, which keeps memory bounded."""

    def __init__(self, merge_at: int = 2_000_000, limit: int = 4_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.merge_at, self.limit = 0, merge_at, limit

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.merge_at and len(self.parts) > 1:
            self.parts = [self._merged()]
            self.size = len(self.parts[0][0])
            self.merge_at = max(self.merge_at, 2 * self.size)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.empty(0, U64)
        counts = np.concatenate([n for _, n in self.parts]) if self.parts else np.empty(0, np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        return keys[first], np.add.reduceat(counts, first).astype(np.int64) if len(first) else np.empty(0, np.int64)

    def full(self) -> bool:
        return self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts, self.size = self._merged(), [], 0
        return out


class RunSums:
    """Distinct runs with their counts in training; places are gathered and sorted many at a time."""

    def __init__(self, step: int = 1_500_000):
        self.keys, self.n = np.empty(0, U64), np.empty(0, np.int32)
        self.raw, self.waiting, self.step = [], 0, step

    def add(self, runs: np.ndarray, train: np.ndarray) -> None:
        self.raw.append(runs << U64(1) | train)
        self.waiting += len(runs)
        if self.waiting > self.step:
            self.fold()

    def fold(self) -> None:
        if self.waiting:
            x = np.concatenate(self.raw)
            self.raw, self.waiting = [], 0
            x.sort()
            keys = x >> U64(1)
            new = np.ones(len(x), bool)
            new[1:] = keys[1:] != keys[:-1]
            first = np.flatnonzero(new)
            keys, n = keys[first], np.add.reduceat(x & U64(1), first).astype(np.int32)
            at, there = lookup(self.keys, keys)
            self.n[at[there]] += n[there]
            into = np.searchsorted(self.keys, keys[~there])
            self.n, self.keys = np.insert(self.n, into, n[~there]), np.insert(self.keys, into, keys[~there])

    @property
    def size(self) -> int:
        return len(self.keys) + self.waiting

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        return self.keys, self.n


@dataclass
class Tree:
    """Kept states by depth.  ``root`` has 256 probabilities; each level has its contexts, the
    weight their parent keeps, and the own share of (context, symbol) pairs."""

    root: np.ndarray
    depth: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def probabilities(self, runs: np.ndarray, below: int | None = None) -> np.ndarray:
        """P(symbol | context) of packed runs, by states of fewer than ``below`` symbols."""
        p = self.root[(runs & U64(255)).astype(np.int64)].copy()
        for d, (contexts, parent, pairs, share) in enumerate(self.levels[: None if below is None else below - 1], 1):
            if not len(contexts):
                continue
            pair = runs & U64((1 << (8 * (d + 1))) - 1)
            at, has = lookup(contexts, pair >> U64(8))
            own_at, own = lookup(pairs, pair)
            p = np.where(has, parent[at] * p + np.where(own, share[own_at], 0.0), p)
        return p

    def states(self) -> int:
        return 1 + sum(len(level[0]) for level in self.levels)


def lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def add_level(tree: Tree, pairs: np.ndarray, n: np.ndarray, min_count: int, min_divergence: float, smoothing: float) -> None:
    """Adds the tree's next level from distinct sorted (context, symbol) pairs and their counts.

    All pairs of a context must be among them.
    """
    states, first, back = np.unique(pairs >> U64(8), return_index=True, return_inverse=True)
    all_n = np.bincount(back, weights=n, minlength=len(states))
    often = (all_n >= min_count)[back]
    pairs, n, back = pairs[often], n[often], back[often]
    gain = n / all_n[back] * np.log2(n / all_n[back] / tree.probabilities(pairs))
    kept = (all_n >= min_count) & (np.bincount(back, weights=gain, minlength=len(states)) >= min_divergence)
    of = kept[back]
    tree.levels.append((states[kept], (smoothing / (all_n + smoothing))[kept], pairs[of], (n / (all_n[back] + smoothing))[of]))


def grow(runs: DataFrame, depth: int = HEAD, min_count: int = MIN_COUNT, min_divergence: float = MIN_DIVERGENCE, smoothing: float = SMOOTHING) -> Tree:
    """The tree of ``run_counts`` (materialized: it is read once per depth), up to ``HEAD`` symbols."""
    by_symbol = np.full(256, 0.1)
    for r in runs.groupBy((F.col("run").bitwiseAND(255)).alias("s")).agg(F.sum("n").alias("n")).collect():
        by_symbol[r["s"]] += r["n"]
    tree = Tree(by_symbol / by_symbol.sum(), depth)
    for d in range(1, depth + 1):
        pair = F.col("run").bitwiseAND((1 << (8 * (d + 1))) - 1)
        pairs = runs.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).toPandas().sort_values("pair")
        add_level(tree, pairs["pair"].to_numpy(np.int64).astype(U64), pairs["n"].to_numpy(np.int64), min_count, min_divergence, smoothing)
    return tree


def grown(head: Tree, runs: np.ndarray, n: np.ndarray, depth: int, min_count: int = MIN_COUNT, min_divergence: float = MIN_DIVERGENCE, smoothing: float = SMOOTHING) -> Tree:
    """``head`` with the subtrees of the training runs ``runs``, which are all that end like them."""
    tree = Tree(head.root, depth, list(head.levels))
    for d in range(head.depth + 1, depth + 1):
        pairs, back = np.unique(runs & U64((1 << (8 * (d + 1))) - 1), return_inverse=True)
        add_level(tree, pairs, np.bincount(back, weights=n, minlength=len(pairs)), min_count, min_divergence, smoothing)
    return tree


def pack(values: np.ndarray) -> bytes:
    """Numbers of one width, compressed byte by byte of them."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rotated(runs: np.ndarray) -> np.ndarray:
    """Runs in the order they are packed in: the last ``HEAD + 1`` bytes of context, the symbol, then older bytes, latest first.

    Runs of one bucket and those with like probabilities stand together.
    """
    old = (runs >> U64(40) & U64(255)) << U64(8) | runs >> U64(48)
    return (runs >> U64(8) & SUFFIX) << U64(24) | (runs & U64(255)) << U64(16) | old


def unrotated(keys: np.ndarray) -> np.ndarray:
    return (keys & U64(255)) << U64(48) | (keys >> U64(8) & U64(255)) << U64(40) | (keys >> U64(24)) << U64(8) | keys >> U64(16) & U64(255)


def run_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of rotated runs, the same for all with the same last ``HEAD + 1`` bytes of context."""
    return mix(keys >> U64(24)) % U64(buckets)


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hashes."""
    return (hashes >> U64(32)) * U64(buckets) >> U64(32)


def by_block(blocks: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """Each block of consecutive texts with its places, which lie between ``bounds``."""
    own = np.unique(blocks).tolist()
    if len(own) == 1:
        yield own[0], slice(None)
    elif own:
        of = np.repeat(blocks, np.diff(bounds))
        for block in own:
            yield block, of == block


PACKS = "bucket long, block long, size long, runs binary, n binary"


def packs(block: int, keys: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A block's keys with their counts, a row for each bucket."""
    order = np.lexsort((keys, bucket))
    keys, n, bucket = keys[order], n[order], bucket[order]
    own, first = np.unique(bucket, return_index=True)
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(own, pa.int64()), pa.array(np.full(len(own), block)), pa.array([hi - lo for lo, hi in parts], pa.int64()),
            pa.array([pack(np.diff(keys[lo:hi], prepend=U64(0))) for lo, hi in parts], pa.binary()), pa.array([pack(n[lo:hi].astype(np.int32)) for lo, hi in parts], pa.binary()),
        ],
        names=["bucket", "block", "size", "runs", "n"],
    )


def unpacked(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct keys, summed counts, place of each row's keys among them, row sizes) of ``packs``."""
    sizes = part.column("size").to_pylist()
    keys = np.concatenate([np.cumsum(unpack(r, m, U64), dtype=U64) for r, m in zip(part.column("runs").to_pylist(), sizes)])
    n = np.concatenate([unpack(x, m, np.int32) for x, m in zip(part.column("n").to_pylist(), sizes)])
    u, back = np.unique(keys, return_inverse=True)
    return u, np.bincount(back, weights=n, minlength=len(u)), back, sizes


ANSWERS = "block long, bucket long, size long, value binary"


def answers(part: pa.Table, values: np.ndarray, back: np.ndarray, sizes: list[int], **once: int) -> pa.Table:
    """A row for each block: ``values`` of its distinct keys in their order; ``once`` stands on the first row."""
    blocks, ends = part.column("block").to_numpy(), np.cumsum(sizes)
    places: dict[int, list[np.ndarray]] = {}
    for block, hi, size in zip(blocks.tolist(), ends.tolist(), sizes):
        places.setdefault(block, []).append(back[hi - size : hi])
    own = [x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in places.values()]
    columns = {"block": list(places), "bucket": [part.column("bucket")[0].as_py()] * len(own), "size": [len(x) for x in own]}
    more = {name: [int(x)] + [0] * (len(own) - 1) for name, x in once.items()}
    return pa.table({**{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "value": pa.array([pack(values[x]) for x in own], pa.binary()), **more})


def emptied(held: dict, limit: int) -> Iterator[int]:
    """Blocks to be sent, the largest first, until fewer than ``limit`` keys are held."""
    while len(held) > 256 or sum(x.size for x in held.values()) > limit:
        yield max(held, key=lambda b: held[b].size)


def block_runs(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """``packs`` of the distinct runs of each block of ``docs(block, train, text)``, with training counts.

    A bucket holds all runs whose last ``HEAD + 1`` bytes of context are the same.
    """

    def run(batches: Batches) -> Batches:
        release_memory()
        held: dict[int, RunSums] = {}

        def rows(block: int) -> pa.RecordBatch:
            keys, n = held.pop(block).take()
            keys = rotated(keys)
            return packs(block, keys, n, run_bucket(keys, buckets))

        for batch in batches:
            blocks, train = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(U64)
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                keys, cut, _ = symbols(data, offsets, depth)
                of = np.repeat(train[lo:hi], np.diff(cut))
                for block, own in by_block(blocks[lo:hi], cut):
                    held.setdefault(block, RunSums()).add(keys[own], of[own])
                for block in emptied(held, 5_000_000):
                    yield rows(block)
        for block in list(held):
            yield rows(block)
        release_memory()

    return docs.select("block", "train", "text").mapInArrow(run, PACKS)


def block_words(docs: DataFrame, buckets: int) -> DataFrame:
    """``packs`` of the distinct words of each block of ``docs(block, train, text)``, with training counts."""

    def run(batches: Batches) -> Batches:
        release_memory()
        held: dict[int, Sums] = {}

        def rows(block: int) -> pa.RecordBatch:
            keys, n = held.pop(block).take()
            return packs(block, keys, n, word_bucket(keys, buckets))

        for batch in batches:
            blocks, train = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                words = split_words(data, offsets, _SPACE, lower=True)
                of = np.repeat(train[lo:hi], words.counts())
                for block, own in by_block(blocks[lo:hi], words.first):
                    w, back = np.unique(words.hashes[own], return_inverse=True)
                    held.setdefault(block, Sums(500_000)).add(w, np.bincount(back, weights=of[own], minlength=len(w)).astype(np.int64))
                for block in emptied(held, 2_000_000):
                    yield rows(block)
        for block in list(held):
            yield rows(block)
        release_memory()

    return docs.select("block", "train", "text").mapInArrow(run, PACKS)


def word_counts(packed: DataFrame) -> DataFrame:
    """(block, bucket, size, value, n, v): training counts of the words of ``block_words``, and on the first row
    of each bucket the sum of all counts and the number of words that have one."""

    def count(part: pa.Table) -> pa.Table:
        _, n, back, sizes = unpacked(part)
        out = answers(part, n.astype(np.int64), back, sizes, n=n.sum(), v=(n > 0).sum())
        release_memory()
        return out

    return packed.groupBy("bucket").applyInArrow(count, f"{ANSWERS}, n long, v long")


def run_scores(packed: DataFrame, head: Tree, depth: int) -> DataFrame:
    """(block, bucket, size, value): log10 probabilities of the runs of ``block_runs``."""
    held = packed.sparkSession.sparkContext.broadcast(head)

    def score(part: pa.Table) -> pa.Table:
        u, n, back, sizes = unpacked(part)
        runs = unrotated(u)
        tree = grown(held.value, runs[n > 0], n[n > 0], depth)
        out = answers(part, np.log10(tree.probabilities(runs)).astype(np.float32), back, sizes)
        release_memory()
        return out

    return packed.groupBy("bucket").applyInArrow(score, ANSWERS)


class Table:
    """Values of distinct keys, looked up by hash; keys that lose their slot go to a smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, level: int = 0):
        self.bits, self.salt = max(8, len(keys).bit_length()), U64(0x9E3779B97F4A7C15 * level & MASK64)
        self.keys, self.values = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, values.dtype)
        self.used = np.zeros(1 << self.bits, bool)
        slot = self._slots(keys)
        self.keys[slot], self.values[slot], self.used[slot] = keys, values, True
        lost = self.keys[slot] != keys
        self.rest = Table(keys[lost], values[lost], level + 1) if lost.any() else None

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ self.salt) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, 0 for keys that are not there."""
        slot = self._slots(keys)
        out = self.values[slot]
        miss = np.flatnonzero((self.keys[slot] != keys) | ~self.used[slot])
        if len(miss):
            out[miss] = self.rest.get(keys[miss]) if self.rest else 0
        return out


def packed_texts(rows: DataFrame) -> DataFrame:
    """(block, body): rows of ``rows(block, doc_id, train, text)``, many of a block packed together."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, *_ in text_slices(batch.column(3), PACK_BYTES):
                for block in np.unique(blocks[lo:hi]).tolist():
                    own = batch.select([1, 2, 3]).take(pa.array(lo + np.flatnonzero(blocks[lo:hi] == block)))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(own)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])
        release_memory()

    return rows.select("block", "doc_id", "train", "text").mapInArrow(run, "block long, body binary")


def unpacked_texts(part: pa.Table) -> Iterator[pa.Table]:
    for body in part.column("body"):
        yield pa.ipc.open_stream(body.as_buffer()).read_all()


def aligned(rows: pa.Table, keys: np.ndarray, bucket: np.ndarray, kind: type) -> np.ndarray:
    """The values in a block's ``answers``, in the order of ``keys``, which are all of the block's."""
    order = np.lexsort((keys, bucket))
    found = sorted(zip(*(rows.column(c).to_pylist() for c in ("bucket", "size", "value"))))
    own, sizes = np.unique(bucket, return_counts=True)
    if [x[:2] for x in found] != list(zip(own.tolist(), sizes.tolist())):
        raise RuntimeError("a block's texts have changed since they were counted")
    out = np.empty(len(keys), kind)
    out[order] = np.concatenate([np.empty(0, kind)] + [unpack(value, size, kind) for _, size, value in found])
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def blocks_of(rows: int, size: int, text: Column, file: Column, nth: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """Block of a row by its place in a file: as many neighbours as have about ``block_bytes``.

    ``rows`` and ``size`` (bytes of text) are those of the whole table.  Texts of more than 16 times the
    mean length are dealt by size class, the fewer to a block the longer they are, so a block has less than
    16 times ``block_bytes`` wherever lengths are uneven.
    """
    mean = max(1.0, size / max(1, rows))
    per = max(1, int(block_bytes / mean))
    level = F.greatest(F.lit(0), F.floor(F.log2(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(mean)) / 4)).cast("int")
    level = F.coalesce(level, F.lit(0))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(per) / F.pow(F.lit(16.0), level)).cast("long"))
    return F.xxhash64(file, level, F.floor(nth / step))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, place: tuple[str, str] | None = None, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all documents; those whose fold is 0 are held out of training.

    ``place`` names the columns that hold a row's file and its number there, by which rows are dealt
    to blocks, so that a task has few of them.  The default is a hash of id and text.
    """
    train = fold_number(id_col, folds) != 0
    text = F.col(text_col)
    s = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("bytes"), F.count(F.when(train, 1)).alias("train")).first()
    if place:
        block = blocks_of(s["rows"], s["bytes"], text, F.col(place[0]), F.col(place[1]), block_bytes)
    else:
        block = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(max(1, -(-s["bytes"] // block_bytes))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), train.alias("train"), block.alias("block"))
    ends, buckets = s["train"], max(16, -(-s["bytes"] // (block_bytes // 2)))
    words = materialize(word_counts(block_words(rows, buckets)), "word-counts", "uncompressed", drop_shuffles=True)
    s = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_train, v_train = s["n"] + ends, s["v"] + (ends > 0)
    packed = materialize(block_runs(rows, depth, buckets), "block-runs", "uncompressed", drop_shuffles=True)
    head = grow(materialize(run_counts(packed, min(HEAD, depth)), "symbol-runs", drop_shuffles=True), min(HEAD, depth))
    kinds = [x.withColumn("words", F.lit(w)).select("block", "words", "bucket", "size", "value") for x, w in ((words, True), (run_scores(packed, head, depth), False))]
    known_by_block = kinds[0].unionByName(kinds[1])

    def tables(part: pa.Table, known: pa.Table) -> tuple[Table, Table]:
        """Log10 probabilities of the block's runs and counts of its words."""
        runs, words = RunSums(), Sums(500_000)
        for texts in unpacked_texts(part):
            for _, _, data, offsets in text_slices(texts.column("text")):
                key = symbols(data, offsets, depth)[0]
                runs.add(key, np.zeros(len(key), U64))
                own = np.unique(split_words(data, offsets, _SPACE, lower=True).hashes)
                words.add(own, np.zeros(len(own), np.int64))
        keys, hashes = runs.take()[0], words.take()[0]
        turned, of_words = rotated(keys), known.column("words")
        values = aligned(known.filter(pc.invert(of_words)), turned, run_bucket(turned, buckets), np.float32)
        return Table(keys, values), Table(hashes, aligned(known.filter(of_words), hashes, word_bucket(hashes, buckets), np.int64))

    def score(part: pa.Table, known: pa.Table) -> pa.Table:
        runs, counts = tables(part, known)
        out = [scored(texts, runs, counts) for texts in unpacked_texts(part)]
        del runs, counts
        release_memory()
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=empty)

    def scored(part: pa.Table, runs: Table, counts: Table) -> pa.Table:
        out = []
        floor = np.log10(n_train + 0.1 * (v_train + 1))
        for lo, hi, data, offsets in text_slices(part.column("text")):
            tokens = split_words(data, offsets, _SPACE, lower=True)
            n = counts.get(tokens.hashes)
            term = np.concatenate([[0.0], np.cumsum(np.log10(n + 0.1) - floor)])
            found = np.concatenate([[0], np.cumsum(n > 0)])
            base = term[tokens.first[1:]] - term[tokens.first[:-1]] + np.log10(ends + 0.1) - floor
            key, cut, _ = symbols(data, offsets, depth)
            value = np.add.reduceat(runs.get(key).astype(np.float64), cut[:-1])
            out.append((tokens.counts() + 1, found[tokens.first[1:]] - found[tokens.first[:-1]] + (ends > 0), base, value))
        cat = lambda i: np.concatenate([x[i] for x in out])
        return pa.table(
            {
                "doc_id": part.column("doc_id"), "held_out": pa.array(~part.column("train").to_numpy()), "n_tokens": cat(0), "n_known": cat(1),
                "train_tokens": np.full(part.num_rows, n_train), "base_score": cat(2), "score": cat(3),
            }
        )

    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return packed_texts(rows).groupBy("block").cogroup(known_by_block.groupBy("block")).applyInArrow(score, SCORES)
