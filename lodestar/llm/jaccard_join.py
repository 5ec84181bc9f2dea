"""Exact n-gram Jaccard self-join of documents, with set-relation skipping.

A document's set is its distinct word shingles; two documents link when their sets' Jaccard
similarity reaches ``PERCENT`` / 100.

**Equal sets** are one class; only classes take part, and copies follow their class.

**Prefix index.**  Shingles have one global order, rare before frequent: by how often tasks met them, where a
task reports what it met twice or more.  The order decides only speed.  Two sets that link share one of
their first ``n - ceil(0.9 n) + 1`` shingles.  These places, with set size and position, are the index lists.

**Index-level skipping.**  Entries of a list are grouped in blocks of equal size and position.  For
two blocks the size and position bounds say at once whether any of their entries can link; a
block without a partner block is skipped whole.

**Short lists** (up to ``DENSE`` entries) give candidate pairs, which are made distinct, thinned by
parity bitmaps (lossless) and verified against whole sets.

**Dense lists** give no pairs.  Their surviving sets meet in cells, a cell for each
pair of chunks of neighbouring size classes, where bitmaps must leave them a partner, and are
verified there.  *Answer-level skipping*: a
cell holds, for each set, its overlaps with all others; those of a set are derived from the
overlaps of a highly similar set computed before, by going through the symmetric difference
only.  A pair counts where the list is that of its first common shingle, so links are counted
once; the cell returns link counts and the edges of a spanning forest.

**Scale.**  Only index entries of shingles that two classes share, and sets with a partner, are
shuffled; which sets these are is told to tasks by a bit table of at most ``2 ** MASK_BITS`` bits, whatever their
number, and a set that passes it by chance meets no partner later.  A cell holds at most ``2 * CHUNK``
sets of each of two size classes and about ``CELL_ITEMS`` shingles a chunk.  A dense list of ``m`` distinct sets
takes ``m * m / CHUNK`` entries of cells: for near copies of each other that is less than their links, which a
link count cannot avoid; copies of equal sets cost nothing here.  Components are found by ``components``.

**Defined cases.**  Null and empty texts have the empty set, link with nothing and are their own
component.  Texts with fewer words than a shingle have one shingle, the whole word sequence.
Every row gives one row, and repeated rows are copies.  Rows are found by their sets, never by their ids: rows
with one id and different texts belong to different classes.  A row with a null id gets the smallest
id of its component, or null where no row of it has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import KEY, Batches, materialize, release_memory, text_key
from lodestar.llm.components import components
from lodestar.llm.suffix_tree import Sums
from lodestar.llm.token_files import binary_rows
from lodestar.llm.wordhash import U64, mix, range_hashes, space_separated, span_hashes, split_words, text_slices, window_starts

WORDS = 3
PERCENT = 90
DENSE = 48
CHUNK = 512
#: Shingles of one chunk's sets; chunks of long sets hold fewer sets.
CELL_ITEMS = 4_000_000
#: Digests a task remembers so as not to list equal sets twice.
SEEN = 1 << 20
#: Size of the largest table that tells tasks which sets are wanted.
MASK_BITS = 27
#: Shingles whose frequency takes part in the order; the rest count as rare.
FREQUENT = 1 << 18
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 32
_SPACE = space_separated()


class Sets:
    """Distinct shingles of a slice of texts, sorted by text, level of frequency, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, order: tuple[np.ndarray, np.ndarray] | None = None):
        words = split_words(data, offsets, _SPACE, lower=True)
        at, text = window_starts(words.first, width)
        shingle = span_hashes(words.hashes, width)[at] if len(at) else np.empty(0, U64)
        n_words = words.counts()
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            shingle = np.concatenate([shingle, range_hashes(words.hashes, words.first[short], words.first[short + 1])])
            text = np.concatenate([text, short])
        level = np.zeros(len(shingle), np.int64)
        if order is not None and len(order[0]):
            near = np.minimum(np.searchsorted(order[0], shingle), len(order[0]) - 1)
            level = np.where(order[0][near] == shingle, order[1][near], 0)
        by = np.lexsort((shingle, level, text))
        shingle, text = shingle[by], text[by]
        new = np.ones(len(by), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
        self.shingle, self.text = shingle[new], text[new]
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        self.size = np.diff(self.first)
        total = lambda salt: self._sums(mix(self.shingle ^ U64(salt)))
        self.d1 = mix(total(0x51ED270B7A13) + self.size.astype(U64)).view(np.int64)
        self.d2 = mix(total(0x2545F4914F6CDD1D) ^ self.size.astype(U64)).view(np.int64)

    def bitmaps(self) -> pa.Array:
        """Parity bitmaps: each shingle flips one bit of its set's bitmap.

        Two sets differ in at least as many shingles as their bitmaps do in bits.
        """
        width = 64 * BITMAP_WORDS
        out = np.zeros((len(self.size), BITMAP_WORDS), U64)
        bit = (self.shingle & U64(width - 1)).astype(np.int64)
        for lo in range(0, len(self.size), 256):  # bounds the counters
            hi = min(lo + 256, len(self.size))
            own = slice(self.first[lo], self.first[hi])
            flips = np.bincount((self.text[own] - lo) * width + bit[own], minlength=(hi - lo) * width) & 1
            out[lo:hi] = np.packbits(flips.astype(np.uint8)).view(U64).reshape(hi - lo, BITMAP_WORDS)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.view(np.int64).ravel()), BITMAP_WORDS).cast(pa.list_(pa.int64()))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        done = np.zeros(len(values) + 1, U64)
        np.cumsum(values, out=done[1:])
        return done[self.first[1:]] - done[self.first[:-1]]


def shapes(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, key of the text, n, d1, d2, bits): size, 128-bit digest and parity bitmap of each document's set."""

    def run(batches: Batches) -> Batches:
        release_memory()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                s = Sets(data, offsets, width)
                own = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s.size.astype(np.int32)), pa.array(s.d1), pa.array(s.d2), s.bitmaps()], names=["doc_id", *KEY, "n", "d1", "d2", "bits"])

    return docs.mapInArrow(run, f"doc_id long, {KEY[0]} long, {KEY[1]} long, n int, d1 long, d2 long, bits array<long>")


class Seen:
    """Which digests are met for the first time; forgets all when ``SEEN`` are held, as later steps make rows distinct."""

    def __init__(self):
        self.held: set = set()

    def fresh(self, digests: list) -> np.ndarray:
        if len(self.held) + len(digests) > SEEN:
            self.held.clear()
        return np.array([d not in self.held and not self.held.add(d) for d in digests], bool)


def global_order(docs: DataFrame, width: int = WORDS, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, levels) of the most frequent shingles, at most ``limit`` of them, sorted by hash.

    Tasks report shingles that they saw in two documents or more.
    """

    def run(batches: Batches) -> Batches:
        release_memory()
        sums = Sums(1_000_000, 2_000_000)

        def rows() -> pa.RecordBatch:
            k, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(k[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                sums.add(*np.unique(Sets(data, offsets, width).shingle, return_counts=True))
                if sums.full():
                    yield rows()
        yield rows()

    counts = materialize(docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    floor, have = 1 << 30, 0
    for own, n in sizes:
        if have + n > limit:
            break
        floor, have = own, have + n
    rows = counts.where(level >= floor).select("shingle", level.alias("l")).toPandas()
    hashes, levels = rows["shingle"].to_numpy(np.int64).view(U64), rows["l"].to_numpy(np.int64) + 1
    order = np.argsort(hashes)
    return hashes[order], levels[order]


def prefix_rows(docs: DataFrame, held, width: int, percent: int) -> DataFrame:
    """(shingle, d1, n, pos) of the prefix places; a task lists equal sets once."""

    def run(batches: Batches) -> Batches:
        release_memory()
        seen = Seen()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                s = Sets(data, offsets, width, held.value)
                fresh = seen.fresh(s.d1.tolist())
                prefix = np.where(fresh & (s.size > 0), s.size - -(-percent * s.size // 100) + 1, 0)
                pos = np.arange(len(s.text)) - s.first[:-1][s.text]
                keep = pos < prefix[s.text]
                t = s.text[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.shingle[keep].view(np.int64)), pa.array(s.d1[t]), pa.array(s.size[t].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["shingle", "d1", "n", "pos"]
                )

    return docs.select("text").mapInArrow(run, "shingle long, d1 long, n int, pos int")


def block_partners(n: np.ndarray, pos: np.ndarray, side: np.ndarray, meets, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of equal (size, position, side): block of each entry, and the matrix of block pairs
    whose bounds allow a link.  ``meets(side, side)`` says which sides are compared."""
    key = (side.astype(np.int64) << 56) | (n.astype(np.int64) << 28) | pos
    blocks, first, of = np.unique(key, return_index=True, return_inverse=True)
    bn, bp, bs = n[first].astype(np.int64), pos[first].astype(np.int64), side[first]
    big, small = np.maximum(bn[:, None], bn[None]), np.minimum(bn[:, None], bn[None])
    most = 1 + np.minimum((bn - bp)[:, None], (bn - bp)[None]) - 1
    ok = (100 * small >= percent * big) & ((100 + percent) * most >= percent * (bn[:, None] + bn[None])) & meets(bs[:, None], bs[None])
    alone = np.bincount(of) < 2
    ok[np.arange(len(blocks)), np.arange(len(blocks))] &= ~alone
    return of, ok, blocks


def whole_groups(batches: Batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by ``keys``, with the bounds of the groups."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        bounds = cut(table)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        held = table.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def short_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x, y, pos_x) of ``entries(shingle, d1, n, pos)``, x < y, once each."""

    def run(batches: Batches) -> Batches:
        for table, bounds in whole_groups(batches, ["shingle"]):
            d1, n, pos = (table.column(c).to_numpy() for c in ("d1", "n", "pos"))
            xs, ys, ps = [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo == 2:  # most lists: the bounds on two entries
                    a, b = (lo, lo + 1) if d1[lo] < d1[lo + 1] else (lo + 1, lo)
                    na, nb = int(n[a]), int(n[b])
                    if 100 * min(na, nb) >= percent * max(na, nb) and (100 + percent) * min(na - pos[a], nb - pos[b]) >= percent * (na + nb):
                        xs.append(d1[a : a + 1]), ys.append(d1[b : b + 1]), ps.append(pos[a : a + 1])
                elif hi - lo > 2:
                    of, ok, _ = block_partners(n[lo:hi], pos[lo:hi], np.zeros(hi - lo, np.int8), lambda a, b: True, percent)
                    if not ok.any():
                        continue
                    own = d1[lo:hi]
                    i, j = np.nonzero(ok[of][:, of] & (own[:, None] < own[None]))
                    xs.append(own[i]), ys.append(own[j]), ps.append(pos[lo:hi][i])
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (xs, ys, ps)], names=["x", "y", "pos_x"])

    lists = entries.repartition("shingle").sortWithinPartitions("shingle")
    return lists.mapInArrow(run, "x long, y long, pos_x int").groupBy("x", "y").agg(F.min("pos_x").alias("pos_x"))


def class_bitmaps(shape: DataFrame) -> DataFrame:
    """(d1, bits, n), one row a digest; bits is null where a digest stands for several sets."""
    one = F.when(F.min("d2") == F.max("d2"), F.first("bits")).alias("bits")
    return shape.where("n > 0").groupBy("d1").agg(one, F.max("n").alias("n"))


def bitmap_filter(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs that their bitmaps do not rule out.

    Sets that differ in k shingles share (n_x + n_y - k) / 2, and bitmaps that differ in b bits prove
    k >= b.  A bitmap is 256 bytes where a long set is many kilobytes.  Digests that stand for several sets
    (a collision of 64 bits) are passed on unfiltered.
    """
    ids = pairs.select(F.col("x").alias("d1")).union(pairs.select("y")).distinct()
    bits = materialize(bitmaps.join(ids, "d1", "left_semi"), "bitmaps")
    side = lambda k: bits.select(F.col("d1").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
    apart = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    total = F.col("n_x") + F.col("n_y")
    may_link = (100 + percent) * (total - apart) >= 2 * percent * total
    return pairs.join(side("x"), "x").join(side("y"), "y").where(F.coalesce(may_link, F.lit(True))).select("x", "y", "pos_x")


CELL = ["shingle", "g", "a", "b"]


def dense_cells(entries: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Members (shingle, g, a, b, side, d1) of cells in which a link is possible.

    ``entries`` also has ``many``, the length of the list, and ``bits``.  A set of size class g is at home in
    (shingle, g) and a visitor in (shingle, g + 1): sets that link are at most one class apart.
    side is 2 * (visitor) + (1 for the cell's second chunk).
    """
    step = float(-np.log((percent - 0.1) / 100))
    longest = F.exp((F.col("g") + 1) * F.lit(step))  # sets of a cell are no longer than this
    room = F.greatest(F.lit(2.0), F.least(F.lit(float(chunk)), F.lit(float(CELL_ITEMS)) / longest))
    placed = (
        entries.withColumn("visitor", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("g", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int") + F.col("visitor"))
        .withColumn("chunks", F.ceil(F.col("many") / room).cast("int"))
        .withColumn("h", F.pmod(F.xxhash64("d1"), F.col("chunks")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "shingle", "g", F.least("h", "k").alias("a"), F.greatest("h", "k").alias("b"),
            (F.col("visitor") * 2 + F.when(F.col("h") > F.col("k"), 1).otherwise(0)).cast("int").alias("side"), "d1", "n", "pos", "bits",
        )
    )

    def run(batches: Batches) -> Batches:
        for table, bounds in whole_groups(batches, CELL):
            a, b, side, n, pos = (table.column(c).to_numpy() for c in ("a", "b", "side", "n", "pos"))
            keep = np.zeros(table.num_rows, bool)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > 1:
                    of, ok, _ = block_partners(n[lo:hi], pos[lo:hi], side[lo:hi], cell_meets(a[lo] == b[lo]), percent)
                    left = lo + np.flatnonzero(ok.any(axis=1)[of])  # blocks without a partner are gone
                    if len(left):
                        keep[left] = bitmap_partners(table.column("bits").take(pa.array(left)), n[left], ok, of[left - lo], percent)
            yield from table.filter(pa.array(keep)).select([*CELL, "side", "d1"]).combine_chunks().to_batches()

    return placed.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "shingle long, g int, a int, b int, side int, d1 long")


def bitmap_partners(bits: pa.ChunkedArray, n: np.ndarray, ok: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Which entries have another one that neither the blocks' bounds nor the bitmaps rule out."""
    bits = bits.combine_chunks()
    known = bits.is_valid().to_numpy(zero_copy_only=False)
    words = np.zeros((len(n), BITMAP_WORDS), U64)
    words[known] = bits.drop_null().flatten().to_numpy(zero_copy_only=False).view(U64).reshape(-1, BITMAP_WORDS)
    out, n = np.zeros(len(n), bool), n.astype(np.int64)
    for lo in range(0, len(n), 128):
        part = slice(lo, lo + 128)
        apart = np.zeros((len(n[part]), len(n)), np.int64)
        for w in range(BITMAP_WORDS):
            apart += np.bitwise_count(words[part, None, w] ^ words[None, :, w])
        total = n[part, None] + n[None]
        likely = ((100 + percent) * (total - apart) >= 2 * percent * total) | ~known[part, None] | ~known[None]
        likely &= ok[block[part]][:, block]
        likely[np.arange(len(likely)), lo + np.arange(len(likely))] = False
        out[part] = likely.any(axis=1)
    return out


def cell_meets(one_chunk: bool):
    """Two visitors never meet; with two chunks, only sets of different ones do."""
    return lambda s, t: ((s < 2) | (t < 2)) & (True if one_chunk else (s & 1) != (t & 1))


def digest_mask(digests: DataFrame) -> np.ndarray:
    """Bit table of the leading bits of ``digests(d1)``, at most ``2 ** MASK_BITS`` bits whatever their number."""
    bits = min(MASK_BITS, max(12, int(32 * digests.count()).bit_length()))
    place = F.shiftrightunsigned("d1", 64 - bits)
    rows = digests.select(F.shiftright(place, 6).alias("w"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("b"))
    words = rows.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits")).toPandas()
    mask = np.zeros(1 << (bits - 6), np.int64)
    mask[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return mask.view(U64)


def in_mask(mask: np.ndarray, d1: np.ndarray) -> np.ndarray:
    place = d1.view(U64) >> U64(64 - (len(mask).bit_length() - 1 + 6))
    return (mask[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1)).astype(bool)


def set_rows(docs: DataFrame, held, wanted, width: int) -> DataFrame:
    """(d1, d2, body): shingles in global order of the sets that pass the bit table ``wanted``."""

    def run(batches: Batches) -> Batches:
        release_memory()
        seen = Seen()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                s = Sets(data, offsets, width, held.value)
                pick = np.flatnonzero((s.size > 0) & in_mask(wanted.value, s.d1))
                pick = pick[seen.fresh(list(zip(s.d1[pick].tolist(), s.d2[pick].tolist())))]
                chosen = np.zeros(len(s.size), bool)
                chosen[pick] = True
                cut = np.concatenate([[0], np.cumsum(s.size[pick])]) * 8
                yield pa.RecordBatch.from_arrays([pa.array(s.d1[pick]), pa.array(s.d2[pick]), binary_rows(s.shingle[chosen[s.text]].view(np.uint8), cut)], names=["d1", "d2", "body"])

    return docs.select("text").mapInArrow(run, "d1 long, d2 long, body binary").dropDuplicates(["d1", "d2"])


def links(size_x: int, size_y: int, overlap, percent: int):
    return 100 * overlap >= percent * (size_x + size_y - overlap)


def verify_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with both sets to (u, v, copies_u, copies_v, own): links, and whether they count here."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep, own = [], []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[k][i].as_buffer(), U64) for k in ("body_x", "body_y"))
                shared = np.isin(x, y, assume_unique=True)
                o = int(shared.sum())
                if o and links(len(x), len(y), o, percent):
                    keep.append(i)
                    own.append(int(np.argmax(shared)) == c["pos_x"][i].as_py())
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c[n].take(take) for n in ("u", "v", "copies_u", "copies_v")), pa.array(own, pa.bool_())], names=["u", "v", "copies_u", "copies_v", "own"])

    return pairs.mapInArrow(run, "u binary, v binary, copies_u long, copies_v long, own boolean")


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, overlaps of set i with all) of every set, most of them derived.

    The next set is always the one most similar to the last; its overlaps are the last's, less
    those of the shingles it lacks, plus those of the shingles it has besides.
    """
    if not sets:
        return
    words, back = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(back, kind="stable")
    lists, bounds = owner[by], np.searchsorted(back[by], np.arange(len(words) + 1))
    own = np.split(back, np.cumsum(size)[:-1])

    def through(ids: np.ndarray) -> np.ndarray:
        n = bounds[ids + 1] - bounds[ids]
        at = np.repeat(bounds[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(lists[at], minlength=len(sets))

    left = np.ones(len(sets), bool)
    i, row = 0, through(own[0])
    while True:
        yield i, row
        left[i] = False
        if not left.any():
            return
        shared = np.where(left, row / np.maximum(size[i] + size - row, 1), -1.0)
        j = int(shared.argmax())
        if shared[j] > 0.5:
            row = row - through(np.setdiff1d(own[i], own[j], assume_unique=True)) + through(np.setdiff1d(own[j], own[i], assume_unique=True))
        else:
            row = through(own[j])
        i = j


def verify_cell(table: pa.Table, percent: int) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """Spanning forest of a cell's links, and for each set the copies it links to in this list."""
    shingle = np.uint64(np.int64(table.column("shingle")[0].as_py()).view(U64))
    sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("body").combine_chunks()]
    key = table.column("key").to_pylist()
    copies, side = (table.column(c).to_numpy() for c in ("copies", "side"))
    size = np.array([len(s) for s in sets])
    head = [s[: int(np.flatnonzero(s == shingle)[0])] for s in sets]  # what comes before this shingle
    earlier = dict(overlaps(head)) if any(len(h) for h in head) else None
    meets = cell_meets(table.column("a")[0].as_py() == table.column("b")[0].as_py())
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges, counts = [], {}
    for i, row in overlaps(sets):
        linked = (100 * row >= percent * (size[i] + size - row)) & meets(side[i], side)
        linked[i] = False
        for j in np.flatnonzero(linked).tolist():
            if root(i) != root(j):
                parent[root(i)] = root(j)
                edges.append((key[i], key[j]))
        counted = linked if earlier is None else linked & (earlier[i] == 0)
        counts[key[i]] = counts.get(key[i], 0) + int(copies[counted].sum())
    return edges, counts


def verify_cells(members: DataFrame, percent: int) -> DataFrame:
    """(u, v, n): forest edges (n null) and link counts (v null)."""

    def run(table: pa.Table) -> pa.Table:
        edges, counts = verify_cell(table, percent)
        return pa.table(
            {
                "u": pa.array([e[0] for e in edges] + list(counts), pa.binary()),
                "v": pa.array([e[1] for e in edges] + [None] * len(counts), pa.binary()),
                "n": pa.array([None] * len(edges) + list(counts.values()), pa.int64()),
            }
        )

    return members.groupBy(*CELL).applyInArrow(run, "u binary, v binary, n long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, dense: int = DENSE, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links, class_id, component, key of the text.

    n_links counts the documents it links with, copies included.  ``component`` tells components apart where ids
    cannot; it is null for the empty set.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_key(text))
    shape = materialize(shapes(rows, width), "shapes")
    both = F.concat(*[F.lpad(F.hex(d), 16, "0") for d in ("d1", "d2")])
    classes = materialize(
        shape.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).withColumn("key", F.unhex(both)), "classes"
    )
    bitmaps = materialize(class_bitmaps(shape), "class-bitmaps")
    held = spark.sparkContext.broadcast(global_order(rows, width))
    index = materialize(prefix_rows(rows, held, width, percent), "prefixes")
    shared = materialize(index.groupBy("shingle").agg((F.min("d1") < F.max("d1")).alias("t"), F.count("*").alias("many")).where("t").select("shingle", "many"), "shared-shingles")
    entries = materialize(index.join(shared, "shingle").distinct(), "entries")
    pairs = materialize(short_pairs(entries.where(F.col("many") <= dense), percent), "pairs")
    pairs = materialize(bitmap_filter(pairs, bitmaps, percent), "likely-pairs")
    crowded = entries.where(F.col("many") > dense).join(bitmaps.select("d1", "bits"), "d1")
    cells = materialize(dense_cells(crowded, percent, chunk), "cells")
    needed = materialize(pairs.select(F.col("x").alias("d1")).union(pairs.select("y")).union(cells.select("d1")).distinct(), "needed-sets")
    wanted = spark.sparkContext.broadcast(digest_mask(needed))
    known = classes.select("d1", "d2", "key", "copies")
    sets = materialize(set_rows(rows, held, wanted, width).join(known, ["d1", "d2"]), "sets")
    side = lambda d, u, s: sets.select(F.col("d1").alias(d), F.col("key").alias(u), F.col("copies").alias(f"copies_{u}"), F.col("body").alias(f"body_{s}"))
    short = materialize(verify_pairs(pairs.join(side("x", "u", "x"), "x").join(side("y", "v", "y"), "y"), percent), "short-links")
    deep = materialize(verify_cells(cells.join(sets.select("d1", "key", "copies", "body"), "d1"), percent), "dense-links")
    found = components(short.select("u", "v").union(deep.where("v IS NOT NULL").select("u", "v")))
    own = short.where("own")
    counts = (
        own.select(F.col("u").alias("key"), F.col("copies_v").alias("n")).union(own.select("v", "copies_u")).union(deep.where("v IS NULL").select("u", "n"))
        .groupBy("key").agg(F.sum("n").alias("links"))
    )
    members = found.withColumnRenamed("v", "key").unionByName(found.select(F.col("root").alias("key"), "root").distinct())
    members = materialize(members.join(classes.select("key", "rep"), "key"), "members")
    first = members.groupBy("root").agg(F.min("rep").alias("first_id"))
    answer = materialize(
        classes.join(members.join(first, "root").select("key", "root", "first_id"), "key", "left").join(counts, "key", "left")
        .select("d1", "d2", "n", "rep", F.coalesce("root", "key").alias("component"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("first_id")).alias("first_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links")),
        "answers",
    )
    return shape.drop("bits").join(answer, ["d1", "d2", "n"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), "component", *KEY,
    )
