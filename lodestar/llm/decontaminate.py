"""Benchmark decontamination: words of documents inside windows of benchmark items.

A window is ``WINDOW`` consecutive words of an item (an item with fewer words is one window).
Finding windows in documents is a set-containment join with threshold 1, done by prefix
filtering:

1. A window is a sequence of shingles of ``SHINGLE`` words.  All documents are read once to count
   how often each benchmark shingle occurs; the order from rare to frequent is global.
2. At threshold 1 the necessary prefix is one token: a document that contains a window contains
   the window's rarest shingle.  Documents are joined with windows on that shingle only.
3. Positional bound: the shingle's offset fixes where the window would begin.  Length bound: that
   many words must exist to the left and right in the same text.
4. What remains is verified word by word over a stretch of the window's own size.

**Scale.**  Documents are never shuffled; both passes are scans.  Benchmark windows are sent to the
executors in blocks of about ``BLOCK_CHARS`` characters; a larger benchmark takes two scans per
block.  Each block gives the spans of the texts that it hits, under a 128-bit key of the text, and
these few rows meet their documents at the end, so any number of blocks gives the same rows.
What returns to the driver is a count per benchmark shingle of the block.

**Words** are compared by 64-bit hashes, a window by all of its words' hashes.

**Defined cases.**  Null texts have no words and are clean.  Items without words, without text or
without id match nothing.  Repeated items count once per item id.  Every input row gives one row,
whatever its id: rows with null or equal ids are judged by their own texts.  Empty tables are fine:
without items, every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import KEY, Batches, materialize, release_memory, text_key
from lodestar.llm.wordhash import MASK64, U64, HashIndex, alphanumeric, span_hashes, split_words, text_slices, window_starts

WINDOW = 13
SHINGLE = 5
#: Characters of items that one scan of the documents carries.
BLOCK_CHARS = 2_000_000
#: A document is contaminated when this share of its words is hit (as 1 / 20).
SHARE = 20
_WORD = alphanumeric()
HIT = "n_words long, spans array<struct<begin:int,end:int>>, items array<string>"


class Windows:
    """Distinct windows of a block of items, grouped by length, with the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], width: int, shingle: int):
        self.shingle = shingle
        self.prefix: dict[int, tuple[HashIndex, np.ndarray, np.ndarray, np.ndarray]] = {}
        #: By window length: the windows' word hashes (one row each), and their items as a list with bounds.
        self.words: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[list[str], np.ndarray]] = {}
        names = np.array([i for i, _ in items], object)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lo, hi, data, offsets in text_slices(pa.array([t for _, t in items], pa.string())):
            words = split_words(data, offsets, _WORD, lower=True)
            n = words.counts()
            for size in np.unique(np.minimum(n[n > 0], width)).tolist():
                at, text = window_starts(words.first, size)
                own = np.minimum(n[text], width) == size
                found.setdefault(size, []).append((words.hashes[at[own][:, None] + np.arange(size)], lo + text[own]))
        for size, parts in sorted(found.items()):
            rows = np.concatenate([w for w, _ in parts])
            _, first, of = np.unique(np.ascontiguousarray(rows).view(f"V{8 * size}").ravel(), return_index=True, return_inverse=True)
            pairs = sorted(set(zip(of.ravel().tolist(), names[np.concatenate([t for _, t in parts])].tolist())))
            self.words[size] = rows[first]
            self.items[size] = ([i for _, i in pairs], np.searchsorted([w for w, _ in pairs], np.arange(len(first) + 1)))

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes by shingle length."""
        out: dict[int, list[np.ndarray]] = {}
        for size, rows in self.words.items():
            k = min(self.shingle, size)
            out.setdefault(k, []).append(row_shingles(rows, k).ravel())
        return {k: np.unique(np.concatenate(parts)) for k, parts in out.items()}

    def set_order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Gives each window its prefix, the rarest shingle; ties go to the smaller hash."""
        self.prefix = {}
        for size, rows in self.words.items():
            k = min(self.shingle, size)
            h = row_shingles(rows, k)
            n = counts[k][1][np.searchsorted(counts[k][0], h)]
            best = np.where(n == n.min(axis=1, keepdims=True), h, U64(MASK64)).argmin(axis=1)
            keys = h[np.arange(len(h)), best]
            order = np.argsort(keys, kind="stable")
            distinct, start = np.unique(keys[order], return_index=True)
            self.prefix[size] = (HashIndex(distinct), np.append(start, len(keys)), order, best[order])

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, start, window, text) of every occurrence in a slice of texts."""
        spans = {k: span_hashes(hashes, k) for k in {min(self.shingle, size) for size in self.prefix}}
        for size, (index, bounds, window, offset) in self.prefix.items():
            at, entry = index.find(spans[min(self.shingle, size)])
            n = bounds[entry + 1] - bounds[entry]
            pick = np.repeat(bounds[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            win, start = window[pick], np.repeat(at, n) - offset[pick]
            text = np.searchsorted(first, np.repeat(at, n), side="right") - 1
            fits = (start >= first[text]) & (start + size <= first[text + 1])
            start, win, text = start[fits], win[fits], text[fits]
            same = np.ones(len(start), bool)
            for j in range(size):
                same &= hashes[start + j] == self.words[size][win, j]
            yield size, start[same], win[same], text[same]


def row_shingles(rows: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of each row."""
    n, size = rows.shape
    at = (np.arange(n) * size)[:, None] + np.arange(size - k + 1)
    return span_hashes(rows.ravel(), k)[at]


def shingle_counts(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(hashes, occurrences in all documents) of each benchmark shingle, by shingle length."""
    held = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Batches) -> Batches:
        release_memory()
        index = {k: HashIndex(h) for k, h in held.value.items()}
        total = {k: np.zeros(len(h), np.int64) for k, h in held.value.items()}
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                words = split_words(data, offsets, _WORD, lower=True)
                for k, own in index.items():
                    at, entry = own.find(span_hashes(words.hashes, k))
                    text = np.searchsorted(words.first, at, side="right") - 1
                    total[k] += np.bincount(entry[at + k <= words.first[text + 1]], minlength=len(total[k]))
        for k, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used])], names=["k", "i", "n"])

    rows = docs.select("text").mapInArrow(run, "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(len(h), np.int64) for k, h in shingles.items()}
    for k, part in rows.groupby("k"):
        out[k][part["i"].to_numpy()] = part["n"].to_numpy()
    return {k: (h, out[k]) for k, h in shingles.items()}


def find_windows(docs: DataFrame, windows: Windows) -> DataFrame:
    """``docs(text, ...)`` to its other columns with n_words, spans (merged ranges of hit words) and items found."""
    held = docs.sparkSession.sparkContext.broadcast(windows)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Batches) -> Batches:
        release_memory()
        own = held.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                words = split_words(data, offsets, _WORD, lower=True)
                n = len(words.starts)
                edge = np.zeros(n + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for size, start, win, text in own.occurrences(words.hashes, words.first):
                    np.add.at(edge, start, 1)
                    np.subtract.at(edge, start + size, 1)
                    names, bounds = own.items[size]
                    for t, w in set(zip(text.tolist(), win.tolist())):
                        items[t].update(names[bounds[w] : bounds[w + 1]])
                hit = np.cumsum(edge[:-1]) > 0
                opens, closes = hit.copy(), hit.copy()
                if n:
                    cut = np.zeros(n, bool)
                    cut[words.first[:-1][np.diff(words.first) > 0]] = True
                    opens[1:] &= ~hit[:-1] | cut[1:]
                    closes[:-1] &= ~hit[1:] | cut[1:]
                begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                owner = np.searchsorted(words.first, begin, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array((begin - words.first[owner]).astype(np.int32)), pa.array((end - words.first[owner]).astype(np.int32))], names=["begin", "end"])
                span_at = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(words.counts().astype(np.int64)), pa.ListArray.from_arrays(span_at, spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*others, "n_words", "spans", "items"],
                )

    return docs.select("text", *others).mapInArrow(run, ", ".join([f"`{c}` long" for c in others] + [HIT]))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", width: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, n_words, spans, items, n_hit, contaminated) of every document, with the key of its text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *text_key(F.col(text_col)))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-chars // block_chars))

    def windows_of(b: int) -> Windows:
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()
        windows = Windows([(r["item"], r["text"]) for r in rows], width, shingle)
        windows.set_order(shingle_counts(docs, windows.shingles()) if windows.words else {})
        return windows

    if n_blocks == 1:
        found = find_windows(docs, windows_of(0))
    else:
        hits = [materialize(find_windows(docs.drop("doc_id"), windows_of(b)).where("size(spans) > 0").drop("n_words").distinct(), "block-hits") for b in range(n_blocks)]
        merged = materialize(
            reduce(DataFrame.unionByName, hits).groupBy(*KEY).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")),
            "hits",
        )
        plain = find_windows(docs, Windows([], width, shingle)).drop("spans", "items")
        none = lambda c: F.coalesce(c, F.array().cast(dict(merged.dtypes)[c])).alias(c)
        found = plain.join(merged, KEY, "left").select("doc_id", *KEY, "n_words", none("spans"), none("items"))
    hit = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.end - greatest(a.to, s.begin)), 'to', greatest(a.to, s.end)), a -> a.n)")
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def items_digest(items) -> F.Column:
    """SHA-256 of the comma-joined sorted ids."""
    return F.sha2(F.array_join(items, ","), 256)
