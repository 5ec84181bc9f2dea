"""Substring deduplication: word windows that also start in a document with a smaller id.

Every window of ``width`` consecutive words has a Rabin-Karp hash (two independent 64-bit ones,
so 128 bits decide), and the hashes are counted in Spark.  A word covered by a window whose
word sequence also starts in a document with a smaller id is removed; windows are judged on the
input.  Repeated windows merge into maximal removal intervals.

**Which windows are shuffled.**  Hashes of all windows would be three times the input.  Equal
windows have equal *anchors*, the smallest hash among the ``ANCHOR_WORDS``-word spans inside, and
neighbouring windows mostly share theirs.  So anchors are counted first (about one row per
twenty words), and only windows whose anchor occurs in several documents are counted by their
own hashes.  A window left out has an anchor, and so a word sequence, that no other document
has: nothing is lost, at any size.

**Scale.**  Counting is a min/max with map-side combining, so a window that a third of all
documents hold costs a row per task.  Results go back to rows by (id, hash of
the text), in joins that adaptive execution can split; a row's list is as long as its text at most.  Texts are
shuffled only for documents that have a shared anchor; their ids select them by a broadcast of
bounded size, or by an ordinary join above that bound.

**Defined cases.**  Null and empty texts have no words, texts shorter than a window keep all.
Rows with the same id are one document as far as "a smaller id" goes, and each loses its own words: what
they share among themselves stays.  A row with a null id keeps its words and removes none elsewhere.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Batches, ids_if_small, materialize
from lodestar.llm.token_files import binary_rows
from lodestar.llm.wordhash import Words, joined, sliding_min, space_separated, span_hashes, split_words, text_slices, window_starts

WIDTH = 50
ANCHOR_WORDS = 12
_SPACE = space_separated()
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary"


def _anchors(words: Words, width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window in one text: start, text, anchor."""
    starts, text = window_starts(words.first, width)
    if not len(starts):
        return starts, text, np.empty(0, np.uint64)
    return starts, text, sliding_min(span_hashes(words.hashes, span, 0), width - span + 1)[starts]


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Indexes of the first of each distinct tuple."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    return order[new]


def anchor_table(docs: DataFrame, width: int = WIDTH, span: int = ANCHOR_WORDS) -> DataFrame:
    """(anchor, doc_id, key) of ``docs(doc_id, text, key)``, once per row and anchor."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for lo, _, data, offsets in text_slices(batch.column(1)):
                words = split_words(data, offsets, _SPACE, lower=False)
                _, text, anchor = _anchors(words, width, span)
                run_start = np.ones(len(anchor), bool)
                run_start[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                text, anchor = text[run_start], anchor[run_start]
                pick = _distinct(anchor, text)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[pick].view(np.int64)), pa.array(ids[lo + text[pick]]), pa.array(keys[lo + text[pick]])], names=["anchor", "doc_id", "key"])

    return docs.mapInArrow(run, "anchor long, doc_id long, key long")


def window_table(docs: DataFrame, width: int = WIDTH, span: int = ANCHOR_WORDS) -> DataFrame:
    """(h1, h2, doc_id, key, pos) of windows whose anchor is among the ``anchors`` of ``docs(doc_id, text, anchors, key)``.

    Once per row and window; pos is the first start.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            wanted = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = split_words(data, offsets, _SPACE, lower=False)
                starts, text, anchor = _anchors(words, width, span)
                # one sorted list of (text, anchor) serves the slice: the text's number is folded into the hash
                fold = lambda a, t: a ^ (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                mine = wanted[bounds[lo] : bounds[hi]]
                listed = np.sort(fold(mine, np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))))
                folded = fold(anchor, text)
                if not len(listed) or not len(folded):
                    continue
                at = np.minimum(np.searchsorted(listed, folded), len(listed) - 1)
                hit = listed[at] == folded
                starts, text = starts[hit], text[hit]
                h1, h2 = span_hashes(words.hashes, width, 0)[starts], span_hashes(words.hashes, width, 1)[starts]
                pick = _distinct(h2, h1, text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1[pick].view(np.int64)), pa.array(h2[pick].view(np.int64)), pa.array(ids[lo + text[pick]]), pa.array(keys[lo + text[pick]]),
                        pa.array((starts[pick] - words.first[text[pick]]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "key", "pos"],
                )

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, key long, pos int")


def apply_removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text, removed)``, where removed lists window starts (null: none)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lengths = batch.column(2).fill_null([]).value_lengths().to_numpy(zero_copy_only=False) if batch.num_rows else np.empty(0, np.int64)
            removed, bounds = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                words = split_words(data, offsets, _SPACE, lower=False)
                n = len(words.starts)
                text = np.repeat(np.arange(hi - lo), lengths[lo:hi])
                at = words.first[text] + removed[bounds[lo] : bounds[hi]]
                keep = np.ones(n, bool)
                if len(at):
                    starts, of = window_starts(words.first, width)
                    hashes = span_hashes(words.hashes, width, 0)
                    fold = lambda h, t: h ^ (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    gone = np.sort(fold(hashes[at], text))
                    mine = fold(hashes[starts], of)
                    hit = starts[gone[np.minimum(np.searchsorted(gone, mine), len(gone) - 1)] == mine]
                    edge = np.zeros(n + 1, np.int64)
                    edge[hit] += 1
                    edge[hit + width] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                gone = ~keep
                opens, closes = gone.copy(), gone.copy()
                if n:
                    heads = words.first[:-1][np.diff(words.first) > 0]
                    cut = np.zeros(n, bool)
                    cut[heads] = True
                    opens[1:] &= keep[:-1] | cut[1:]
                    closes[:-1] &= keep[1:] | cut[1:]
                begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                owner = np.searchsorted(words.first, begin, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array((begin - words.first[owner]).astype(np.int32)), pa.array((end - words.first[owner]).astype(np.int32))], names=["begin", "end"])
                span_at = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                out, cut_at = joined(words, keep)
                lost = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts().astype(np.int64)), pa.array(lost[words.first[1:]] - lost[words.first[:-1]]), pa.ListArray.from_arrays(span_at, spans), binary_rows(out, cut_at)],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept"],
                )

    return docs.mapInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, span: int = ANCHOR_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed word ranges), kept (UTF-8)."""
    span, row = min(span, width), ["doc_id", "key"]
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("key"))
    known = every.where("doc_id IS NOT NULL")
    anchors = materialize(anchor_table(known, width, span), "anchors")
    twice = F.min("doc_id") < F.max("doc_id")
    shared = materialize(anchors.groupBy("anchor").agg(twice.alias("t")).where("t").select("anchor"), "shared-anchors")
    lists = materialize(anchors.join(shared, "anchor").groupBy(*row).agg(F.collect_set("anchor").alias("anchors")), "anchor-lists")
    some = known.join(ids_if_small(lists.select(*row)), row, "left_semi").join(lists, row).select("doc_id", "text", "anchors", "key")
    windows = window_table(some, width, span)
    firsts = materialize(
        windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), twice.alias("t")).where("t").select("h1", "h2", "first_id"), "shared-windows"
    )
    removed = materialize(windows.join(firsts, ["h1", "h2"]).where("first_id < doc_id").groupBy(*row).agg(F.collect_set("pos").alias("removed")), "removed")
    ids = ids_if_small(removed.select(*row))
    whole = every.join(ids, row, "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("removed"))
    cut = every.join(ids, row, "left_semi").join(removed, row).select("doc_id", "text", "removed")
    return apply_removals(whole, width).unionByName(apply_removals(cut, width))
