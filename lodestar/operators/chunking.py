"""Documents to chunks.

Packing is a fold with state (overlap, oversized sentences, runts), so it runs in Python over
Arrow batches, one document at a time; everything around it is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Chunking
from lodestar.functions import text as T

Counter = Callable[[str], int]
_BREAK = re.compile(r"(?<=[.!?])\s+")
_CONTINUES = re.compile(r"(?:^|\s)(?:" + "|".join(map(re.escape, T.ABBREVIATIONS)) + r"|[A-Z]\.|\(?\d+[.)])$")


def chars4(text: str) -> int:
    return max(1, len(text) // 4)


def words(text: str) -> int:
    return len(text.split())


COUNTERS: dict[str, Counter] = {"chars4": chars4, "words": words}


def sentence_list(text: str) -> list[str]:
    """``functions.text.sentences`` for use inside a Python fold."""
    out: list[str] = []
    open_ended = False
    for part in filter(None, (p.strip() for p in _BREAK.split(text.strip()))):
        if open_ended:
            out[-1] += " " + part
        else:
            out.append(part)
        open_ended = bool(_CONTINUES.search(part))
    return out


@dataclass
class _Window:
    """The window being filled: (piece, size) pairs."""

    pieces: list[tuple[str, int]]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.pieces)

    def text(self) -> str:
        return " ".join(p for p, _ in self.pieces)

    def tail(self, budget: int) -> _Window:
        """The longest run of last pieces within the budget that leaves out the first piece."""
        start, room = len(self.pieces), budget
        while start > 1 and self.pieces[start - 1][1] <= room:
            start -= 1
            room -= self.pieces[start][1]
        return _Window(self.pieces[start:])


def pack(sentences: Iterable[str], count: Counter, target: int, overlap: int) -> Iterator[str]:
    """Windows of up to ``target`` tokens; each starts with the end of the one before.

    The carried end is at most ``overlap`` and half the target, and is not checked again when the next
    sentence joins it, so a window can exceed the target by up to half.  A sentence above the
    target is cut by words into windows of its own.
    """
    room = max(0, min(overlap, target // 2))
    window = _Window([])
    for sentence in sentences:
        n = count(sentence)
        if n > target:
            if window.pieces:
                yield window.text()
            yield from pack_words(sentence, count, target)
            window = _Window([])
            continue
        if window.pieces and window.size + n > target:
            yield window.text()
            window = window.tail(room)
        window.pieces.append((sentence, n))
    if window.pieces:
        yield window.text()


def pack_words(sentence: str, count: Counter, target: int) -> Iterator[str]:
    window = _Window([])
    for word in sentence.split():
        n = count(word)
        if window.pieces and window.size + n > target:
            yield window.text()
            window = _Window([])
        window.pieces.append((word, n))
    if window.pieces:
        yield window.text()


def by_structure(sections: list[dict], cfg: Chunking, count: Counter) -> Iterator[tuple[str, str | None]]:
    """(text, label): small neighbouring sections share a chunk, large ones are packed alone."""
    group: list[tuple[str, str, int]] = []

    def merged() -> Iterator[tuple[str, str | None]]:
        if group:
            yield "\n\n".join(b for b, _, _ in group), " / ".join(h for _, h, _ in group if h) or None
            group.clear()

    for section in sections:
        body = (section["text"] or "").strip()
        if not body:
            continue
        n = count(body)
        if n > cfg.target_tokens or sum(s for _, _, s in group) + n > cfg.target_tokens:
            yield from merged()
        if n > cfg.target_tokens:
            yield from ((w, section["heading"]) for w in pack(sentence_list(body), count, cfg.target_tokens, cfg.overlap_tokens))
        else:
            group.append((body, section["heading"] or "", n))
    yield from merged()


def by_size(sections: list[dict], cfg: Chunking, count: Counter) -> Iterator[tuple[str, str | None]]:
    """(text, None): headings are part of the text and boundaries are ignored."""
    body = "\n\n".join(f"{s['heading']}\n{s['text']}" if s["heading"] else s["text"] or "" for s in sections)
    return ((w, None) for w in pack(sentence_list(body), count, cfg.target_tokens, cfg.overlap_tokens))


def chunk_sections(sections: list[dict], cfg: Chunking, count: Counter) -> list[tuple[str, str | None]]:
    """Chunks of one document; pieces under ``min_tokens`` join the piece before them."""
    out: list[tuple[str, str | None]] = []
    for body, label in (by_structure if cfg.strategy == "structure" else by_size)(sections, cfg, count):
        if out and count(body) < cfg.min_tokens:
            before, own = out.pop()
            body, label = f"{before}\n\n{body}", own or label
        out.append((body, label))
    return [] if len(out) == 1 and count(out[0][0]) < cfg.min_tokens else out


def chunk_documents(docs: DataFrame, cfg: Chunking | None = None, counter: str = "chars4") -> DataFrame:
    """``docs(doc_id, sections, ...)`` to (chunk_id, doc_id, ordinal, text, token_count, section).

    Further columns of ``docs`` (title, url, date, meta, ...) are carried to every chunk.
    """
    cfg = cfg or Chunking()
    count = COUNTERS[counter]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [
                [{"ordinal": i, "text": t, "section": s, "token_count": count(t)} for i, (t, s) in enumerate(chunk_sections(sections or [], cfg, count))]
                for sections in batch.column(0).to_pylist()
            ]
            kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string()), ("section", pa.string()), ("token_count", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pieces, kind)], names=["row", "pieces"])

    rest = [c for c in docs.columns if c != "sections"]
    packed = docs.select("sections", F.struct(*rest).alias("row"))
    row_type = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"row {row_type}, pieces array<struct<ordinal:int,text:string,section:string,token_count:int>>")
    one = out.select("row.*", F.inline("pieces"))
    return one.select(T.chunk_id(F.col("doc_id").cast("string"), F.col("ordinal"), F.col("text")).alias("chunk_id"), *one.columns)


def chunk_statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, mean / min / max tokens, documents without a chunk."""
    dropped = docs.join(chunks, "doc_id", "left_anti").agg(F.count("*").alias("n_dropped"))
    sizes = chunks.agg(F.count("*").alias("n_chunks"), F.avg("token_count").alias("mean_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))
    return docs.agg(F.count("*").alias("n_documents")).join(sizes).join(dropped)
