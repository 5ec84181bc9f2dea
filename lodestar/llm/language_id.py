"""Language identification with a byte convolutional network.

**Network.**  A text is cut into windows of ``WINDOW`` bytes (the last one padded with spaces).  Bytes
are looked up in a small embedding; filters of several widths slide over the window; each filter
keeps its largest response (max pooling); a linear layer with softmax gives language
probabilities.  A document's probabilities are the means of its windows', so the whole text
takes part.  Everything is numpy; windows are processed in batches of fixed size.

**Training.**  Adam on windows of labelled documents.  This is the one part that uses a bounded
sample: at most ``DOCS_PER_LANGUAGE`` documents of each language, those with the smallest hash of
id and text, and ``WINDOWS_PER_DOC`` windows spread evenly over each text.  Languages are weighted
equally.  All randomness is seeded.

**Scale.**  Prediction is one scan with no shuffle; the network (some tens of kilobytes) is
broadcast.  Languages are counted first, and hashes beyond a bound that leaves about ``4 *
DOCS_PER_LANGUAGE`` documents of a language never leave their task; of the rest the smallest are
taken exactly.

**Defined cases.**  Null texts and texts without a letter are ``und`` with score 0.  If no labelled
document can be learned from, every document is ``und``.  Rows with a null id are never held out
of training by chance: a null id counts as the id ''.  Repeated rows get equal results.  Extra
columns stay in ``predict`` and are ignored in ``identify``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Batches, release_memory
from lodestar.llm.suffix_tree import fold_number
from lodestar.llm.wordhash import text_slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 4
EPOCHS = 12
BATCH = 256
#: Windows run through the network at once.
STEP_WINDOWS = 512
UNDETERMINED = "und"
#: A-Z count as a-z, and control bytes and spaces as one symbol.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[:0x21] = 0x20


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # per width: (width * EMBED) x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray  # (filters) x labels
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max responses of all filters, and where each was reached."""
        x = self.embed[windows]
        best, where = [], []
        for f, b in zip(self.filters, self.biases):
            width = f.shape[0] // x.shape[2]
            span = windows.shape[1] - width + 1
            r = np.zeros((len(windows) * span, f.shape[1]), np.float32)
            for j in range(width):
                r += x[:, j : j + span].reshape(-1, x.shape[2]) @ f[j * x.shape[2] : (j + 1) * x.shape[2]]
            r = r.reshape(len(windows), span, -1)
            at = r.argmax(axis=1)
            best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + b)
            where.append(at)
        return np.maximum(np.concatenate(best, axis=1), 0), where

    def compiled(self) -> list[list[np.ndarray]]:
        """For each width and offset the responses of single bytes: convolution becomes lookups."""
        e = self.embed.shape[1]
        return [[(self.embed @ f[j * e : (j + 1) * e]).astype(np.float32) for j in range(f.shape[0] // e)] for f in self.filters]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax over languages for each window."""
        if not len(windows):
            return np.empty((0, len(self.labels)), np.float32)
        best = [self._strongest(windows, tables) + b for tables, b in zip(self.compiled(), self.biases)]
        z = np.maximum(np.concatenate(best, axis=1), 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @staticmethod
    def _strongest(windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        span = windows.shape[1] - len(tables) + 1
        r = tables[0][windows[:, :span]]
        for j, t in enumerate(tables[1:], 1):
            r += t[windows[:, j : j + span]]
        return r.max(axis=1)


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fits a network to byte windows; languages weigh the same whatever their number of rows."""
    rng = np.random.default_rng(seed)
    n_lab, n_f = len(names), FILTERS * len(WIDTHS)
    net = Network(
        names, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, n_f**-0.5, (n_f, n_lab)).astype(np.float32), np.zeros(n_lab, np.float32),
    )
    params = [net.embed, *net.filters, *net.biases, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(labels) / np.maximum(np.bincount(labels, minlength=n_lab), 1) / n_lab).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            grads = _gradients(net, windows[pick], labels[pick], weight)
            step += 1
            for i, (p, g) in enumerate(zip(params, grads)):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    best, where = net.pooled(x)
    z = best @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    d = p * weight[y][:, None] / len(y)
    g_best = (d @ net.out.T) * (best > 0)
    g_embed, g_filters, g_biases, col = np.zeros_like(net.embed), [], [], 0
    rows = np.arange(len(y))[:, None]
    for f, at in zip(net.filters, where):
        g = g_best[:, col : col + f.shape[1]]
        col += f.shape[1]
        g_f = np.zeros_like(f)
        for j in range(f.shape[0] // EMBED):
            byte = x[rows, at + j]  # batch x filters: the byte under each filter's best place
            part = slice(j * EMBED, (j + 1) * EMBED)
            g_f[part] = np.einsum("bfe,bf->ef", net.embed[byte], g)
            np.add.at(g_embed, byte, g[:, :, None] * f[part].T[None])
        g_filters.append(g_f)
        g_biases.append(g.sum(axis=0))
    return [g_embed, *g_filters, *g_biases, best.T @ d, d.sum(axis=0)]


def has_letter(raw: bytes) -> bool:
    if any(0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in raw[:64]):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows covering all bytes of the texts, and the text of each window."""
    size = np.diff(offsets)
    n = (size + WINDOW - 1) // WINDOW
    text = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = (offsets[:-1][text] + nth * WINDOW)[:, None] + np.arange(WINDOW)[None, :]
    inside = at < offsets[1:][text][:, None]
    padded = np.append(_FOLD[data], np.uint8(0x20))
    return padded[np.where(inside, at, len(data))], text


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, per_doc: int = WINDOWS_PER_DOC) -> list:
    """(lang, windows of text) of the bounded sample of ``docs(doc_id, text, lang)``."""
    step = F.greatest(F.lit(1), F.floor((F.length("text") - WINDOW) / max(1, per_doc - 1))).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.lit(per_doc - 1)), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(WINDOW)))
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(trim(text)) > 0")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy("hash", "id", "parts")
    share, rows = {lang: 4 * per_language / n for lang, n in counts.items()}, []
    while counts:
        # hashes are even over the 64-bit numbers; nulls stand for "all"
        bounds = [x for lang, q in sorted(share.items()) if q < 1 for x in (F.lit(lang), F.lit(int(q * 2**64) - 2**63))]
        bound = F.element_at(F.create_map(*bounds), F.col("lang")) if bounds else F.lit(None).cast("long")
        drawn = (
            usable.withColumn("hash", F.xxhash64(F.col("doc_id").cast("string"), "text"))
            .where(F.col("hash") <= F.coalesce(bound, F.lit(2**63 - 1)))
            .select("lang", "hash", F.col("doc_id").alias("id"), places.alias("parts"))
            .withColumn("nth", F.row_number().over(order))
            .where(F.col("nth") <= per_language)
        )
        found = drawn.where(F.col("lang").isin(list(counts))).select("lang", "parts").collect()
        have = Counter(r["lang"] for r in found)
        rows += [r for r in found if share[r["lang"]] >= 1 or have[r["lang"]] >= per_language]
        counts = {lang: n for lang, n in counts.items() if share[lang] < 1 and have[lang] < per_language}  # a bound was too low by chance
        share = {lang: 4 * q for lang, q in share.items()}
    return rows


def fit(docs: DataFrame, seed: int = 7) -> Network | None:
    """Trains on ``docs(doc_id, text, lang)``; None if there is nothing to learn from."""
    rows = sorted(((r["lang"], r["parts"]) for r in sample(docs)), key=lambda x: (x[0], x[1]))
    if not rows:
        return None
    names = sorted({lang for lang, _ in rows})
    windows, labels = [], []
    for lang, parts in rows:
        for part in dict.fromkeys(parts):
            raw = np.frombuffer(part.encode()[:WINDOW], np.uint8)
            if len(raw) >= 4:
                windows.append(np.concatenate([_FOLD[raw], np.full(WINDOW - len(raw), 0x20, np.uint8)]))
                labels.append(names.index(lang))
    if not labels:
        return None
    return train(np.array(windows), np.array(labels), names, seed)


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the prediction and its score to ``docs``, under the names in ``added``; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        release_memory()
        own = held.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                n = hi - lo
                letters = np.array([has_letter(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], bool)
                if own is None:
                    pred, score = [UNDETERMINED] * n, np.zeros(n)
                else:
                    total = np.zeros((n, len(own.labels)))
                    windows, text = windows_of(data, offsets)
                    for i in range(0, len(windows), STEP_WINDOWS):
                        np.add.at(total, text[i : i + STEP_WINDOWS], own.probabilities(windows[i : i + STEP_WINDOWS]))
                    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
                    best = share.argmax(axis=1)
                    pred = [own.labels[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())]
                    score = np.where(letters, share[np.arange(n), best], 0.0)
                part = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*part, pa.array(pred, pa.string()), pa.array(score)], names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {added[0]} string, {added[1]} double")


def held_out(id_col: str = "doc_id") -> Column:
    return fold_number(id_col, 3) == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the labelled two thirds, predicts all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    net = fit(rows.where("NOT held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")
