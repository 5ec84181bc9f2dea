"""Null ids, one id with several texts, repeated rows, long texts: every row against brute force, row by row."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from lodestar.llm import decontaminate, exact_dedup, jaccard_join, language_id, license_scan, substring_dedup, token_files
from lodestar.llm.common import materialize, scratch_path
from lodestar.llm.queries import tokenizer_path

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(500)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


SHARED = text(60)
LONG = f"{text(90_000)} {SHARED} {text(60_000)}"  # more than one slice of bytes
ROWS = [
    (None, SHARED), (None, f"x {SHARED}"), (7, SHARED), (7, "short one"), (7, f"{text(30)} {SHARED} tail"), (7, "short one"), (2, f"{SHARED} {SHARED}"), (9, f"released under the MIT license {text(5)}"),
    (9, "nothing of that kind"), (None, "released under the MIT license"), (None, None), (3, None), (3, ""), (5, LONG), (6, f"lead {SHARED}"), (6, LONG),
]


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("word", F.lit(1)).repartition(3).persist()


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def counted(pairs):
    return collections.Counter(pairs)


def test_substring_dedup(rows):
    first = {}
    for i, t in ROWS:
        w = words_of(t)
        for p in range(len(w) - 49):
            if i is not None:
                first[tuple(w[p : p + 50])] = min(i, first.get(tuple(w[p : p + 50]), i))
    wanted = []
    for i, t in ROWS:
        w = words_of(t)
        gone = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
        wanted.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substring_dedup.substring_dedup(rows).collect()]
    assert counted(got) == counted(wanted)


@pytest.mark.parametrize("block_chars", [10**7, 200])
def test_decontamination(spark, rows, block_chars):
    items = [(1, " ".join(SHARED.split()[5:30])), (2, "short one"), (3, "mit license"), (4, " ".join(SHARED.split()[20:40])), (5, " ".join(LONG.split()[-40:-10]))]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = t.lower().split()
        size = min(13, len(w))
        for p in range(len(w) - size + 1):
            windows[tuple(w[p : p + size])].add(str(i))
    wanted = []
    for i, t in ROWS:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if own := windows.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= own
        wanted.append((i, len(w), len(hit), tuple(sorted(found))))
    out = decontaminate.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars)
    assert counted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect()) == counted(wanted)


def test_license_scan(rows):
    got = counted((r["doc_id"], r["n_words"], r["labels"]) for r in license_scan.license_scan(rows).collect())
    assert sum(got.values()) == len(ROWS)
    assert {(i, label) for i, _, label in got if label} == {(9, "mit"), (None, "mit")}
    assert sum(n for (i, _, label), n in got.items() if i == 9 and not label) == 1


@pytest.mark.parametrize("limit", [1000, 0])
def test_exact_dedup(rows, limit):
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in ROWS]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    wanted = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        wanted.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(rows, prefix_chars=4, broadcast_limit=limit).collect()
    assert counted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == counted(wanted)


@pytest.mark.parametrize("per_shard", [(1 << 23, 1 << 27), (300, 500)])
def test_token_files(spark, rows, per_shard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    path = scratch_path(spark, "rows-files")
    tokens = materialize(token_files.token_table(rows, tokenizer_path(), 2), "rows-ids")
    token_files.write_token_files(tokens, path, per_shard=per_shard, block_bytes=400)
    got = sorted(token_files.read_token_files(spark, path, digest=True).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))  # nulls first
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda t: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in library.encode(t or "", add_special_tokens=False).ids + [2]))
    assert counted((r["doc_id"], r["ids_crc32"]) for r in got) == counted((i, crc(t)) for i, t in ROWS)


def test_an_id_of_many_rows_fills_several_shards():
    import numpy as np

    bounds = np.array([3, 7, 7, 7, 9])
    shard = token_files.shards_of(np.array([1, 3, 7, 7, 7, 7, 8, 10]), bounds, 0)
    assert shard.tolist()[:2] == [0, 0] and set(shard.tolist()[2:6]) == {1, 2, 3} and shard.tolist()[6:] == [4, 5]


@pytest.mark.parametrize("bits", [27, 12])
def test_jaccard_join(rows, monkeypatch, bits):
    """Rows of one id with different texts are classes of their own; a crowded bit table loses nothing."""
    monkeypatch.setattr(jaccard_join, "MASK_BITS", bits)
    out = jaccard_join.jaccard_join(rows, dense=2).collect()
    sets = []
    for _, t in ROWS:
        w = words_of((t or "").lower())
        sets.append({tuple(w[p : p + 3]) for p in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    link = lambda a, b: bool(a) and 100 * len(a & b) >= 90 * len(a | b)
    root = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if link(sets[i], sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    wanted = []
    for i, (own, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if root[j] == root[i] and ROWS[j][0] is not None]
        wanted.append((own, len(sets[i]), min(ids) if ids and sets[i] else own, sum(link(sets[i], s) for s in sets) - bool(sets[i])))
    assert counted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in out) == counted(wanted)
    assert len({r["component"] for r in out}) == len({root[i] for i in range(len(ROWS)) if sets[i]}) + 1  # null: the empty set


def test_convolution_by_hand():
    """Window probabilities against plain loops over bytes, filters and places."""
    import numpy as np

    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (3, 20))
    net = language_id.train(windows.astype(np.uint8), np.array([0, 1, 0]), ["a", "b"], epochs=1)
    for row, got in zip(windows, net.probabilities(windows)):
        best = []
        for f, b in zip(net.filters, net.biases):
            width = f.shape[0] // net.embed.shape[1]
            for k in range(f.shape[1]):
                at = [sum(float(net.embed[row[p + j]] @ f[j * net.embed.shape[1] : (j + 1) * net.embed.shape[1], k]) for j in range(width)) for p in range(len(row) - width + 1)]
                best.append(max(0.0, max(at) + float(b[k])))
        z = np.array(best) @ net.out + net.out_bias
        assert got == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-4)


def test_language_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    got = collections.Counter(r["lang"] for r in language_id.sample(docs, per_language=20))
    assert got == {"a": 20, "b": 20}
    order = docs.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text")).orderBy("h")
    wanted = {r["text"] for lang in "ab" for r in order.where(F.col("lang") == lang).limit(20).collect()}
    assert {r["parts"][0] for r in language_id.sample(docs, per_language=20)} == wanted
