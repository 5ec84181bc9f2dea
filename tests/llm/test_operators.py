"""Each operator against brute force over a small corpus of awkward texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, exact_dedup, jaccard_join, language_id, license_scan, mixing, substring_dedup, suffix_tree, token_counts, token_files
from lodestar.llm.common import materialize, scratch_path
from lodestar.llm.queries import MARGINS, TARGETS, tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_substring_dedup(documents, corpus):
    width = 50
    first = {}
    for i, text, *_ in sorted(corpus, key=lambda r: r[0]):
        w = spaced(text)
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    got = by_id(substring_dedup.substring_dedup(documents))
    assert len(got) == len({r[0] for r in corpus})
    for i, text, *_ in corpus:
        w = spaced(text)
        gone = {q for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < i for q in range(p, p + width)}
        assert got[i]["n_words"] == len(w) and got[i]["n_removed"] == len(gone)
        assert bytes(got[i]["kept"]).decode() == " ".join(x for q, x in enumerate(w) if q not in gone)
        assert {q for s in got[i]["spans"] for q in range(s["begin"], s["end"])} == gone


def sets_of(corpus):
    out = {}
    for i, text, *_ in corpus:
        w = spaced((text or "").translate(LOWER))
        out[i] = {tuple(w[p : p + 3]) for p in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("dense", "chunk"), [(48, 512), (2, 4), (1, 3)])
def test_jaccard_join(documents, corpus, dense, chunk):
    sets, rows = sets_of(corpus), [r[0] for r in corpus]
    link = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and link(a, b) and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    got = jaccard_join.jaccard_join(documents, dense=dense, chunk=chunk).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), root(i))
        assert r["n_links"] == (sum(link(i, b) for b in rows) - 1 if sets[i] else 0)


def test_decontamination(spark, documents, corpus):
    long_text = corpus[12][1].split()
    items = [(1, " ".join(long_text[100:130])), (2, "one, TWO"), (3, " ".join(corpus[9][1].split()[3:16])), (4, None), (5, "!!"), (6, "nowhere to be found"), (None, "one two"), (3, "été cc")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        if i is not None and w:
            n = min(13, len(w))
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(str(i))
    for block in (16_000_000, 60):
        got = by_id(decontaminate.decontaminate(documents, benchmark, block_chars=block))
        for i, text, *_ in corpus:
            w = alnum(text)
            hit, found = set(), set()
            for size in {len(k) for k in windows}:
                for p in range(len(w) - size + 1):
                    if own := windows.get(tuple(w[p : p + size])):
                        hit |= set(range(p, p + size))
                        found |= own
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_license_scan(documents, corpus):
    got = collections.defaultdict(list)
    for r in license_scan.license_scan(documents).collect():
        got[r["doc_id"]].append(r)
    for i, text, *_ in corpus:
        w = alnum(text)
        places = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        labels, best = set(), 0.0
        for label, body in license_scan.TEMPLATES.items():
            t, size = set(body.split()), math.ceil(len(body.split()) / 0.8 - 1e-9)
            share = max((len(t & set(w[p : p + size])) / len(t) for p in range(len(w))), default=0.0)
            if share >= math.ceil(0.8 * len(t) - 1e-9) / len(t):
                labels.add(label)
                best = max(best, share)
        for r in got[i]:
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert r["first_word"] == min((p for p, _ in places), default=None) and r["last_word"] == max((p for p, _ in places), default=None)
            assert r["base_labels"] == ",".join(sorted({b for _, b in places}))
            assert r["labels"] == ",".join(sorted({b for _, b in places} | labels))
            assert r["score"] == pytest.approx(1.0 if places else best)
    assert sum(map(len, got.values())) == len(corpus)


def test_license_notice_over_line_ends(spark):
    filler = " ".join(f"w{i}" for i in range(37))
    notices = {
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
        "apache-2.0": "Licensed under the Apache\nLicense, Version 2.0",
        "mit": "released\n\nunder\nthe\nMIT\nlicense",
        "": "Redistribution and use in source\n" + filler + "\nand binary forms with or without\n" + filler + "\nmodification are permitted",
    }
    rows = [(f"{label}/{at}", f"{filler}\n" * at + "x " * at + text + "\n" + filler) for label, text in notices.items() for at in (0, 1, 2, 5)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string")))
    assert {i: r["labels"] for i, r in got.items()} == {i: i.split("/")[0] for i, _ in rows}


def test_exact_dedup(documents, corpus):
    norm = {r[0]: re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in corpus}
    groups = collections.defaultdict(list)
    for r in corpus:
        groups[norm[r[0]]].append(r[0])
    got = exact_dedup.exact_dedup(documents, prefix_chars=3).collect()
    assert len(got) == len(corpus)
    for r in got:
        own = groups[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own))
        assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()


def test_language_id(spark):
    sample = {"en": "the quick brown fox and the lazy dog with this that which", "de": "der schnelle braune fuchs und das ist nicht ein hund über", "fr": "le renard brun et les chiens qui sont dans la forêt où"}
    rows = [(i, " ".join(w[(i * 7 + j * 3) % len(w)] for j in range(30)), lang) for i in range(240) for lang, w in [list((k, v.split()) for k, v in sample.items())[i % 3]]]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (903, "é", "fr")]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] in sample
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held) and len(held) > 40
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1.000001 for r in got.values())


def test_token_files_round_trip(spark, documents, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    path = scratch_path(spark, "test-files")
    tokens = materialize(token_files.token_table(documents, tokenizer_path(), 2), "test-ids")
    token_files.write_token_files(tokens, path, per_shard=(500, 900), block_bytes=300)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in corpus)
    start, texts = 0, {r[0]: r[1] or "" for r in corpus}
    for r in got:
        wanted = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in wanted)
        assert (r["start"], r["n_tokens"]) == (start, len(wanted))
        start += len(wanted)
    for r in token_files.read_token_files(spark, path, digest=True).collect():
        wanted = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in wanted))


@pytest.mark.parametrize("ranged", [True, False])
def test_token_counts(spark, documents, corpus, ranged):
    """Every row, in every file: start and length against the library, whatever the ids."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    library, end = Tokenizer.from_file(tokenizer_path()), 49407
    library.encode_special_tokens = True
    odd = [(None, "no id"), (2**53 + 1, None), (None, "a <|endoftext|> in text"), (7, "again"), (7, "again")]
    docs = documents.select("doc_id", "text", F.lit("x").alias("file"), F.lit(0).alias("ordinal")).unionByName(spark.createDataFrame([(i, t, "x", 0) for i, t in odd], "doc_id long, text string, file string, ordinal int"))
    got = token_counts.count_tokens(docs, scratch_path(spark, "test-flat"), tokenizer_path(), end, 2, block_ids=37, ranged=ranged).collect()
    length = lambda t: len(library.encode(t or "", add_special_tokens=False).ids) + 1
    wanted = collections.Counter((i, length(t)) for i, t, *_ in [*corpus, *odd])
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == wanted
    files = collections.defaultdict(list)
    for r in got:
        files[r["file"]].append((r["ordinal"], r["start"], r["n_tokens"]))
    for rows in files.values():
        at = 0
        for n, (ordinal, start, size) in enumerate(sorted(rows)):
            assert (ordinal, start) == (n, at)
            at += size


def test_end_id_that_texts_have_is_refused(spark, documents):
    with pytest.raises(Exception, match="end id"):
        token_counts.write_flat(documents.select("doc_id", "text"), scratch_path(spark, "test-flat"), tokenizer_path(), 320, 2)


def test_token_counts_raw_files(spark, tmp_path):
    import numpy as np

    np.array([5, 6, 0, 0, 7, 8, 9, 1, 2, 0, 4, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    for ranged in (True, False):
        blocks = token_counts.summaries(spark, f"file://{tmp_path}", 0, 2, block_ids=4, ranged=ranged)
        got = sorted((r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in token_counts.scan(blocks).collect())
        assert got == [(0, 0, 3, True), (1, 3, 1, True), (2, 4, 6, True), (3, 10, 2, False)]


def test_mixing(documents, corpus):
    rows = mixing.mix(documents, ["source", "lang", "topic"], {"source": None, "lang": {"en": 0.5, "de": 0.3, "fr": 0.1, "(null)": 0.1}, "topic": {}}, keep=0.4).collect()
    assert len(rows) == len(corpus) and all(r["n_tokens"] >= 1 and 0 <= r["prob"] <= 1 for r in rows)
    draw = lambda i: int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:8], 16) / 2**32
    assert all(r["sampled"] == (draw(r["doc_id"]) < r["prob"]) for r in rows)
    cells = {}
    for r in rows:
        c = cells.setdefault((r["source"], r["lang"], r["topic"]), [0, r["prob"]])
        c[0] += r["n_tokens"]
    total = sum(t for t, _ in cells.values())
    kept = collections.Counter()
    for (_, lang, _), (t, p) in cells.items():
        kept[lang] += p * t / total
    assert kept["en"] == pytest.approx(0.4 * min(0.5, sum(t for k, (t, _) in cells.items() if k[1] == "en") / total / 0.4), abs=0.02)


def test_raking_reports_and_moves_what_supply_lacks(spark):
    """Cell (a, x) cannot give what it should; the other cells of its values make up for it."""
    from pyspark.sql import functions as F

    cells = spark.createDataFrame([("a", "x", 5), ("a", "y", 45), ("b", "x", 30), ("b", "y", 20)], "source string, lang string, tokens long")
    fitted = mixing.rake(cells, ["source", "lang"], {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}}, sweeps=30, keep=0.5)
    assert fitted.where(F.col("fitted") > F.col("share") / 0.5 + 1e-9).count() == 0
    for r in mixing.margin_report(fitted, ["source", "lang"], 0.5).collect():
        assert r["expected"] == pytest.approx(r["target"], abs=0.01)
    short = mixing.rake(cells, ["lang"], {"lang": {"x": 0.9, "y": 0.1}}, keep=0.5)
    report = {r["value"]: r for r in mixing.margin_report(short, ["lang"], 0.5).collect()}
    assert report["x"]["expected"] < 0.9 and report["x"]["supply"] == pytest.approx(0.35)


def test_lm_scores(documents, corpus):
    words = {r[0]: spaced((r[1] or "").translate(LOWER)) for r in corpus}
    counts, ends = collections.Counter(), 0
    for r in corpus:
        if zlib.crc32(str(r[0]).encode()) % 10:
            counts.update(words[r[0]])
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = suffix_tree.score_documents(documents).collect()
    assert len(got) == len(corpus)
    for r in got:
        own = words[r["doc_id"]]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [counts[w] for w in own] + [ends])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0


def test_lm_states_grow_with_the_corpus(documents, corpus):
    """Scores against a tree in dictionaries: every context of up to DEPTH bytes with MIN_COUNT occurrences takes part."""
    depth, smoothing = suffix_tree.DEPTH, suffix_tree.SMOOTHING
    assert depth > 4
    pad = b"\n" * depth
    runs = lambda t: [(s[i - depth : i], s[i]) for s in [pad + " ".join(spaced((t or "").translate(LOWER))).encode() + b"\n"] for i in range(depth, len(s))]
    seen = collections.defaultdict(collections.Counter)
    for r in corpus:
        if zlib.crc32(str(r[0]).encode()) % 10:
            for context, symbol in runs(r[1]):
                for d in range(depth + 1):
                    seen[context[depth - d :]][symbol] += 1
    total = sum(seen[b""].values())
    kept = {}

    def p(context, symbol):
        out = (seen[b""][symbol] + 0.1) / (total + 25.6)
        for d in range(1, len(context) + 1):
            own = kept.get(context[len(context) - d :])
            if own:
                n = sum(own.values())
                out = smoothing / (n + smoothing) * out + own[symbol] / (n + smoothing)
        return out

    for context in sorted(seen, key=len):
        n = sum(seen[context].values())
        if context and n >= suffix_tree.MIN_COUNT and sum(c / n * math.log2(c / n / p(context[1:], s)) for s, c in seen[context].items()) >= suffix_tree.MIN_DIVERGENCE:
            kept[context] = seen[context]
    assert any(len(c) == depth and sum(n.values()) < 20 for c, n in kept.items())
    texts = {r[0]: r[1] for r in corpus}
    for r in suffix_tree.score_documents(documents).collect():
        assert r["score"] == pytest.approx(sum(math.log10(p(*x)) for x in runs(texts[r["doc_id"]])), rel=1e-5)


def test_suffix_tree_is_a_distribution(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, True, "abab abba " * 50), (2, True, "ba ab " * 30)], "block long, train boolean, text string")
    tree = suffix_tree.grow(suffix_tree.run_counts(suffix_tree.block_runs(docs, suffix_tree.DEPTH, 3), suffix_tree.HEAD))
    assert tree.states() > 3
    for context in (b"\n\n\n\n\n", b"abab ", b"zzzzz", b"  aba"):
        head = int.from_bytes(context, "big") << 8
        p = tree.probabilities(np.array([head | s for s in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_empty_tables(spark, nothing):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    path, flat = scratch_path(spark, "none"), scratch_path(spark, "none-flat")
    results = [
        substring_dedup.substring_dedup(nothing), jaccard_join.jaccard_join(nothing), decontaminate.decontaminate(nothing, benchmark), license_scan.license_scan(nothing),
        exact_dedup.exact_dedup(nothing), language_id.identify(nothing), token_files.roundtrip(nothing, tokenizer_path(), 2, path), mixing.mix(nothing, MARGINS, TARGETS),
        suffix_tree.score_documents(nothing), token_counts.count_tokens(nothing, flat, tokenizer_path(), 49407),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_null_ids(spark):
    body = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(None, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body + " x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {None: 0, 1: 0, 2: 70}
    assert len(jaccard_join.jaccard_join(docs).collect()) == 3
    for frame in (license_scan.license_scan(docs), mixing.mix(docs, MARGINS, TARGETS), suffix_tree.score_documents(docs), language_id.identify(docs), exact_dedup.exact_dedup(docs)):
        assert frame.count() == 3


def test_scratch_can_be_dropped(spark):
    from lodestar.llm.common import drop_scratch

    kept = materialize(spark.range(3), "drop-me")
    assert kept.count() == 3
    drop_scratch(spark)
    with pytest.raises(Exception, match="."):
        kept.collect()


def test_runs_are_packed_by_suffix_and_no_key_travels_back(spark):
    rng = random.Random(9)
    rows = [(i, True, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(300)), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, train boolean, text string, block long").coalesce(1)
    size = lambda n: suffix_tree.block_runs(docs, suffix_tree.DEPTH, n).agg(F.sum(F.length("runs"))).first()[0]
    assert size(128) < 1.5 * size(4)
    assert suffix_tree.word_counts(suffix_tree.block_words(docs, 3)).columns == ["block", "bucket", "size", "value", "n", "v"]
    runs = np.array([0x01020304050607, 0xFF00FE00FD00FC, 0x0A], np.uint64)
    assert (suffix_tree.unrotated(suffix_tree.rotated(runs)) == runs).all()


def test_language_model_scores_do_not_depend_on_blocks_and_tasks(spark, documents):
    scores = lambda df, **more: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in suffix_tree.score_documents(df, **more).collect())
    assert scores(documents.repartition(5), block_bytes=20_000) == scores(documents.coalesce(1))
