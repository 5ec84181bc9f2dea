"""The stages on a small folder: columns, effects, and the guard around missing files."""

import subprocess
import sys

import corpus_pipeline


def test_stages(spark, documents, corpus, tmp_path):
    spark.createDataFrame([(1, " ".join(corpus[12][1].split()[:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == before, name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert {0, 1, 2}.isdisjoint(kept[0]) and 9 in kept[0]
    assert 14 not in kept[1] and 13 in kept[1] and 6 not in kept[1]
    assert docs.count() <= len(kept[2]) and kept[3] <= kept[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == kept[3]


def test_near_copies_of_five_words(spark):
    """5-word similarity 0.8 and more is a near copy, whatever that of 3 words; less is none."""
    words = [f"w{i}" for i in range(154)]  # 150 shingles of five words, 152 of three
    changed = lambda places: " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))
    shingles = lambda t, n: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    jaccard = lambda a, b, n: len(shingles(a, n) & shingles(b, n)) / len(shingles(a, n) | shingles(b, n))
    base, near, far = changed(()), changed((2, 30, 80)), changed((20, 50, 80, 110))
    assert 0.8 <= jaccard(base, near, 5) < 0.87 and jaccard(base, near, 3) < 0.9
    assert jaccard(base, far, 5) < 0.8 and jaccard(near, far, 5) < 0.8
    docs = spark.createDataFrame([(1, base), (2, near), (3, far)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]


def test_run_on_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_llm(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
