"""Retrieval, assembly, metrics and evaluation on literal cases."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.config import Chunking, Config, Lexical
from lodestar.operators import chunking, dense, failures, fusion, generation, golden, judging, lexical, metrics, ranking, telemetry
from lodestar.plans import evaluation
from lodestar.plans.index import CorpusIndex, IndexMismatch
from lodestar.plans.retrieval import retrieve

CORPUS = [("a", "SGLT2 inhibitors lower glucose in heart failure"), ("b", "beta blockers in heart failure"), ("c", "pneumonia antibiotics in heart patients heart"), ("d", "kidney disease and glucose control")]


def ranking_rows(spark, lists):
    rows = [("q", s, c, float(x), i) for s, own in lists.items() for i, (c, x) in enumerate(own, 1)]
    return spark.createDataFrame(rows, "qid string, source string, chunk_id long, raw_score double, rank int")


def order(df, score="score"):
    return [(r["chunk_id"], r[score]) for r in df.orderBy("rank").collect()]


def test_bm25(spark):
    index = lexical.build_index(spark.createDataFrame(CORPUS, "chunk_id string, text string"))
    asked = [("one", "SGLT2"), ("thrice", "SGLT2 SGLT2 SGLT2"), ("oov", "zebra"), ("empty", ""), ("stop", "the of and"), ("two", "heart glucose")]
    rows = lexical.search(index, spark.createDataFrame(asked, "qid string, query string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["qid"], []).append((r["rank"], r["chunk_id"], r["raw_score"]))
    assert set(by) == {"one", "thrice", "two"}
    assert sorted(by["one"])[0][1] == "a" and by["one"] == by["thrice"]
    n, df, dl, avg = 4, 1, 6, (6 + 4 + 5 + 4) / 4
    assert by["one"][0][2] == pytest.approx(math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)))
    assert min(r["idf"] for r in index.terms.collect()) > 0


def test_rrf_and_ties(spark):
    got = order(fusion.fuse(ranking_rows(spark, {"bm25": [(7, 9.0), (3, 1.0)], "dense": [(3, 0.9), (7, 0.1)]})))
    assert [c for c, _ in got] == [3, 7] and all(s == pytest.approx(1 / 61 + 1 / 62) for _, s in got)
    scaled = order(fusion.fuse(ranking_rows(spark, {"bm25": [(7, 900.0), (3, 100.0)], "dense": [(3, 0.9), (7, 0.1)]})))
    assert [c for c, _ in scaled] == [3, 7]


def test_passthrough_and_normalized_sum(spark):
    assert order(fusion.fuse(ranking_rows(spark, {"dense": [(3, 0.91), (1, 0.72)], "bm25": []}))) == [(3, 0.91), (1, 0.72)]
    flat = order(fusion.fuse(ranking_rows(spark, {"a": [(1, 2.0), (2, 2.0)], "b": [(2, 5.0), (1, 1.0)]}), "normalized_sum"))
    assert flat == [(2, 2.0), (1, 1.0)]
    with pytest.raises(ValueError):
        fusion.fuse(ranking_rows(spark, {"a": [(1, 1.0)]}), "other")


def test_dense(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.1])], "qid string, embedding array<float>")
    assert [r["chunk_id"] for r in dense.search(vectors, asked, 5).orderBy("rank").collect()] == [3, 1, 2]
    assert [r["chunk_id"] for r in dense.search(vectors, asked, 2, normalized=False).orderBy("rank").collect()] == [1, 3]


def test_rerank_keeps_tail(spark):
    fused = spark.createDataFrame([("q", i, 1.0 / i, i) for i in range(1, 7)], "qid string, chunk_id long, score double, rank int")
    got = ranking.rerank(fused, F.col("chunk_id") % 4 * 1.0, candidates=4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [3, 2, 1, 4, 5, 6] and got[5]["rerank_score"] is None


def items(spark, rows, schema="chunk_id long, token_count int, tokens array<string>, embedding array<double>"):
    return spark.createDataFrame([(rows,)], f"items array<struct<{schema.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")


def ids(df, column):
    return [x["chunk_id"] for x in df.select(column.alias("o")).first()["o"]]


def test_assembly(spark):
    chain = items(spark, [(0, 10, ["a", "b"], [1.0, 0.0]), (1, 10, ["b", "a"], [1.0, 0.0]), (2, 10, ["c"], [0.0, 1.0])])
    assert ids(chain, ranking.deduplicate(F.col("items"))) == ids(chain, ranking.deduplicate(F.col("items"), vectors=True)) == [0, 2]
    # 1 is like 0 and 2 is like 1 but not like 0: 2 stays
    bridge = items(spark, [(0, 1, None, [1.0, 0.0]), (1, 1, None, [0.95, 0.31]), (2, 1, None, [0.8, 0.6])])
    assert ids(bridge, ranking.deduplicate(F.col("items"), 0.92, vectors=True)) == [0, 2]
    five = items(spark, [(i, 10, [str(i)], None) for i in range(5)])
    assert ids(five, ranking.within_budget(F.col("items"), 25)) == [0, 1]
    assert ids(five, ranking.edge_order(F.col("items"))) == [0, 2, 4, 3, 1]
    assert ids(five, ranking.edge_order(F.col("items"), "sequential")) == [0, 1, 2, 3, 4]
    skip = items(spark, [(i, n, [str(i)], None) for i, n in enumerate([10, 12, 10, 3])])
    assert ids(skip, ranking.within_budget(F.col("items"), 25)) == [0, 1, 3]


def test_metrics(spark):
    golden_rows = [("hit", "factoid", ["a", "d"]), ("late", "factoid", ["a", "b"]), ("none", "factoid", ["z"]), ("un", "unanswerable", [])]
    gold = spark.createDataFrame(golden_rows, "qid string, question_type string, gold_chunk_ids array<string>")
    ranked = spark.createDataFrame([("hit", c, i) for i, c in enumerate("abc", 1)] + [("late", c, i) for i, c in enumerate("xyab", 1)] + [("un", "a", 1)], "qid string, chunk_id string, rank int")
    scored = metrics.score_items(gold, ranked, (1, 3, 10))
    got = {r["qid"]: r for r in scored.collect()}
    assert set(got) == {"hit", "late", "none"}
    assert got["hit"]["recall_3"] == 0.5 and got["hit"]["precision_10"] == pytest.approx(1 / 3) and got["hit"]["ndcg"] == pytest.approx(1 / (1 + 1 / math.log2(3)))
    assert got["late"]["mrr"] == pytest.approx(1 / 3) and got["late"]["first_hit_rank"] == 3
    assert got["none"]["recall_10"] == got["none"]["mrr"] == got["none"]["precision_1"] == 0
    total = metrics.macro_average(scored, gold).first()
    assert total["recall_3"] == pytest.approx((0.5 + 0.5 + 0) / 3) and (total["n_evaluated"], total["n_skipped"]) == (3, 1)


def count_words(text):
    return len(text.split())


def test_packing():
    long = " ".join(f"w{i}" for i in range(500))
    windows = list(chunking.pack([long], count_words, 50, 10))
    assert len(windows) >= 10 and max(map(count_words, windows)) <= 50 and sum(map(count_words, windows)) == 500
    sized = [" ".join([c] * n) for c, n in (("a", 40), ("b", 50), ("c", 70))]
    assert [count_words(w) for w in chunking.pack(sized, count_words, 100, 50)] == [90, 120]
    assert chunking.chunk_sections([{"heading": None, "text": "tiny"}], Chunking(min_tokens=5), count_words) == []
    merged = chunking.chunk_sections([{"heading": "A", "text": "x " * 6}, {"heading": None, "text": " "}, {"heading": "B", "text": "y " * 6}], Chunking(target_tokens=20, min_tokens=2), count_words)
    assert [label for _, label in merged] == ["A / B"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "c."]), min_size=1, max_size=30), max_size=20), st.integers(3, 40), st.integers(0, 60))
def test_packing_loses_nothing(sentences, target, overlap):
    texts = [" ".join(s) for s in sentences]
    windows = list(chunking.pack(texts, count_words, target, overlap))
    assert all(count_words(w) <= 1.5 * target for w in windows)
    assert sum(map(count_words, windows)) >= sum(map(count_words, texts))
    if overlap == 0:
        assert " ".join(windows) == " ".join(texts)


def test_chunk_ids_are_stable(spark):
    docs = spark.createDataFrame([("d", "T", [("H", "one two three. four five six. " * 5)])], "doc_id string, title string, sections array<struct<heading:string,text:string>>")
    cfg = Chunking(target_tokens=12, overlap_tokens=3, min_tokens=2)
    a, b = (chunking.chunk_documents(docs, cfg, "words").orderBy("ordinal").collect() for _ in range(2))
    assert a == b and len({r["chunk_id"] for r in a}) == len(a) > 1 and {r["section"] for r in a} == {"H"} and a[0]["title"] == "T"


def test_generation_scores(spark):
    claims = '{"claims": [{"claim": "x", "verdict": "Supported"}, {"claim": "y", "verdict": "unsupported"}, {"claim": "z", "verdict": " supported "}, {"claim": "w", "verdict": "contradicted"}]}'
    verdicts = '{"verdicts": [{"index": 1, "useful": true}, {"index": 1, "useful": false}, {"index": 99, "useful": true}]}'
    rows = [
        ("ok", "fine", True, claims, '{"score": 1.7}', verdicts, 1), ("bad", "fine", True, "nothing", "{}", "[]", 1), ("refused", "INSUFFICIENT CONTEXT", False, None, None, None, 1),
        ("broken", "@" * 20, True, claims, None, None, 1), ("silent", "fine", True, '{"claims": []}', '{"score": 0.5}', verdicts, 0),
    ]
    scored = generation.score_items(spark.createDataFrame([(r[0], "factoid", *r[1:]) for r in rows], "qid string, question_type string, answer string, answerable boolean, claims_json string, score_json string, verdicts_json string, n_passages int"))
    got = {r["qid"]: r for r in scored.collect()}
    ok = got["ok"]
    assert (ok["faithfulness"], ok["n_claims"], ok["n_unsupported"], ok["answer_relevance"], ok["context_precision"]) == (0.5, 4, 2, 1.0, 1.0)
    assert got["bad"]["faithfulness"] is None and len(got["bad"]["errors"]) == 3
    assert got["refused"]["faithfulness"] == 1.0 and got["refused"]["abstention_correct"] and got["refused"]["answer_relevance"] is None
    assert got["broken"]["abstention_correct"] is None and got["broken"]["faithfulness"] is None and got["broken"]["degenerate"]
    assert got["silent"]["faithfulness"] == 1.0 and got["silent"]["context_precision"] == 0.0
    total = generation.aggregate_items(scored).first()
    assert total["hallucination_rate"] == 0.5 and total["n_degenerate"] == 1 and total["n_errors"] == 2


def test_answers(spark):
    rows = spark.createDataFrame([("a", "why?", "ctx", ["t1"]), ("b", "how?", " \n", ["t1"]), ("c", "boom?", "ctx", ["t1"])], "qid string, question string, context_text string, valid_citations array<string>")
    got = {r["qid"]: r for r in generation.answer(rows, generation.ScriptedModel({"why?": " Because [t1] [t2]. "})).collect()}
    assert got["a"]["answer"] == "Because [t1] [t2]." and got["a"]["citations"] == ["t1"]
    assert got["b"]["abstained"] and got["b"]["citations"] == [] and got["b"]["error"] is None
    assert got["c"]["answer"] is None and got["c"]["error"] and not got["c"]["abstained"]
    with pytest.raises(generation.ModelError):
        generation.build_model("null").complete("x")
    with pytest.raises(ValueError):
        generation.build_model("other")


def test_http_model_retries():
    calls = []

    def post(path, body):
        calls.append((path, body))
        if len(calls) < 3:
            raise OSError("down")
        return {"message": {"content": "yes"}}

    assert generation.HttpModel("m", pause=0, post=post).complete("p", "s") == "yes"
    assert len(calls) == 3 and calls[0][1]["options"]["num_ctx"] == 8192 and calls[0][1]["messages"][0]["role"] == "system"
    with pytest.raises(generation.ModelError):
        generation.HttpModel("m", pause=0, post=lambda *_: {"message": {"content": " "}}).complete("p")


def test_failures(spark):
    base = {"question_type": "factoid", "gold": ["g"], "ranked": ["g", "x"], "context": ["g"], "answer": "a", "abstained": False, "error": None, "recall": 1.0, "first": 1, "faith": 0.9, "claims": 4, "uns": 0}
    cases = {
        "clean": {}, "error": {"error": "boom"}, "retrieval": {"ranked": ["x"], "context": [], "recall": 0.0, "first": None}, "ranking": {"context": ["x"], "first": 7}, "refused": {"abstained": True},
        "generation": {"faith": 0.5, "uns": 2}, "partial": {"recall": 0.25}, "made up": {"gold": []}, "right refusal": {"gold": [], "abstained": True}, "not judged": {"faith": None},
    }
    rows = [(k, *{**base, **v}.values()) for k, v in cases.items()]
    schema = "qid string, question_type string, gold_chunk_ids array<string>, ranked_ids array<string>, context_ids array<string>, answer string, abstained boolean, error string, recall double, first_hit_rank int, faithfulness double, n_claims int, n_unsupported int"
    classified = failures.classify(spark.createDataFrame(rows, schema))
    got = {r["qid"]: (r["category"], r["detail"]) for r in classified.collect()}
    wanted = {"clean": None, "error": "error", "retrieval": "retrieval", "ranking": "ranking", "refused": "abstention", "generation": "generation", "partial": "retrieval", "made up": "abstention", "right refusal": None, "not judged": None}
    assert {k: c for k, (c, _) in got.items()} == wanted
    assert "rank 7" in got["ranking"][1] and got["generation"][1].startswith("2/4") and "0.25" in got["partial"][1]
    assert {r["category"]: r["n"] for r in failures.category_counts(classified).collect()} == {"retrieval": 2, "ranking": 1, "abstention": 2, "generation": 1, "error": 1, "clean": 3}
    assert failures.worst(classified, 2).collect()[0]["qid"] == "error"


def test_judging(spark):
    pairs = spark.createDataFrame([("faithfulness", str(i), j, h) for i, (j, h) in enumerate([(1.0, 1.0), (0.9, 0.8), (1.0, 0.2)])], "metric string, qid string, judge double, human double")
    got = judging.validate(pairs).first()
    assert got["agreement"] == pytest.approx(2 / 3) and got["bias"] > 0 and got["verdict"] == "unvalidated" and got["correlation"] is not None
    assert [r["qid"] for r in judging.disagreements(pairs).collect()] == ["2"]
    flat = judging.validate(pairs.withColumn("judge", F.lit(1.0))).first()
    assert flat["correlation"] is None
    wide = spark.createDataFrame([("m", str(i), 1.0 if i < 40 else 0.0, 1.0) for i in range(50)], "metric string, qid string, judge double, human double")
    w = judging.validate(wide).first()
    assert w["ci_high"] - w["ci_low"] > 0.15 and w["verdict"].startswith("usable")


def test_latency(spark):
    rows = [(str(i), "bm25_search", float(i + 1)) for i in range(10)] + [("0", "bm25_search", 5.0), ("3", "generate", 100.0)]
    got = {r["stage"]: r for r in telemetry.latency_summary(spark.createDataFrame(rows, "trace_id string, stage string, ms double")).collect()}
    assert set(got) == {"bm25_search", "generate", "TOTAL", "TOTAL_RETRIEVAL"}
    assert got["bm25_search"]["p95_ms"] == 9.0 and got["bm25_search"]["p50_ms"] == 6.0 and got["TOTAL"]["p95_ms"] == 10.0 and got["generate"]["n"] == 1


def test_golden(spark):
    chunks = spark.createDataFrame([("a", "d1", 0, "alpha beta gamma delta"), ("b", "d1", 1, "epsilon zeta"), ("c", "d2", 0, "alpha beta gamma delta")], "chunk_id string, doc_id string, ordinal int, text string")
    new = spark.createDataFrame([("n1", "d1", 0, "alpha beta gamma"), ("n2", "d1", 1, "delta epsilon"), ("n3", "d2", 0, "alpha beta gamma delta")], "chunk_id string, doc_id string, ordinal int, text string")
    gold = spark.createDataFrame([("keep", "factoid", ["a"]), ("drop", "factoid", ["b"]), ("pass", "unanswerable", []), ("two", "multi_hop", ["a", "b"]), ("lost", "factoid", ["zz"])], "qid string, question_type string, gold_chunk_ids array<string>")
    got = {r["qid"]: (r["outcome"], r["gold_chunk_ids"]) for r in golden.remap(gold, chunks, new).collect()}
    assert got["keep"] == ("remapped", ["n1"]) and got["pass"] == ("passed", []) and got["drop"][0] == "dropped" and got["lost"][0] == "dropped"
    assert [r["qid"] for r in golden.missing_gold(gold, chunks).collect()] == ["lost"]
    assert [r["qid"] for r in golden.single_document_multi_hop(gold, chunks).collect()] == ["two"]
    screens = [("1", "factoid", '{"keep": true, "violated_rules": []}'), ("2", "multi_hop", '{"keep": false, "violated_rules": [2, "6.", "odd"]}'), ("3", "factoid", "oops"), ("4", "factoid", '{"keep": false}')]
    named = {r["qid"]: (r["keep"], r["reasons"]) for r in golden.screen(spark.createDataFrame(screens, "qid string, question_type string, response string")).collect()}
    assert named["1"] == (True, []) and named["2"] == (False, [golden.RULES[2], golden.MULTI_HOP_RULES[6], "odd"])
    assert named["3"] == (False, ["screening_error"]) and named["4"] == (False, ["rejected without a stated rule"])


def test_config():
    cfg = Config().patch({"retrieval.rerank.enabled": False, "eval.k_values": [1, 2]})
    assert not cfg.retrieval.rerank.enabled and cfg.eval.k_values == (1, 2) and Config().retrieval.rerank.enabled
    with pytest.raises(KeyError):
        Config().patch({"retrieval.nothing.enabled": 1})
    with pytest.raises(ValueError):
        Config().patch({"chunking.strategy": "other"})
    assert Config().patch({"retrieval.bm25.k1": 2.0}).fingerprint() == Config().fingerprint() != Config().patch({"chunking.target_tokens": 9}).fingerprint()
    assert Config.load(env={"LODESTAR_RETRIEVAL__FUSION__K": "7"}, overrides={"retrieval.fusion.k": 9}).retrieval.fusion.k == 9


def test_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([(f"local:{i}", f"Title {i}", "local", [("Methods", t + ". " + t)], None, "2020") for i, t in CORPUS], "doc_id string, title string, source_type string, sections array<struct<heading:string,text:string>>, url string, date string")
    cfg = Config().patch({"chunking.min_tokens": 1, "eval.k_values": (1, 10)})
    chunks = chunking.chunk_documents(docs, cfg.chunking, "words").persist()
    index = CorpusIndex.build(chunks, cfg).validate()
    index.save(f"{tmp_path}/index")
    loaded = CorpusIndex.load(spark, f"{tmp_path}/index", cfg)
    with pytest.raises(IndexMismatch):
        CorpusIndex.load(spark, f"{tmp_path}/index", cfg.patch({"chunking.target_tokens": 99}))
    with pytest.raises(IndexMismatch):
        CorpusIndex(chunks.union(chunks), None, None, "x").validate()
    first = chunks.where("doc_id = 'local:a'").first()["chunk_id"]
    items_df = spark.createDataFrame([("q1", "SGLT2 inhibitors glucose", "factoid", [first]), ("q2", "stop the", "unanswerable", [])], "qid string, question string, question_type string, gold_chunk_ids array<string>")
    done = evaluation.run(loaded, items_df, cfg)
    assert done.totals.first()["recall_1"] == 1.0 and done.totals.first()["n_skipped"] == 1
    found = retrieve(loaded, items_df.select("qid", F.col("question").alias("query")), cfg)
    contexts = {r["qid"]: r for r in found.contexts.collect()}
    assert contexts["q1"]["context_ids"][0] == first and "[local:a §Methods] Title a (2020)" in contexts["q1"]["context_text"]
    with pytest.raises(RuntimeError):
        retrieve(loaded, items_df.select("qid", F.col("question").alias("query")), cfg.patch({"retrieval.bm25.enabled": False, "retrieval.dense.enabled": False}))
    table = evaluation.ablation(loaded, items_df, cfg, [evaluation.Row("a"), evaluation.Row("b", {"retrieval.assembly.ordering": "sequential"})])
    assert len({tuple(r)[2:] for r in table.collect()}) == 1 and "| label |" in evaluation.markdown(table)
    variants = spark.createDataFrame([("q1", 0, "glucose control"), ("q1", 1, "SGLT2 INHIBITORS glucose")], "qid string, ordinal int, query string")
    lists = retrieve(loaded, items_df.select("qid", F.col("question").alias("query")), cfg.patch({"retrieval.rewrite.enabled": True}), variants)
    assert lists.rewrite_active and {r["source"] for r in lists.rankings.where("qid = 'q1'").collect()} == {"bm25#0", "bm25#1", "dense#0", "dense#1"}
    counts, _ = evaluation.failure_report(done.records, done.items)
    assert {r["category"]: r["n"] for r in counts.collect()}["clean"] == 2


def test_search_is_scale_free_in_k(spark):
    index = lexical.build_index(spark.createDataFrame(CORPUS, "chunk_id string, text string"))
    asked = spark.createDataFrame([("q", "heart failure glucose")], "qid string, query string")
    wide = lexical.search(index, asked, Lexical(top_k=4)).orderBy("rank").collect()
    assert lexical.search(index, asked, Lexical(top_k=2)).orderBy("rank").collect() == wide[:2]


def test_search_of_a_batch_moves_the_best_rows_of_each_task_alone(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "the", "mg/dl"]
    texts = [" ".join(words[(i * j) % 6] for j in range(1, 4 + i % 5)) for i in range(300)] + ["alpha the beta"] * 60 + ["", None]
    chunks = spark.createDataFrame([(7 * i % 367, t) for i, t in enumerate(texts)], "chunk_id long, text string").repartition(4)
    asked = spark.createDataFrame([(f"q{i}", f"the {words[i % 6]} {words[(i + 1) % 6]}") for i in range(12)] + [("none", "zeta"), ("null", None)], "qid string, query string")
    show = lambda df: [(r.qid, r.chunk_id, round(r.raw_score, 9), r["rank"]) for r in df.orderBy("qid", "rank").collect()]
    for cfg in (Lexical(top_k=5), Lexical(top_k=400, use_stopwords=False)):
        found = lexical.search_chunks(chunks, asked, cfg)
        assert "hashpartitioning(qid, chunk_id" not in re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
        whole = show(lexical.search(lexical.build_index(chunks, cfg), asked, cfg))
        assert show(found) == whole and len({r[0] for r in whole}) == 12
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 3)
    assert show(lexical.search_chunks(chunks, asked, cfg)) == whole
    nothing = spark.createDataFrame([], "qid string, query string")
    monkeypatch.undo()
    assert lexical.search_chunks(chunks, nothing).count() == 0 and lexical.search_chunks(chunks.limit(0), asked).count() == 0
