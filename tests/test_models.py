"""Calls of language models: JSON mode and retries, query variants, judgements, with scripted models."""

import json

import pytest

from lodestar.operators import fusion, generation


class Server:
    """Replies one after the other, the last one for ever."""

    def __init__(self, *replies):
        self.replies, self.requests = list(replies), []

    def __call__(self, path, body):
        self.requests.append(body)
        return {"message": {"content": self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]}}


def model(server, attempts=3):
    return generation.HttpModel("m", pause=0, attempts=attempts, post=server)


def test_json_mode():
    server = Server('{"a": 1}')
    assert model(server).complete_json("p") == {"a": 1} and server.requests[0]["format"] == "json" and len(server.requests) == 1
    plain = Server("hi")
    assert model(plain).complete("p") == "hi" and "format" not in plain.requests[0]


def test_truncated_json_is_asked_for_again():
    server = Server('{"question": "What', '{"question": "ok"}')
    assert model(server).complete_json("p") == {"question": "ok"} and len(server.requests) == 2
    junk = Server("not json at all")
    with pytest.raises(generation.ModelError):
        model(junk, attempts=2).complete_json("p")
    assert len(junk.requests) == 2


@pytest.mark.parametrize(("text", "value"), [('Sure:\n```json\n{"a": 2}\n``` done {x}', {"a": 2}), ('so [1, 2] it is', [1, 2]), ('{"a": {"b": 1}}', {"a": {"b": 1}})])
def test_read_json(text, value):
    assert generation.read_json(text) == value


def variants(spark, model, n=3):
    queries = spark.createDataFrame([("1", "first question"), ("2", "second one")], "qid string, query string")
    made = generation.rewrite(queries, model, n)
    if made is None:
        return None
    from pyspark.sql import functions as F

    both = queries.select("qid", F.lit(0).alias("ordinal"), "query").unionByName(made.withColumn("ordinal", F.col("ordinal") + 1))
    out = {}
    for r in sorted(fusion.distinct_variants(both, n).collect(), key=lambda r: (r["qid"], r["query_idx"])):
        out.setdefault(r["qid"], []).append(r["query"])
    return out


def test_variants_keep_the_original_first_and_drop_repeats(spark):
    scripted = generation.ScriptedModel({"first": '{"queries": ["First question", " other ", 7, "third", "fourth"]}', "second": '["x"]'})
    assert variants(spark, scripted) == {"1": ["first question", "other", "third"], "2": ["second one", "x"]}


def test_variants_survive_failures(spark):
    scripted = generation.ScriptedModel({"first": '{"queries": "not a list"}'})  # none for the second: an error
    assert variants(spark, scripted) == {"1": ["first question"], "2": ["second one"]}
    assert variants(spark, generation.NullModel()) is None and variants(spark, scripted, 1) is None


def test_judgements_fail_each_for_itself(spark):
    claims = json.dumps({"claims": [{"claim": "a", "verdict": "Supported"}, {"claim": "b", "verdict": "contradicted"}]})
    scripted = generation.ScriptedModel({"factual claim": claims, "numbered passage": json.dumps({"verdicts": [{"index": 1, "useful": True}, {"index": 2, "useful": False}]})})
    rows = spark.createDataFrame(
        [("1", "factoid", "q?", "an answer", True, "ctx", ["p" * 2000, "two"]), ("2", "factoid", "q?", "INSUFFICIENT CONTEXT", False, "", []), ("3", "factoid", "q?", "@" * 20, True, "ctx", ["p"]), ("4", "factoid", "q?", "fine", True, "ctx", [])],
        "qid string, question_type string, question string, answer string, answerable boolean, context_text string, passages array<string>",
    )
    got = {r["qid"]: r for r in generation.judge(rows, scripted).collect()}
    assert (got["1"]["faithfulness"], got["1"]["n_unsupported"], got["1"]["answer_relevance"], got["1"]["context_precision"]) == (0.5, 1, None, 0.5)
    assert len(got["1"]["errors"]) == 1 and got["1"]["errors"][0].startswith("relevance")
    assert got["2"]["faithfulness"] == 1.0 and got["2"]["abstention_correct"] and not got["2"]["errors"]
    assert got["3"]["degenerate"] and got["3"]["faithfulness"] is None
    assert got["4"]["context_precision"] == 0.0


def corpus_index(spark, dense=True):
    from lodestar import schemas
    from lodestar.config import Config
    from lodestar.plans.index import CorpusIndex

    rows = []
    for i in range(24):
        meta = (None, None, None, None, ["heart" if i % 2 else "lung", f"term{i}"], None, None, None)
        rows.append((f"c{i:02d}", f"d{i // 2}", i % 2, f"Passage {i} says that drug{i} lowers marker{i % 5} by {i} units.", 12, f"Title {i}", "local", "Results", None, "2020", meta))
    cfg = Config().patch({"retrieval.dense.enabled": dense})
    return CorpusIndex.build(spark.createDataFrame(rows, schemas.CHUNKS), cfg), cfg


WRITES = '{"question": "What lowers it?", "answer": "a drug"}'


@pytest.mark.parametrize("dense", [True, False])
def test_golden_set_fills_its_quotas_with_accepted_items(spark, dense):
    from lodestar.operators.golden import Quotas
    from lodestar.plans import golden_set

    index, _ = corpus_index(spark, dense)
    # passages with a 7 in their number are refused by the screener, those with a 5 cannot be written
    scripted = generation.ScriptedModel({"be kept?": '{"keep": true}', "drug5 ": "no json", "one": WRITES})
    strict = generation.ScriptedModel({"be kept?": '{"keep": false, "violated_rules": [3]}', "one": WRITES})
    built = golden_set.build(index, scripted, Quotas(factoid=3, multi_hop=2, aggregation=2, unanswerable=2, group_size=3))
    items = built.items.collect()
    kinds = [r["question_type"] for r in items]
    assert kinds == ["factoid"] * 3 + ["multi_hop"] * 2 + ["aggregation"] * 2 + ["unanswerable"] * 2
    assert {len(r["gold_chunk_ids"]) for r in items if r["question_type"] == "multi_hop"} == {2} and {len(r["gold_chunk_ids"]) for r in items if r["question_type"] == "aggregation"} == {3}
    assert all(r["gold_chunk_ids"] == [] and r["answer"] is None for r in items if r["question_type"] == "unanswerable")
    assert all(len({int(c[1:]) // 2 for c in r["gold_chunk_ids"]}) == 2 for r in items if r["question_type"] == "multi_hop")
    none = golden_set.build(index, strict, Quotas(factoid=2, multi_hop=0, aggregation=0, unanswerable=0, attempts=2))
    assert none.items.count() == 0 and {r["outcome"]: r["n"] for r in none.report.collect()} == {"generated": 4, "kept": 0, "rejected": 4, "reason: vague, or several answers equally correct": 4}


def test_evaluation_with_answers_judges_and_latency(spark):
    from lodestar.operators.telemetry import Clock
    from lodestar.plans import evaluation

    index, cfg = corpus_index(spark)
    items = spark.createDataFrame([("q1", "What does drug3 lower?", "factoid", ["c03"]), ("q2", "What does drug8 lower?", "factoid", ["c08"]), ("q3", "Who won?", "unanswerable", [])], "qid string, question string, question_type string, gold_chunk_ids array<string>")
    writer = generation.ScriptedModel({"QUESTION: What does drug3": "It lowers marker3 [d1 \u00a7Results].", "QUESTION: Who won": "INSUFFICIENT CONTEXT"})  # q2 fails
    judge = generation.ScriptedModel({"factual claim": '{"claims": [{"claim": "x", "verdict": "supported"}]}', "numbered passage": '{"verdicts": [{"index": 1, "useful": true}]}', "How well": '{"score": 0.9}'})
    clock = Clock()
    done = evaluation.run(index, items, cfg, model=writer, judge=judge, clock=clock)
    records = {r["qid"]: r for r in done.records.collect()}
    assert records["q1"]["faithfulness"] == 1.0 and records["q1"]["citations"] == ["d1 \u00a7Results"] and records["q1"]["error"] is None
    assert records["q2"]["answer"] is None and records["q2"]["error"] and records["q3"]["abstained"]
    quality = done.quality.first()
    assert (quality["faithfulness"], quality["abstention_accuracy"], quality["n_evaluated"]) == (1.0, 1.0, 2)
    stages = {r["stage"] for r in done.latency.collect()}
    assert {"search", "fusion", "rerank", "assemble_context", "generate", "TOTAL", "TOTAL_RETRIEVAL"} <= stages
    gates = {r["gate"]: r for r in evaluation.gates(evaluation.gate_inputs(done), cfg).collect()}
    assert gates["faithfulness"]["value"] == 1.0 and gates["p95_ms"]["value"] > 0
    clock.release()


def test_chunking_ablation(spark):
    from lodestar.config import Config
    from lodestar.operators.chunking import chunk_documents
    from lodestar.plans import evaluation

    docs = spark.createDataFrame([(f"d{i}", f"T{i}", "local", [("A", f"Drug{i} lowers marker{i}. " * 30)], None, None) for i in range(4)], "doc_id string, title string, source_type string, sections array<struct<heading:string,text:string>>, url string, date string")
    cfg = Config().patch({"retrieval.dense.enabled": False, "chunking.target_tokens": 40, "chunking.min_tokens": 4})
    base = chunk_documents(docs, cfg.chunking, "words")
    gold = base.where("doc_id = 'd2' AND ordinal = 0").collect()[0]["chunk_id"]
    items = spark.createDataFrame([("q", "drug2 marker2", "factoid", [gold])], "qid string, question string, question_type string, gold_chunk_ids array<string>")
    rows = [evaluation.Row("small", {"chunking.target_tokens": 40}), evaluation.Row("fixed", {"chunking.strategy": "fixed", "chunking.target_tokens": 60})]
    got = {r["label"]: r for r in evaluation.chunking_ablation(docs, base, items, cfg, rows, "words").collect()}
    assert set(got) == {"small", "fixed"} and all(r["hit_10"] == 1.0 for r in got.values())
