"""Command line: ingest, index, eval, ablate, ask, golden, validate-judge; each step leaves tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lodestar import schemas
from lodestar.config import Config
from lodestar.operators import judging
from lodestar.operators.chunking import chunk_documents
from lodestar.operators.generation import build_model
from lodestar.operators.telemetry import Clock
from lodestar.plans import evaluation, golden_set
from lodestar.plans.index import CorpusIndex
from lodestar.plans.retrieval import retrieve
from lodestar.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    top.add_argument("--config")
    top.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    steps = top.add_subparsers(dest="step", required=True)
    for name, args in {
        "ingest": ("source", "out"), "index": ("documents", "out"), "golden": ("index", "out"), "eval": ("index", "golden"),
        "ablate": ("index", "golden"), "ask": ("index", "question"), "validate-judge": ("scores", "labels"),
    }.items():
        own = steps.add_parser(name)
        for a in args:
            own.add_argument(a)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from lodestar.config import json_or_text

    cfg = Config.load(args.config, {k: json_or_text(v) for k, v in (s.split("=", 1) for s in args.set)})
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    if args.step == "ingest":
        files.read_local(spark, args.source).write.mode("overwrite").parquet(args.out)
    elif args.step == "index":
        chunks = chunk_documents(spark.read.schema(schemas.DOCUMENTS).parquet(args.documents), cfg.chunking)
        CorpusIndex.build(chunks, cfg).validate().save(args.out)
    elif args.step == "golden":
        index = CorpusIndex.load(spark, args.index, cfg, strict=False)
        built = golden_set.build(index, build_model(cfg.generation.provider, cfg.generation.model))
        files.write_jsonl(built.items, args.out)
        print(evaluation.markdown(built.report))
    elif args.step == "ask":
        asked = spark.createDataFrame([("q", args.question)], "qid string, query string")
        retrieve(CorpusIndex.load(spark, args.index, cfg), asked, cfg).contexts.select("context_text").show(truncate=False)
    elif args.step == "validate-judge":
        labels = judging.with_defaults(files.read_jsonl(spark, args.labels, schemas.HUMAN_LABELS))
        print(evaluation.markdown(judging.validate(judging.paired(files.read_jsonl(spark, args.scores, schemas.GENERATION_ITEMS), labels))))
    else:
        index, items = CorpusIndex.load(spark, args.index, cfg), files.read_golden(spark, args.golden)
        if args.step == "ablate":
            print(evaluation.markdown(evaluation.ablation(index, items, cfg)))
        else:
            model = build_model(cfg.generation.provider, cfg.generation.model)
            done = evaluation.run(index, items, cfg, model=model, judge=model, clock=Clock())
            for part in (done.totals, done.quality, done.latency, evaluation.failure_report(done.records, done.items)[0]):
                if part is not None:
                    print(evaluation.markdown(part))
            failed = evaluation.gates(evaluation.gate_inputs(done), cfg).where("NOT passed")
            return 1 if failed.limit(1).count() else 0
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
