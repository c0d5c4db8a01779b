"""Command line: python -m attestra COMMAND ...

build-star, build-documents, candidates, run, run-one, review, evaluate.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from attestra import schemas
from attestra.config import load_env, load_provider, load_relations, load_task, relation_table
from attestra.operators import candidates, checks, documents, ingest, metrics, reason
from attestra.plans import completion
from attestra.sources import readers, writers


def _graph(spark: SparkSession, path: str) -> dict:
    kg = {k: v.cache() for k, v in readers.read_knowledge_graph(spark, path).items()}
    checks.check_graph(kg)
    return kg


def _say(report: object) -> None:
    print(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True, default=str))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="attestra")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **flags: dict) -> None:
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        for o, kw in flags.items():
            c.add_argument(f"--{o.replace('_', '-')}", **kw)

    command("build-star", "manifest", "raw-dir", "out-dir")
    command("build-documents", "metadata", "out-dir", train={}, dev={}, test={}, split={}, lenient={"action": "store_true"}, max_docs={"type": int})
    command("candidates", "graph", "relation-schema", "out")
    command("run", "graph", "relation-schema", "out-dir", llm_config={}, provider={"default": "mock"}, top_k={"type": int, "default": 5})
    command("run-one", "graph", "config", "out-dir", offset={"type": int, "default": 0}, limit={"type": int}, no_verifier={"action": "store_true"}, writeback={"choices": ["pending", "approved"]})
    command("review", "graph", "pending", "reviews", "out")
    command("evaluate", "predicted", "gold", verified={})
    a = p.parse_args(args)
    load_env()
    spark = SparkSession.builder.appName("attestra").getOrCreate()

    if a.command == "build-star":
        built = ingest.build(readers.read_star(spark, a.manifest, a.raw_dir))
        writers.write_dataset(built, a.out_dir)
        _say(ingest.summary(built))
    elif a.command == "build-documents":
        _say(documents.process(spark, a.metadata, a.out_dir, {s: getattr(a, s) for s in readers.SPLITS}, a.split, strict=not a.lenient, max_docs=a.max_docs))
    elif a.command == "candidates":
        found = candidates.multi_route(_graph(spark, a.graph), relation_table(spark, load_relations(a.relation_schema))).cache()
        writers.write_jsonl(found.orderBy("seq"), a.out)
        _say({r.relation: r.candidate_count for r in metrics.by_relation(found).collect()})
    elif a.command == "run":
        kg = _graph(spark, a.graph)
        settings = load_provider(a.llm_config, a.provider) if a.llm_config else {"provider": a.provider}
        client = None if a.provider == "mock" else lambda: reason.make_client(settings)
        o = completion.complete(kg, relation_table(spark, load_relations(a.relation_schema)), a.top_k, client)
        for name in ("candidates", "contexts", "predictions", "verified", "pending", "enriched"):
            writers.write_jsonl(o[name].orderBy("seq"), f"{a.out_dir}/{name}.jsonl")
        report = metrics.full_report(o["candidates"], o["contexts"], o["predictions"], o["verified"], o["pending"], kg["gold"])
        writers.write_report(report, f"{a.out_dir}/evaluation_report.json")
        _say(report)
    elif a.command == "run-one":
        o = completion.complete_one(_graph(spark, a.graph), load_task(a.config), a.offset, a.limit, not a.no_verifier, a.writeback)
        for name in ("candidates", "verified", "predicted", "edges", "enriched"):
            if name in o:
                writers.write_jsonl(o[name].orderBy("seq"), f"{a.out_dir}/{name}.jsonl")
        writers.write_report(o["report"], f"{a.out_dir}/report.json")
        _say(o["report"] | {"risks": o["risks"].first().asDict()})
    elif a.command == "review":
        triples = readers.read_table(spark, f"{a.graph}/triples.jsonl", "triples")
        ddl = "candidate_id string, head string, relation string, tail string, confidence double, supporting_evidence_ids array<string>"
        done = completion.apply_review(readers.read_jsonl(spark, a.pending, ddl), readers.read_jsonl(spark, a.reviews, schemas.REVIEWS), triples)
        writers.write_jsonl(done["enriched"], a.out)
        _say(done["review_report"].first().asDict())
    elif a.command == "evaluate":
        report = metrics.prf(readers.read_jsonl(spark, a.predicted, schemas.GOLD), readers.read_jsonl(spark, a.gold, schemas.GOLD)).first().asDict()
        if a.verified:
            report |= metrics.decision_report(readers.read_jsonl(spark, a.verified, "decision string, confidence double, verifier_status string")).first().asDict()
        _say(report)


if __name__ == "__main__":
    main()
