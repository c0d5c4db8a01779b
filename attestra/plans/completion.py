"""The engine's pipelines: many relations with review, and one relation by rules."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.config import Task
from attestra.operators import candidates, graph, metrics, reason, retrieval, verify, writeback
from attestra.operators.checks import links
from attestra.sources.shared import cut


def complete(kg: dict[str, DataFrame], specs: DataFrame, top_k: int = 5, client: Callable[[], reason.Client] | None = None, attempts: int = 1, auto_review: bool = True, encoder=None, reranker=None) -> dict[str, DataFrame]:
    """Candidates, contexts, predictions, verified, pending, reviewed and enriched triples of all relations.

    Without a client the mock model answers as a plain plan. auto_review approves every pending edge.
    """
    found = cut(candidates.multi_route(kg, specs), "candidates")
    ends = [found.select(F.col(s).alias("id")).distinct() for s in ("head", "tail")]
    paths = graph.shortest_paths(graph.simple_paths(graph.ranked_edges(kg["triples"]), ends[0], ends[1], 3).join(found.select("head", "tail").distinct(), ["head", "tail"], "left_semi"))
    contexts = cut(retrieval.retrieve(found, kg, specs, top_k, encoder, reranker, paths), "contexts")
    said = cut(reason.predictions(contexts, reason.ask(contexts, client, attempts)) if client else reason.mock_predictions(contexts), "predictions")
    kinds = kg["entities"].select("id", "type")
    typed = said.join(specs.select(F.col("relation").alias("asked_relation"), "head_types", "tail_types"), "asked_relation")
    for side in ("head", "tail"):
        typed = typed.join(kinds.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type")), side, "left")
    legal = (F.col("relation") == F.col("asked_relation")) & F.array_contains("head_types", F.col("head_type")) & F.array_contains("tail_types", F.col("tail_type"))
    ids = F.transform(F.concat("support", "conflict"), lambda x: x["id"])
    rows = typed.withColumn("schema_ok", F.coalesce(legal, F.lit(False))).withColumn("context_ids", ids)
    verified = cut(verify.fold(verify.semantic(verify.hard(rows))).drop("head_types", "tail_types"), "verified")
    pending = cut(writeback.pending(verified, kg["triples"]), "pending")
    out = {"candidates": found, "contexts": contexts, "predictions": said, "verified": verified, "pending": pending}
    if auto_review:
        reviews = pending.select("candidate_id", F.lit("approved").alias("decision"), "seq")
        out |= apply_review(pending, reviews, kg["triples"])
    return out


def apply_review(pending: DataFrame, reviews: DataFrame, triples: DataFrame) -> dict[str, DataFrame]:
    reviewed = cut(writeback.review(pending, reviews, triples), "reviewed")
    return {"reviewed": reviewed, "enriched": writeback.enriched(triples, writeback.approved_edges(reviewed)), "review_report": writeback.review_report(reviewed, triples)}


def decide(found: DataFrame, kg: dict[str, DataFrame], task: Task, client: Callable[[], reason.Client] | None = None) -> DataFrame:
    """Predictions of one relation's candidates, in their order, with context_ids and schema_ok.

    A candidate's evidence is what names an end, best first (both ends, then reliability, then id), top_k of it.
    """
    named = links(kg["evidence"]).select("evidence_id", "entity_id").join(kg["evidence"].select(F.col("id").alias("evidence_id"), "reliability"), "evidence_id")
    hits = None
    for side in ("head", "tail"):
        h = found.select("seq", F.col(side).alias("entity_id")).join(named, "entity_id").select("seq", "evidence_id", "reliability")
        hits = h if hits is None else hits.unionByName(h)
    ranked = hits.groupBy("seq", "evidence_id", "reliability").agg(F.count("*").alias("ends"))
    w = Window.partitionBy("seq").orderBy(F.desc("ends"), F.desc("reliability"), "evidence_id")
    best = ranked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= task.retrieval.top_k).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence_id"))), lambda x: x["evidence_id"]).alias("context_ids"))
    kinds = kg["entities"].select("id", "type")
    rows = found.join(best, "seq", "left").withColumn("context_ids", F.coalesce("context_ids", F.array().cast("array<string>")))
    for side in ("head", "tail"):
        rows = rows.join(kinds.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type")), side, "left")
    r = task.retrieval
    said = reason.mock_decision(F.col("candidate_score"), F.col("context_ids"), F.lit(r.include_graph_paths) & (F.size("paths") > 0), F.lit(r.include_common_neighbors) & (F.size("common_neighbors") > 0), F.col("tail_type"))
    legal = F.col("head_type").isin(task.allowed_head_types) & F.col("tail_type").isin(task.allowed_tail_types)
    return rows.withColumn("p", said).select("seq", "candidate_id", "head", "relation", "tail", "candidate_score", "context_ids", "p.*", F.coalesce(legal, F.lit(False)).alias("schema_ok"))


def complete_one(kg: dict[str, DataFrame], task: Task, offset: int = 0, limit: int | None = None, use_verifier: bool = True, writeback_mode: str | None = None) -> dict[str, Any]:
    """Candidates, verified predictions, predicted edges and reports of one relation."""
    found = cut(candidates.single_relation(kg, task), "candidates")
    said = cut(decide(candidates.window(found, offset, limit), kg, task), "predictions")
    checked = verify.grounding(said, kg["evidence"])
    if use_verifier:
        final = verify.single_relation(checked, task.verifier).drop("decision").withColumnRenamed("final_decision", "decision")
    else:
        final = checked.withColumn("verifier_status", F.lit("disabled"))
    final = cut(final.withColumn("prediction_id", F.format_string("p_%03d", F.row_number().over(Window.orderBy("seq")))), "verified")
    accepted = final.where((F.col("decision") == "accept") & F.col("verifier_status").isin("passed", "disabled"))
    out: dict[str, Any] = {"candidates": found, "predictions": said, "verified": final, "predicted": accepted}
    out["report"] = metrics.prf(accepted, kg["gold"]).first().asDict() | metrics.decision_report(final).first().asDict()
    out["risks"] = metrics.risks(said, kg["evidence"], task.verifier.confidence_threshold)
    if writeback_mode:
        decided = writeback.edge_decisions(final, kg["triples"])
        out |= {"edges": writeback.edges(decided), "edge_report": writeback.edge_report(decided, writeback_mode)}
        if writeback_mode == "approved":
            out["enriched"] = writeback.enriched(kg["triples"], out["edges"])
    return out
