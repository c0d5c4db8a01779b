"""Reports: precision, recall, F1 over distinct keys, decision counts, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["head", "relation", "tail"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rounded(c: Column) -> Column:
    return F.bround(c, 4)


def half_even(c: Column, digits: int) -> Column:
    """A double rounded as SQL's round_even does it: scaled, rounded half to even and scaled back. bround goes by the decimal digits, where 0.575 is a tie."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def prf(predicted: DataFrame, gold: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row: precision, recall, f1, hit_count, predicted_edge_count, gold_count."""
    p, g = predicted.select(*key).distinct(), gold.select(*key).distinct()
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), key, "full").agg(F.count("p").alias("n_p"), F.count("g").alias("n_g"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("n_h"))
    precision, recall = ratio(F.col("n_h"), F.col("n_p")), ratio(F.col("n_h"), F.col("n_g"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return both.select(rounded(precision).alias("precision"), rounded(recall).alias("recall"), rounded(f1).alias("f1"), F.col("n_h").alias("hit_count"), F.col("n_p").alias("predicted_edge_count"), F.col("n_g").alias("gold_count"))


def decision_report(verified: DataFrame) -> DataFrame:
    """One row: candidate, accepted, rejected, uncertain counts, verifier pass rate, average confidence."""
    n = F.count("*")
    counts = [F.count_if(F.col("decision") == d).alias(c) for d, c in (("accept", "accepted_count"), ("reject", "rejected_count"), ("uncertain", "uncertain_count"))]
    passed = F.coalesce(ratio(F.count_if(F.col("verifier_status") == "passed"), n), F.lit(0.0))
    mean = ratio(F.coalesce(F.sum(F.col("confidence").cast("decimal(12,6)")), F.lit(0)).cast("double"), n)
    return verified.agg(n.alias("candidate_count"), *counts, rounded(passed).alias("verifier_pass_rate"), rounded(mean).alias("average_confidence"))


def by_relation(df: DataFrame) -> DataFrame:
    return df.groupBy("relation").agg(F.count("*").alias("candidate_count"))


def candidate_recall(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: candidate_count, candidate_recall (null without gold)."""
    g = gold.select(*KEY).distinct()
    hit = g.join(candidates.select(*KEY).distinct(), KEY, "left_semi").agg(F.count("*").alias("h"))
    return candidates.agg(F.count("*").alias("candidate_count")).crossJoin(hit).crossJoin(g.agg(F.count("*").alias("g"))).select("candidate_count", F.when(F.col("g") > 0, rounded(F.col("h") / F.col("g"))).alias("candidate_recall"))


def retrieval_report(contexts: DataFrame) -> DataFrame:
    n, size = F.count("*"), F.size("support")
    return contexts.agg(rounded(ratio(F.coalesce(F.sum(size), F.lit(0)), n)).alias("avg_evidence_count"), rounded(ratio(F.count_if(size == 0), n)).alias("empty_context_rate"), F.count_if(F.col("retrieval_metadata.degraded")).alias("degraded_count"))


def model_report(predictions: DataFrame) -> DataFrame:
    return predictions.agg(*(F.count_if(F.col("decision") == d).alias(f"{d}_count") for d in ("accept", "reject", "uncertain")), F.count_if(F.col("parse_error") != "").alias("parse_error_count"), F.count_if(F.col("fallback_reason") != "").alias("fallback_count"))


def verifier_report(verified: DataFrame) -> DataFrame:
    status, support = F.col("hard_verifier.status"), F.col("semantic_verifier.support_status")
    return verified.agg(F.count_if(status == "passed").alias("hard_pass_count"), F.count_if(status == "failed").alias("hard_fail_count"), *(F.count_if(support == s).alias(f"semantic_{s}_count") for s in ("supported", "not_supported", "conflicted")))


def full_report(candidates: DataFrame, contexts: DataFrame, predictions: DataFrame, verified: DataFrame, pending: DataFrame, gold: DataFrame) -> dict[str, dict]:
    """The five sections of a run's report, one row each."""
    first = lambda df: df.first().asDict()
    return {
        "candidate": first(candidate_recall(candidates, gold)) | {"candidate_count_by_relation": {r.relation: r.candidate_count for r in by_relation(candidates).collect()}},
        "retrieval": first(retrieval_report(contexts)) | {"evidence_recall_at_k_if_gold_available": None},
        "llm": first(model_report(predictions)),
        "verifier": first(verifier_report(verified)),
        "final": first(prf(pending, gold)),
    }


def risks(predictions: DataFrame, evidence_ids: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row on unverified predictions (schema_ok): duplicate accepted keys, schema violations, low-confidence acceptances, invalid citations."""
    accepted = F.col("decision") == "accept"
    key = F.struct(*KEY)
    row = predictions.agg(
        (F.count_if(accepted) - F.count_distinct(F.when(accepted, key))).alias("duplicate_accept_count"),
        F.count_if(accepted & ~F.col("schema_ok")).alias("schema_violation_count"),
        F.count_if(accepted & (F.col("confidence") < threshold)).alias("low_confidence_accept_count"),
    )
    cited = predictions.select(F.explode("supporting_evidence_ids").alias("id")).join(evidence_ids.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("invalid_citation_count"))
    return row.crossJoin(cited)


def coverage_curve(scored: DataFrame, label: str = "is_gold") -> DataFrame:
    """precision at each confidence taken as the threshold: confidence, accepted, hits, coverage, precision."""
    levels = scored.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("h"))
    w = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct confidence
    total = scored.agg(F.count("*").alias("total"))
    c = levels.withColumn("accepted", F.sum("n").over(w)).withColumn("hits", F.sum("h").over(w)).crossJoin(total)
    return c.select("confidence", "accepted", "hits", half_even(F.col("accepted") / F.col("total"), 4).alias("coverage"), half_even(F.col("hits") / F.col("accepted"), 4).alias("precision"))
