"""Write-back of verified edges. Sources are never changed; greedy loops become windows over the rows' order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["head", "relation", "tail"]


def edge_decisions(predictions: DataFrame, triples: DataFrame) -> DataFrame:
    """Accepted, passed predictions with outcome: written, skipped_duplicate or skipped_conflict.

    A head and relation take one tail: the triples' own, else the first accepted. A repeated
    edge is a duplicate before it is a conflict.
    """
    ok = predictions.where((F.col("decision") == "accept") & (F.col("verifier_status") == "passed"))
    have = triples.select(*KEY).distinct()
    owned = have.groupBy("head", "relation").agg(F.count("*").alias("tails"))
    rows = ok.join(have.withColumn("known", F.lit(True)), KEY, "left").join(owned, ["head", "relation"], "left")
    free = F.col("tails").isNull()
    by_pair, by_key = Window.partitionBy("head", "relation").orderBy("seq"), Window.partitionBy(*KEY).orderBy("seq")
    first_tail = F.first("tail").over(by_pair)
    outcome = (
        F.when(F.col("known"), "skipped_duplicate")
        .when(~free, "skipped_conflict")
        .when(F.col("tail") != first_tail, "skipped_conflict")
        .when(F.row_number().over(by_key) > 1, "skipped_duplicate")
        .otherwise("written")
    )
    return rows.withColumn("outcome", outcome).drop("known", "tails")


def edges(decided: DataFrame) -> DataFrame:
    """The written ones as triples, numbered in order, under both id names."""
    n = F.row_number().over(Window.orderBy("seq"))
    out = decided.where("outcome = 'written'").withColumn("n", n)
    name = F.concat(F.format_string("pred_%03d_", "n"), "candidate_id")
    return out.select(name.alias("id"), name.alias("triple_id"), *KEY, F.col("supporting_evidence_ids").alias("evidence_ids"), "confidence", "reason", "candidate_id", F.lit("verified_prediction_writeback").alias("source"), F.col("n").cast("long").alias("seq"))


def edge_report(decided: DataFrame, mode: str = "pending") -> DataFrame:
    """One row: pending, approved, skipped_duplicate, skipped_conflict, written_count."""
    if mode not in ("pending", "approved"):
        raise ValueError(f"unsupported mode: {mode}")
    n = {o: F.count_if(F.col("outcome") == o) for o in ("written", "skipped_duplicate", "skipped_conflict")}
    return decided.agg(*((n["written"] if m == mode else F.lit(0)).cast("long").alias(m) for m in ("pending", "approved")), n["skipped_duplicate"].alias("skipped_duplicate"), n["skipped_conflict"].alias("skipped_conflict"), n["written"].alias("written_count"))


def enriched(triples: DataFrame, new: DataFrame) -> DataFrame:
    return triples.unionByName(new, allowMissingColumns=True)


def pending(verified: DataFrame, triples: DataFrame) -> DataFrame:
    """Accepted, hard-passed, semantically supported edges that are new: the first of each key."""
    good = verified.where((F.col("decision") == "accept") & (F.col("hard_verifier.status") == "passed") & F.col("semantic_verifier.support_status").isin("supported", "partially_supported"))
    fresh = good.join(triples.select(*KEY).distinct(), KEY, "left_anti")
    first = fresh.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))).where("n = 1")
    cited = F.when(F.size("semantic_verifier.supported_evidence_ids") > 0, F.col("semantic_verifier.supported_evidence_ids")).otherwise(F.col("supporting_evidence_ids"))
    return first.select("candidate_id", "seq", *KEY, "confidence", cited.alias("supporting_evidence_ids"), F.col("semantic_verifier.support_status").alias("semantic_status"), "reason", "recall_sources", F.current_timestamp().cast("string").alias("created_at"))


def review(pending_edges: DataFrame, reviews: DataFrame, triples: DataFrame) -> DataFrame:
    """pending edges with their place and outcome: approved, rejected or skipped; of several reviews the last counts.

    The first approved edge of a key is approved; later ones, and those among the triples, are skipped.
    """
    last = reviews.groupBy("candidate_id").agg(F.max_by("decision", "seq").alias("review"))
    placed = pending_edges.withColumn("place", F.row_number().over(Window.orderBy("seq")))
    rows = placed.join(last, "candidate_id", "left").join(triples.select(*KEY).distinct().withColumn("known", F.lit(True)), KEY, "left")
    approved = F.col("review") == "approved"
    rank = F.sum(F.when(approved, 1).otherwise(0)).over(Window.partitionBy(*KEY).orderBy("place"))
    outcome = F.when(F.col("review").isNull(), "skipped").when(~approved, "rejected").when(F.col("known") | (rank > 1), "skipped").otherwise("approved")
    return rows.withColumn("outcome", outcome).drop("known")


def approved_edges(reviewed: DataFrame) -> DataFrame:
    got = reviewed.where("outcome = 'approved'")
    name = F.concat(F.format_string("enriched_%06d_", "place"), "candidate_id")
    properties = F.create_map(F.lit("supporting_evidence_ids"), F.to_json("supporting_evidence_ids"), F.lit("review_decision"), F.lit("approved"))
    return got.select(name.alias("id"), *KEY, F.lit("reviewed_pending_edge").alias("source"), F.col("candidate_id").alias("source_row_id"), "confidence", properties.alias("properties"), F.col("place").cast("long").alias("seq"))


def review_report(reviewed: DataFrame, triples: DataFrame) -> DataFrame:
    n = {o: F.count_if(F.col("outcome") == o) for o in ("approved", "rejected", "skipped")}
    counts = reviewed.agg(*(v.alias(k) for k, v in n.items()))
    return counts.crossJoin(triples.agg(F.count("*").alias("t"))).select("approved", "rejected", "skipped", (F.col("t") + F.col("approved")).alias("output_count"))
