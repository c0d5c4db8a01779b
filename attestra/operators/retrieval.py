"""Evidence retrieval: keyword and dense ranking, expansion, support and conflict, packed contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attestra.functions.text import CONFLICT_WORDS, entity_text, tokens
from attestra.operators.checks import links
from attestra.operators.routes import dec
from attestra.sources.shared import cut

#: Rows of a block of queries or of the corpus in dense recall.
BLOCK = 2048
Encoder = Callable[[pd.Series], pd.Series]
Reranker = Callable[[pd.Series, pd.Series], pd.Series]


def entity_texts(entities: DataFrame) -> DataFrame:
    return entities.select("id", entity_text(F.col("id"), F.col("name"), F.col("type"), F.col("properties")).alias("entity_text"))


def evidence_texts(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, full_text): text, source, texts of the entities in order, timestamp."""
    named = evidence.select("id", F.posexplode("related_entities").alias("place", "entity")).join(entity_texts(entities).withColumnRenamed("id", "entity"), "entity", "left")
    joined = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("entity_text", "entity").alias("t")))), lambda x: x["t"]), " ").alias("about"))
    parts = [F.coalesce(c, F.lit("")) for c in ("text", "source", "about", "timestamp")]
    return evidence.join(joined, "id", "left").select("id", F.concat_ws(" ", *parts).alias("full_text"))


def queries(candidates: DataFrame, entities: DataFrame, specs: DataFrame) -> DataFrame:
    """candidates with head_text, tail_text, relation_text (what all candidates of a relation share) and query."""
    texts = entity_texts(entities)
    c = candidates.join(F.broadcast(specs), "relation")
    for side in ("head", "tail"):
        c = c.join(texts.select(F.col("id").alias(side), F.col("entity_text").alias(f"{side}_text")), side, "left").withColumn(f"{side}_text", F.coalesce(f"{side}_text", side))
    sources = F.array_join("preferred_sources", " ")
    fixed = ["relation", "description", "prompt_guidance", "semantic_verification_criteria"]
    query = F.concat_ws(" ", *fixed, F.lit("head"), "head_text", F.lit("tail"), "tail_text", F.lit("preferred sources"), sources)
    shared = F.concat_ws(" ", *fixed, F.lit("head tail preferred sources"), sources)
    return c.withColumn("query", query).withColumn("relation_text", shared)


def weight(overlap: Column, head: Column, tail: Column, preferred: Column, reliability: Column) -> Column:
    """Keyword score, exact in its constants."""
    flags = F.when(head, dec(1)).otherwise(dec(0)) + F.when(tail, dec(1)).otherwise(dec(0)) + F.when(preferred, dec(F.lit("0.35"))).otherwise(dec(0))
    return overlap * dec(F.lit("0.08")) + flags + dec(F.coalesce(reliability, F.lit(0.0))) * dec(F.lit("0.2"))


def keyword_scores(asked: DataFrame, evidence: DataFrame, entities: DataFrame, top_k: int, text_only: bool = False) -> DataFrame:
    """(candidate_id, id, retrieval_score, reasons flags): at least the top_k of every candidate.

    Words that a relation's candidates share are matched once for the relation. A candidate
    meets evidence that has a word of its own or names an end; of all other evidence only the
    relation's best top_k can count, since what a candidate adds never lowers a score. text_only: evidence is searched by its text alone.
    """
    full = evidence.select("id", F.col("text").alias("full_text"), "source", "reliability") if text_only else evidence_texts(evidence, entities).join(evidence.select("id", "source", "reliability"), "id")
    texts = cut(full.withColumn("words", tokens(F.col("full_text"))), "texts")
    spec = asked.select("relation", "relation_text", "preferred_sources").distinct()
    common = spec.withColumn("common", tokens(F.col("relation_text"))).select("relation", "preferred_sources", "common")
    shared = F.size(F.array_intersect("words", "common"))
    preferred = F.coalesce(F.array_contains("preferred_sources", F.col("source")), F.lit(False))
    base = texts.crossJoin(F.broadcast(common)).select("relation", "id", "reliability", preferred.alias("preferred"), shared.alias("shared"))
    base = cut(base.withColumn("base", weight(F.col("shared"), F.lit(False), F.lit(False), F.col("preferred"), F.col("reliability"))), "base")
    best = Window.partitionBy("relation").orderBy(F.desc("base"), "id")
    filler = base.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top_k).select("relation", "id")
    own = asked.join(F.broadcast(common.select("relation", "common")), "relation").select("candidate_id", "relation", F.explode(F.array_except(tokens(F.concat_ws(" ", "head_text", "tail_text")), "common")).alias("word"))
    index = texts.select("id", F.explode("words").alias("word"))
    hits = own.join(index, "word").groupBy("candidate_id", "relation", "id").agg(F.count("*").alias("own"))
    mentions = links(evidence).select(F.col("evidence_id").alias("id"), "entity_id")
    ends = {s: asked.select("candidate_id", "relation", F.col(s).alias("entity_id")).join(mentions, "entity_id").select("candidate_id", "relation", "id", F.lit(True).alias(f"has_{s}")) for s in ("head", "tail")}
    meet = asked.select("candidate_id", "relation").join(F.broadcast(filler), "relation")
    pairs = meet.select("candidate_id", "relation", "id").unionByName(hits.select("candidate_id", "relation", "id"))
    for e in ends.values():
        pairs = pairs.unionByName(e.select("candidate_id", "relation", "id"))
    full = pairs.distinct().join(base, ["relation", "id"]).join(hits, ["candidate_id", "relation", "id"], "left")
    for e in ends.values():
        full = full.join(e, ["candidate_id", "relation", "id"], "left")
    flags = {f"has_{s}": F.coalesce(F.col(f"has_{s}"), F.lit(False)) for s in ends}
    score = weight(F.col("shared") + F.coalesce("own", F.lit(0)), flags["has_head"], flags["has_tail"], F.col("preferred"), F.col("reliability"))
    return full.select("candidate_id", "id", F.bround(score, 4).cast("double").alias("retrieval_score"), *(f.alias(n) for n, f in flags.items()), "preferred", "reliability").where("retrieval_score > 0")


def pair_scores(pairs: DataFrame, asked: DataFrame, evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """keyword_scores() of given pairs (candidate_id, id) alone; texts: id, full_text."""
    words = tokens(F.concat_ws(" ", "relation_text", "head_text", "tail_text"))
    c = asked.select("candidate_id", "head", "tail", "preferred_sources", words.alias("asked_words"))
    e = evidence.select("id", "source", "reliability", "related_entities").join(texts, "id")
    rows = pairs.join(c, "candidate_id").join(e, "id")
    has = {s: F.coalesce(F.array_contains("related_entities", F.col(s)), F.lit(False)) for s in ("head", "tail")}
    preferred = F.coalesce(F.array_contains("preferred_sources", F.col("source")), F.lit(False))
    overlap = F.size(F.array_intersect("asked_words", tokens(F.col("full_text"))))
    score = weight(overlap, has["head"], has["tail"], preferred, F.col("reliability"))
    return rows.select("candidate_id", "id", F.bround(score, 4).cast("double").alias("retrieval_score"), has["head"].alias("has_head"), has["tail"].alias("has_tail"), preferred.alias("preferred"), "reliability")


def reasons(head: Column, tail: Column, preferred: Column, reliability: Column) -> Column:
    flags = [F.when(head, F.lit("contains_head")), F.when(tail, F.lit("contains_tail")), F.when(preferred, F.lit("preferred_source")), F.when(reliability >= 0.85, F.lit("high_reliability"))]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def top(scored: DataFrame, k: int, score: str = "retrieval_score") -> DataFrame:
    """The k best of every candidate, with retrieval_rank."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc(score), "id")
    return scored.withColumn("retrieval_rank", F.row_number().over(w)).where(F.col("retrieval_rank") <= k)


def keyword_rank(asked: DataFrame, evidence: DataFrame, entities: DataFrame, top_k: int) -> DataFrame:
    scored = top(keyword_scores(asked, evidence, entities, top_k), top_k)
    return scored.select("candidate_id", "id", "retrieval_score", reasons(F.col("has_head"), F.col("has_tail"), F.col("preferred"), F.col("reliability")).alias("retrieval_reasons"), "retrieval_rank")


def encode(texts: DataFrame, column: str, encoder: Encoder, out: str = "vector") -> DataFrame:
    """A vector for each text, by a model that every worker loads once (Arrow batches)."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    return texts.withColumn(out, run(F.col(column)))


def dense_recall(asked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(candidate_id, id, dense_score): the k of the corpus (id, vector) that are closest to each query (candidate_id, vector).

    The stated queries meet the corpus in blocks of both: each pair of blocks is one group of
    rows and keeps its k best of each query, so neither side is broadcast or held whole. Scores are
    rounded to six decimals; equal ones rank by id.
    """
    q, c = cut(asked.select("candidate_id", "vector"), "queries"), cut(corpus.select("id", "vector"), "vectors")
    n_q, n_c = (max(1, -(-df.count() // BLOCK)) for df in (q, c))
    own = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(own("candidate_id", n_q).alias("qb"), every(n_c).alias("cb"), F.col("candidate_id").alias("key"), "vector")
    right = c.select(every(n_q).alias("qb"), own("id", n_c).alias("cb"), F.col("id").alias("key"), "vector")
    out = StructType([StructField("candidate_id", q.schema["candidate_id"].dataType), StructField("id", c.schema["id"].dataType), StructField("dense_score", DoubleType())])

    def best(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not (qs.num_rows and cs.num_rows):
            return pa.table({"candidate_id": qs.column("key").slice(0, 0), "id": cs.column("key").slice(0, 0), "dense_score": pa.array([], pa.float64())})
        cs = cs.sort_by("key")
        a, b = (_units(t.column("vector")) for t in (qs, cs))
        scores = np.round(a @ b.T, 6)
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(a)), at.shape[1])
        return pa.table({"candidate_id": qs.column("key").take(pa.array(row)), "id": cs.column("key").take(pa.array(at.ravel())), "dense_score": pa.array(scores[row, at.ravel()])})

    scored = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(best, out)
    w = Window.partitionBy("candidate_id").orderBy(F.desc("dense_score"), "id")
    return scored.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; a vector of zeros stays."""
    v = np.array(vectors.to_pylist(), np.float64)
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def hybrid_rank(asked: DataFrame, evidence: DataFrame, entities: DataFrame, encoder: Encoder, reranker: Reranker, top_k: int) -> DataFrame:
    """Dense recall of max(4 * top_k, 20), reranked by a cross-encoder; score: rerank + dense + keyword."""
    wide = max(top_k * 4, 20)
    texts = evidence_texts(evidence, entities)
    corpus = cut(encode(texts, "full_text", encoder), "corpus")
    near = dense_recall(encode(asked.select("candidate_id", "query"), "query", encoder), corpus, wide)

    @F.pandas_udf("double")
    def rerank(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in pairs:
            yield reranker(q, t)

    near = cut(near, "near")
    keyword = pair_scores(near.select("candidate_id", "id"), asked, evidence, corpus.select("id", "full_text"))
    rows = near.join(asked.select("candidate_id", "query"), "candidate_id").join(corpus.select("id", "full_text"), "id").withColumn("rerank_score", rerank("query", "full_text")).join(keyword, ["candidate_id", "id"], "left")
    exact = [c.cast("decimal(18,6)") for c in (F.col("rerank_score"), F.col("dense_score"), F.coalesce("retrieval_score", F.lit(0.0)))]
    score = F.bround(exact[0] + exact[1] + exact[2], 4).cast("double")
    why = F.concat(F.coalesce(reasons(F.col("has_head"), F.col("has_tail"), F.col("preferred"), F.col("reliability")), F.array().cast("array<string>")), F.array(F.lit("dense_recall"), F.lit("cross_encoder_rerank")))
    ranked = rows.select("candidate_id", "id", score.alias("retrieval_score"), F.bround("dense_score", 6).alias("dense_score"), F.bround("rerank_score", 6).alias("rerank_score"), why.alias("retrieval_reasons"))
    return top(ranked, top_k)


def expand(initial: DataFrame, evidence: DataFrame, top_k: int) -> DataFrame:
    """Add evidence of the entities that the initial evidence names, up to 2 * top_k in all.

    Who finds a piece first counts: by initial rank, the entity's place, the order of loading; it gets 0.6 of that score.
    """
    mentions = links(evidence)
    named = evidence.select("id", F.posexplode("related_entities").alias("place", "entity_id"))
    steps = initial.select("candidate_id", "id", "retrieval_score", "retrieval_rank").join(named, "id").select("candidate_id", F.col("retrieval_score").alias("parent"), "retrieval_rank", "place", "entity_id")
    reached = steps.join(mentions.select("entity_id", F.col("evidence_id").alias("id"), "seq"), "entity_id").join(initial.select("candidate_id", "id"), ["candidate_id", "id"], "left_anti")
    way = [F.col(c) for c in ("retrieval_rank", "place", "seq")]
    once = reached.withColumn("n", F.row_number().over(Window.partitionBy("candidate_id", "id").orderBy(*way))).where("n = 1")
    have = initial.groupBy("candidate_id").agg(F.count("*").alias("have"))
    cut_off = once.withColumn("n", F.row_number().over(Window.partitionBy("candidate_id").orderBy(*way))).join(have, "candidate_id").where(F.col("n") <= F.greatest(F.lit(2 * top_k) - F.col("have"), F.lit(1)))
    added = cut_off.select("candidate_id", "id", F.bround(F.col("parent").cast("decimal(18,6)") * dec(F.lit("0.6")), 4).cast("double").alias("retrieval_score"), F.array(F.lit("expanded_from_related_entity"), F.col("entity_id")).alias("retrieval_reasons"))
    every = initial.select("candidate_id", "id", "retrieval_score", "retrieval_reasons", *[c for c in ("dense_score", "rerank_score") if c in initial.columns])
    return every.unionByName(added, allowMissingColumns=True)


def support_hint(head: Column, tail: Column) -> Column:
    return F.when(head & tail, "mentions_head_and_tail").when(head, "mentions_head").when(tail, "mentions_tail")


def split(asked: DataFrame, found: DataFrame, evidence: DataFrame) -> DataFrame:
    """found with the evidence's fields, role (support or conflict) and support_hint; what is neither is left out."""
    rows = found.join(evidence.drop("metadata", "seq"), "id").join(asked.select("candidate_id", "head", "tail"), "candidate_id")
    has = {s: F.coalesce(F.array_contains("related_entities", F.col(s)), F.lit(False)) for s in ("head", "tail")}
    against = F.arrays_overlap(tokens(F.col("text")), F.array(*map(F.lit, CONFLICT_WORDS)))
    role = F.when(against, "conflict").when(has["head"] | has["tail"], "support")
    return rows.withColumn("role", role).withColumn("support_hint", F.when(role == "support", support_hint(has["head"], has["tail"]))).where("role is not null")


CONTEXT_FIELDS = ["id", "source", "source_file", "source_row_id", "text", "related_entities", "timestamp", "reliability", "retrieval_score", "retrieval_reasons", "support_hint"]


def contexts(asked: DataFrame, found: DataFrame, kg: dict[str, DataFrame], top_k: int, dense: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """One context a candidate: query, metadata, profiles, graph path, supporting and conflicting evidence, packed text."""
    defaults = {"source": "", "source_file": "", "source_row_id": "", "text": "", "timestamp": ""}
    fields = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c == "reliability" else F.col(c) for c in CONTEXT_FIELDS]
    item = F.struct((-F.col("retrieval_score")).alias("order"), "id", F.struct(*fields).alias("item"))

    def listed(role: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, item))), lambda x: x["item"])

    grouped = split(asked, found, kg["evidence"]).groupBy("candidate_id").agg(listed("support").alias("support"), listed("conflict").alias("conflict"))
    counts = found.groupBy("candidate_id").agg(F.count("*").alias("expanded_evidence_count"), F.sum((F.element_at("retrieval_reasons", 1) != "expanded_from_related_entity").cast("int")).alias("initial_evidence_count"))
    c = asked.join(grouped, "candidate_id", "left").join(counts, "candidate_id", "left")
    profile = F.struct("id", "type", "name", "aliases", "properties")
    for side in ("head", "tail"):
        c = c.join(kg["entities"].select(F.col("id").alias(side), profile.alias(f"{side}_profile")), side, "left")
    c = c.join(paths.select("head", "tail", F.col("path").alias("graph_path")), ["head", "tail"], "left") if paths is not None else c.withColumn("graph_path", F.lit(None).cast("array<string>"))
    none = F.array().cast(grouped.schema["support"].dataType)
    support, conflict = F.coalesce("support", none), F.coalesce("conflict", none)
    meta = F.struct(
        F.lit("hybrid_dense_cross_encoder" if dense else "keyword_only").alias("mode"), F.lit(not dense).alias("degraded"), F.lit("" if dense else "keyword_only_explicitly_enabled_for_smoke").alias("fallback_reason"),
        "preferred_sources", F.lit(top_k).alias("top_k"), F.coalesce("initial_evidence_count", F.lit(0)).alias("initial_evidence_count"), F.coalesce("expanded_evidence_count", F.lit(0)).alias("expanded_evidence_count"),
    )
    packed = F.struct(
        F.lit("verify_candidate_relation").alias("task"), "relation", F.col("semantic_verification_criteria").alias("semantic_criteria"), F.concat_ws(" ", "head_text", "relation", "tail_text").alias("candidate_statement"),
        F.transform(support, lambda x: x["id"]).alias("supporting_evidence_ids"), F.transform(conflict, lambda x: x["id"]).alias("conflict_evidence_ids"),
    )
    return c.select(
        "candidate_id", "seq", "head", "relation", "tail", "candidate_score", "recall_sources", "debug", F.col("query").alias("relation_query"), meta.alias("retrieval_metadata"), "head_profile", "tail_profile",
        F.coalesce("graph_path", F.array().cast("array<string>")).alias("graph_path"), support.alias("support"), conflict.alias("conflict"), packed.alias("packed_context"),
    )


def retrieve(candidates: DataFrame, kg: dict[str, DataFrame], specs: DataFrame, top_k: int = 5, encoder: Encoder | None = None, reranker: Reranker | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Contexts of all candidates; dense with both models, else explicitly by keyword."""
    asked = cut(queries(candidates, kg["entities"], specs), "asked")
    dense = encoder is not None and reranker is not None
    initial = cut(hybrid_rank(asked, kg["evidence"], kg["entities"], encoder, reranker, top_k) if dense else keyword_rank(asked, kg["evidence"], kg["entities"], top_k), "initial")
    return contexts(asked, cut(expand(initial, kg["evidence"], top_k), "expanded"), kg, top_k, dense, paths)
