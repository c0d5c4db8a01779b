"""Queries on retrieval, decisions, verification, write-back and reports, each with its twin in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.config import Verification
from attestra.functions.text import error_class
from attestra.operators import metrics, reason, retrieval, verify, writeback
from attestra.plans import projection as P
from attestra.plans.projection import sql
from attestra.streaming import resume

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Retrieval tokens of a text in SQL.
TOKENS = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9_./:-]+'), list_filter(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_./:-]+'), lambda x: regexp_split_to_array(x, '[_./:-]+'))), lambda x: x <> '')))"

KEYWORD = f"""with q as (select item_id, unnest({TOKENS.format("text")}) as tok from benchmark),
d as (select doc_id, source, unnest({TOKENS.format("text")}) as tok from documents),
h as (select item_id, doc_id, count(*) as own from q join d using (tok) group by item_id, doc_id),
s as (select b.item_id, d.doc_id, round_even(cast(coalesce(h.own, 0) as decimal(18,6)) * 0.08 + case when d.source = 'src0' then 0.35 else 0.0 end + cast(case d.lang when 'en' then 0.9 else 0.6 end as decimal(12,6)) * 0.2, 4) as sc
from benchmark b cross join documents d left join h on h.item_id = b.item_id and h.doc_id = d.doc_id),
r as (select item_id, 'd' || doc_id as id, sc, row_number() over (partition by item_id order by sc desc, 'd' || doc_id) as k from s)
"""


def _corpus(t: P.Tables) -> DataFrame:
    """Documents as evidence that names nothing."""
    sure = F.when(F.col("lang") == "en", 0.9).otherwise(0.6)
    return t.documents.select(P.key("d", "doc_id").alias("id"), "source", "text", sure.alias("reliability"), F.array().cast("array<string>").alias("related_entities"), F.lit("").alias("timestamp"), F.col("doc_id").alias("seq"))


def _asked(t: P.Tables) -> DataFrame:
    """Benchmark items as candidates whose own words are the item's text."""
    return t.benchmark.select(F.col("item_id").cast("string").alias("candidate_id"), F.lit("none").alias("relation"), F.lit("").alias("relation_text"), F.array(F.lit("src0")).alias("preferred_sources"), F.lit("head").alias("head"), F.lit("tail").alias("tail"), F.col("text").alias("head_text"), F.lit("").alias("tail_text"))


def _plain_corpus(t: P.Tables) -> tuple[DataFrame, DataFrame]:
    """The corpus with its source out of the searched text, so words are those of the text alone."""
    e = _corpus(t)
    none = P.entities(t).limit(0)
    return e, none


@query("ret_keyword_topk", KEYWORD + "select cast(item_id as varchar) as candidate_id, id, cast(sc as double) as retrieval_score, k as retrieval_rank from r where k <= 5")
def _(s: SparkSession, d: str) -> DataFrame:
    t = P.Tables(s, d)
    scored = retrieval.keyword_scores(_asked(t), *_plain_corpus(t), top_k=5, text_only=True)
    return retrieval.top(scored, 5).select("candidate_id", "id", "retrieval_score", F.col("retrieval_rank").cast("long").alias("retrieval_rank"))


EXPAND = """&
c as (select o_orderkey as k, 'o' || o_orderkey as id from orders),
ini as (select c.id as candidate_id, c.id as id, 1.0 as sc from c),
rel as (select 'o' || o_orderkey as id, 'c' || o_custkey as entity_id, 0 as place from orders),
named as (select ini.candidate_id, rel.place, rel.entity_id from ini join rel on rel.id = ini.id),
hit as (select n.candidate_id, n.place, x.id, cast(substr(x.id, 2) as bigint) as seq, n.entity_id from named n join rel x on x.entity_id = n.entity_id where x.id <> n.candidate_id),
rk as (select *, row_number() over (partition by candidate_id order by place, seq) as k from hit)
"""


@query("ret_expand_capped", sql("v", EXPAND + "select candidate_id, id, 0.6 as retrieval_score, entity_id as via from rk where k <= 3 union all select candidate_id, id, 1.0, null from ini").replace("0.6 as", "cast(0.6 as double) as").replace("select candidate_id, id, 1.0, null", "select candidate_id, id, cast(1.0 as double), null"))
def _(s, d):
    t = P.Tables(s, d)
    e = t.orders.select(P.key("o", "o_orderkey").alias("id"), F.array(P.key("c", "o_custkey")).alias("related_entities"), F.col("o_orderkey").alias("seq"))
    first = e.select(F.col("id").alias("candidate_id"), "id", F.lit(1.0).alias("retrieval_score"), F.lit(1).alias("retrieval_rank"), F.array(F.lit("asked")).alias("retrieval_reasons"))
    got = retrieval.expand(first, e, 2)
    return got.select("candidate_id", "id", "retrieval_score", F.when(F.element_at("retrieval_reasons", 1) != "asked", F.element_at("retrieval_reasons", 2)).alias("via"))


SPLIT = f"""with r as (select doc_id, source, list_has_any({TOKENS.format('text')}, ['not', 'no', 'without', 'unknown', 'unassigned', 'unowned']) as against from documents)
select doc_id, case when against then 'conflict' else 'support' end as role, case when against then null when source = 'src0' then 'mentions_head' else 'mentions_tail' end as hint from r where against or source in ('src0', 'src1')"""


@query("ret_support_conflict_split", SPLIT)
def _(s, d):
    """Every document as evidence, that names its source, for a candidate between two sources."""
    t = P.Tables(s, d)
    e = _corpus(t).withColumn("related_entities", F.array("source"))
    asked = s.createDataFrame([("q", "src0", "src1")], "candidate_id string, head string, tail string")
    found = e.select(F.lit("q").alias("candidate_id"), "id", F.lit(1.0).alias("retrieval_score"))
    return retrieval.split(asked, found, e).select(F.substring("id", 2, 20).cast("long").alias("doc_id"), "role", F.col("support_hint").alias("hint"))


HAS = "select v.id, v.source, v.reliability, exists (select 1 from ve where ve.evidence_id = v.id and ve.entity_id = 's1') as h, exists (select 1 from ve where ve.evidence_id = v.id and ve.entity_id = 's2') as x from v"


def _flagged(s: SparkSession, d: str) -> DataFrame:
    e = P.evidence(P.Tables(s, d))
    return e.select("id", "source", "reliability", F.array_contains("related_entities", "s1").alias("h"), F.array_contains("related_entities", "s2").alias("x"))


@query("ret_reasons", sql("v ve", f"select id, concat_ws(',', case when h then 'contains_head' end, case when x then 'contains_tail' end, case when source = '1-URGENT' then 'preferred_source' end, case when reliability >= 0.85 then 'high_reliability' end) as reasons from ({HAS})"))
def _(s, d):
    f = _flagged(s, d)
    return f.select("id", F.array_join(retrieval.reasons(F.col("h"), F.col("x"), F.col("source") == "1-URGENT", F.col("reliability")), ",").alias("reasons"))


@query("ret_support_hint", sql("v ve", f"select id, case when h and x then 'mentions_head_and_tail' when h then 'mentions_head' when x then 'mentions_tail' end as hint from ({HAS}) where h or x"))
def _(s, d):
    return _flagged(s, d).where("h or x").select("id", retrieval.support_hint(F.col("h"), F.col("x")).alias("hint"))


PACK = EXPAND + """, f as (select candidate_id, id, 0.6 as sc from rk where k <= 3 union all select candidate_id, id, 1.0 from ini)
select f.candidate_id, 'customer c' || o.o_custkey || ' likely serves nation n0' as statement, string_agg(f.id, ',' order by f.sc desc, f.id) as support, count(*) filter (f.sc = 1.0) as initial, count(*) as expanded
from f join orders o on 'o' || o.o_orderkey = f.candidate_id group by f.candidate_id, o.o_custkey"""


@query("ret_context_pack", sql("v", PACK))
def _(s, d):
    """A candidate for every order: its customer and a nation; evidence is the order and what expansion adds."""
    t = P.Tables(s, d)
    none = F.lit("")
    o = t.orders.select(P.key("o", "o_orderkey").alias("id"), F.array(P.key("c", "o_custkey")).alias("related_entities"), F.col("o_orderkey").alias("seq"), P.key("c", "o_custkey").alias("head"))
    e = o.select("id", "related_entities", "seq", F.lit("order").alias("text"), none.alias("source"), none.alias("source_file"), none.alias("source_row_id"), none.alias("timestamp"), F.lit(0.8).alias("reliability"))
    asked = o.select(
        F.col("id").alias("candidate_id"), "seq", "head", F.lit("likely serves nation").alias("relation"), F.lit("n0").alias("tail"), F.concat(F.lit("customer "), "head").alias("head_text"), F.lit("n0").alias("tail_text"), none.alias("query"),
        F.lit(1.0).alias("candidate_score"), F.array().cast("array<string>").alias("recall_sources"), none.alias("debug"), F.array().cast("array<string>").alias("preferred_sources"), none.alias("semantic_verification_criteria"),
    )
    first = asked.select("candidate_id", F.col("candidate_id").alias("id"), F.lit(1.0).alias("retrieval_score"), F.lit(1).alias("retrieval_rank"), F.array(F.lit("asked")).alias("retrieval_reasons"))
    packed = retrieval.contexts(asked, retrieval.expand(first, e, 2), {"evidence": e, "entities": P.entities(t)}, 2)
    meta = F.col("retrieval_metadata")
    return packed.select("candidate_id", F.col("packed_context.candidate_statement").alias("statement"), F.array_join("packed_context.supporting_evidence_ids", ",").alias("support"), meta["initial_evidence_count"].cast("long").alias("initial"), meta["expanded_evidence_count"].cast("long").alias("expanded"))


COS = "list_sum(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(cast(a.embedding as double[]), lambda z: z * z))) * sqrt(list_sum(list_transform(cast(b.embedding as double[]), lambda z: z * z))))"
DENSE = f"with s as (select a.vec_id as q, b.vec_id as id, round_even({COS}, 6) as score from embeddings a cross join embeddings b where a.vec_id % 20 = 0), r as (select *, row_number() over (partition by q order by score desc, id) as k from s) "


@query("ret_dense_topk", DENSE + "select q, id, round_even(score, 4) as score from r where k <= 10")
def _(s, d):
    """The stated query set (every vector whose id is divisible by 20) against all vectors."""
    vectors = P.Tables(s, d).embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "candidate_id")
    return retrieval.dense_recall(asked, vectors, 10).select(F.col("candidate_id").alias("q"), "id", F.bround("dense_score", 4).alias("score"))


def _letters(texts: pd.Series) -> pd.Series:
    """A text's counts of five letters and a one."""
    return texts.map(lambda t: [float(t.count(c)) for c in "aeoxz"] + [1.0])


def _lengths(asked: pd.Series, texts: pd.Series) -> pd.Series:
    return (asked.str.len() % 7 + texts.str.len() % 5) / 10.0


VECTOR = "[" + ", ".join(f"cast(len({{0}}) - len(replace({{0}}, '{c}', '')) as double)" for c in "aeoxz") + ", 1.0::double]"
HYBRID = f"""with q as (select item_id, text, 'h t none  head  tail  preferred sources src0' as frame, {TOKENS.format("text")} as ws, {VECTOR.format("text")} as v from benchmark),
d as (select 'd' || doc_id as id, text || ' ' || source || '  ' as full_text, source, lang from documents),
e as (select *, {TOKENS.format("full_text")} as ws, {VECTOR.format("full_text")} as v from d),
s as (select q.item_id, e.id, round_even(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(q.v, lambda z: z * z))) * sqrt(list_sum(list_transform(e.v, lambda z: z * z)))), 6) as dense, len(q.text) as nq, len(e.full_text) as ne, len(list_intersect(q.ws, e.ws)) as own, e.source, e.lang from q cross join e),
r as (select *, row_number() over (partition by item_id order by dense desc, id) as k from s),
f as (select item_id, id, round_even(cast(dense as decimal(18,6)) + cast((nq % 7 + ne % 5) / 10.0 as decimal(18,6)) + cast(round_even(cast(own as decimal(18,6)) * 0.08 + case when source = 'src0' then 0.35 else 0.0 end + cast(case lang when 'en' then 0.9 else 0.6 end as decimal(12,6)) * 0.2, 4) as decimal(18,6)), 4) as sc from r where k <= 20),
z as (select *, row_number() over (partition by item_id order by sc desc, id) as place from f)
select cast(item_id as varchar) as q, id, cast(sc as double) as retrieval_score, place as retrieval_rank from z where place <= 5"""


@query("ret_hybrid_rank", HYBRID)
def _(s, d):
    """Every benchmark item against every document: dense recall by letter counts, reranked by lengths, and keywords."""
    t = P.Tables(s, d)
    asked = _asked(t).withColumn("query", F.col("head_text"))
    ranked = retrieval.hybrid_rank(asked, *_plain_corpus(t), _letters, _lengths, 5)
    return ranked.select(F.col("candidate_id").alias("q"), "id", "retrieval_score", F.col("retrieval_rank").cast("long").alias("retrieval_rank"))


@query(
    "reason_mock_v1",
    """with m as (select event_id, cast(least(1.0, value / 100.0) as decimal(12,6)) as sc, event_id % 3 <> 0 as ev, event_id % 4 <> 0 as pa, event_id % 5 = 0 as cn, event_type as ty from events),
n as (select *, least(0.95, sc + case when ev then 0.1 else 0.0 end) as raw from m),
a as (select *, ev and pa and (cn or sc >= 0.6) and raw >= 0.7 as acc from n)
select event_id, case when acc then 'accept' when ev or pa then 'uncertain' else 'reject' end as decision, cast(round_even(case when acc then raw when ev or pa then greatest(0.45, least(raw, 0.69)) else least(raw, 0.4) end, 3) as double) as confidence,
case when acc and ty = 'error' then 'ev_missing_mock' when not acc and not ev and not pa then '' when ev then 'x' || event_id || ',y' || event_id else '' end as cited from a""",
)
def _(s, d):
    e = P.Tables(s, d).events
    has = {n: F.col("event_id") % k for n, k in (("ev", 3), ("pa", 4), ("cn", 5))}
    ids = F.when(has["ev"] != 0, F.array(P.key("x", "event_id"), P.key("y", "event_id"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("event_type") == "error", "person").otherwise("team")
    p = reason.mock_decision(F.least(F.lit(1.0), F.col("value") / 100.0), ids, has["pa"] != 0, has["cn"] == 0, kind)
    return e.withColumn("p", p).select("event_id", "p.decision", "p.confidence", F.array_join("p.supporting_evidence_ids", ",").alias("cited"))


@query("reason_mock_v2", "select o_orderkey, case when n > 1 and o_orderstatus <> 'P' then 'accept' else 'uncertain' end as decision, cast(case when n > 1 and o_orderstatus <> 'P' then 0.86 else 0.45 end as double) as confidence from (select o_orderkey, o_orderstatus, (select count(*) from lineitem where l_orderkey = o_orderkey) as n from orders)")
def _(s, d):
    t = P.Tables(s, d)
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    p = reason.mock_reply(F.when(F.coalesce("n", F.lit(0)) > 1, F.array(F.lit("a"))).otherwise(none), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("b"))).otherwise(none))
    return o.withColumn("p", p).select("o_orderkey", "p.decision", "p.confidence")


@query("reason_parse_normalize", "select event_id, case when event_type in ('click', 'error') then case event_type when 'click' then 'accept' else 'reject' end when event_type = 'purchase' then 'uncertain' end as decision, case when event_type in ('click', 'error', 'purchase') then least(1.0, (event_id % 1500) / 1000.0) end as confidence, case when event_type in ('click', 'error', 'purchase') then 'k' || event_id end as cited from events")
def _(s, d):
    kind = F.col("event_type")
    said = F.when(kind == "click", "ACCEPT").when(kind == "error", "reject").otherwise("maybe")
    body = F.concat(F.lit('{"decision": "'), said, F.lit('", "confidence": '), ((F.col("event_id") % 1500) / 1000.0).cast("string"), F.lit(', "supporting_evidence_ids": ["k'), F.col("event_id").cast("string"), F.lit('"], "reason": 5}'))
    reply = F.when(kind == "click", body).when(kind == "view", F.lit("no object here")).when(kind == "signup", F.lit("{broken")).otherwise(F.concat(F.lit("Sure:\n"), body, F.lit("\nDone.")))
    e = P.Tables(s, d).events.withColumn("p", reason.normalised(reply, F.lit("r")))
    return e.select("event_id", "p.decision", "p.confidence", F.when(F.col("p").isNotNull(), F.array_join("p.supporting_evidence_ids", ",")).alias("cited"))


@query("reason_error_class", "select event_id, case event_type when 'click' then 'timeout' when 'view' then 'parse_failure' when 'error' then 'provider_error' when 'signup' then '' else 'reasoner_error' end as kind from events")
def _(s, d):
    said = F.when(F.col("event_type") == "click", "The read TIMED OUT").when(F.col("event_type") == "view", "no JSON object found").when(F.col("event_type") == "error", "Missing API key").when(F.col("event_type") == "signup", "").otherwise("boom")
    return P.Tables(s, d).events.select("event_id", error_class(said).alias("kind"))


FAIL = "&base as (select *, decision = 'accept' and cast(confidence as decimal(12,6)) < 0.7 as weak from pr), w as (select *, min(case when decision = 'accept' and schema_ok and grounded and not weak then seq end) over (partition by head, relation, tail) as taken from base), f as (select *, coalesce(taken < seq, false) as dup from w) "


@query("verify_v1", sql("pr", FAIL + "select seq, case when not schema_ok then 'reject' when not grounded then 'reject' when dup then 'reject' when weak then 'uncertain' else decision end as final_decision, case when schema_ok and grounded and not dup and not weak then 'passed' else 'failed' end as verifier_status from f"))
def _(s, d):
    return verify.single_relation(P.predictions(P.Tables(s, d)), Verification()).select("seq", "final_decision", "verifier_status")


def _hard(s: SparkSession, d: str) -> DataFrame:
    p = P.predictions(P.Tables(s, d))
    ids = F.when(F.col("backed"), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return verify.hard(p.select("*", ids.alias("supporting_evidence_ids"), F.when(F.col("grounded"), F.array().cast("array<string>")).otherwise(F.array(F.lit("lost"))).alias("conflict_evidence_ids"), F.array(F.lit("a")).alias("context_ids")))


HARD = "&base as (select *, decision <> 'accept' or cast(confidence as decimal(12,6)) >= 0.7 as sure, decision <> 'accept' or backed as proof from pr), w as (select *, min(case when decision = 'accept' and schema_ok and grounded and sure and proof then seq end) over (partition by head, relation, tail) as taken from base), f as (select *, schema_ok and grounded and sure and proof and not coalesce(taken < seq, false) as ok from w) "


@query("verify_hard", sql("pr", HARD + "select seq, case when ok then 'passed' else 'failed' end as status, sure as confidence, proof as accept_has_evidence, not coalesce(taken < seq, false) as conflict from f"))
def _(s, d):
    return _hard(s, d).select("seq", "hard_verifier.status", "hard_verifier.confidence", "hard_verifier.accept_has_evidence", "hard_verifier.conflict")


SEM = "&sm as (select 'o' || o_orderkey as id, o_orderkey % 2 = 0 as both_ends, o_orderpriority in ('1-URGENT', '2-HIGH') as speaks, o_orderstatus = 'P' as against, o_orderkey % 3 <> 0 as acc from orders) "


@query("verify_semantic", sql("v", SEM + "select id, case when not acc then 'not_supported' when against then 'conflicted' when both_ends and speaks then 'supported' when both_ends then 'partially_supported' else 'not_supported' end as support_status from sm"))
def _(s, d):
    o = P.Tables(s, d).orders
    text = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "was REVIEWED by them").otherwise("seen")
    item = F.struct(F.lit("e").alias("id"), text.alias("text"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("h"), F.lit("t"))).otherwise(F.array(F.lit("h"))).alias("related_entities"))
    against = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    rows = o.select(P.key("o", "o_orderkey").alias("id"), F.lit("owned_by").alias("asked_relation"), F.lit("h").alias("head"), F.lit("t").alias("tail"), F.when(F.col("o_orderkey") % 3 != 0, "accept").otherwise("reject").alias("decision"), F.array(F.lit("e")).alias("supporting_evidence_ids"), against.alias("conflict_evidence_ids"), F.array(item).alias("support"))
    return verify.semantic(rows).select("id", "semantic_verifier.support_status")


FOLD = HARD + ", z as (select *, ok and decision = 'accept' and seq % 2 = 0 as good from f) "


def _folded(s: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.lit("a").alias("id"), F.lit("the team").alias("text"), F.when(F.col("seq") % 2 == 0, F.array("head", "tail")).otherwise(F.array("head")).alias("related_entities"))
    rows = _hard(s, d).withColumn("asked_relation", F.lit("owned_by")).withColumn("support", F.array(item)).withColumn("conflict_evidence_ids", F.array().cast("array<string>"))
    return verify.fold(verify.semantic(rows))


@query("verify_final_fold", sql("pr", FOLD + "select seq, case when decision = 'accept' and not good then 'reject' else decision end as decision from z"))
def _(s, d):
    return _folded(s, d).select("seq", "decision")


EDGE = "&ok as (select * from pr where decision = 'accept' and schema_ok), x as (select *, first_value(tail) over (partition by head, relation order by seq) as ft, row_number() over (partition by head, relation, tail order by seq) as rn from ok), o as (select *, case when head in ('u1', 'u2') and relation = 'click' then case when tail = 'k0' then 'skipped_duplicate' else 'skipped_conflict' end when tail <> ft then 'skipped_conflict' when rn > 1 then 'skipped_duplicate' else 'written' end as outcome from x) "


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = P.predictions(P.Tables(s, d)).withColumn("verifier_status", F.when(F.col("schema_ok"), "passed").otherwise("failed"))
    have = s.createDataFrame([("u1", "click", "k0"), ("u2", "click", "k0")], "head string, relation string, tail string")
    return writeback.edge_decisions(p, have), have


@query("wb_edge_writer", sql("pr", EDGE + "select seq, head, relation, tail, outcome from o"))
def _(s, d):
    return _edges(s, d)[0].select("seq", "head", "relation", "tail", "outcome")


@query("wb_edge_report", sql("pr", EDGE + "select count(*) filter (outcome = 'written') as pending, cast(0 as bigint) as approved, count(*) filter (outcome = 'skipped_duplicate') as skipped_duplicate, count(*) filter (outcome = 'skipped_conflict') as skipped_conflict, count(*) filter (outcome = 'written') as written_count from o"))
def _(s, d):
    return writeback.edge_report(_edges(s, d)[0])


PEND = FOLD + ", p as (select * from (select *, row_number() over (partition by head, relation, tail order by seq) as rn from z where good) where rn = 1) "


def _pending(s: SparkSession, d: str) -> DataFrame:
    none = s.createDataFrame([], "head string, relation string, tail string")
    rows = _folded(s, d).withColumn("reason", F.lit("")).withColumn("recall_sources", F.array().cast("array<string>"))
    return writeback.pending(rows, none).drop("created_at")


@query("wb_pending", sql("pr", PEND + "select seq, head, relation, tail, confidence from p"))
def _(s, d):
    return _pending(s, d).select("seq", "head", "relation", "tail", "confidence")


REVIEW = PEND + ", rv as (select *, case when seq % 5 = 0 then null when seq % 3 = 0 then 'rejected' else 'approved' end as review from p) "


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    p = _pending(s, d)
    none = s.createDataFrame([], "head string, relation string, tail string")
    first = p.select("candidate_id", F.lit("rejected").alias("decision"), F.lit(1).alias("seq"), F.col("seq").alias("n"))
    last = p.select("candidate_id", F.when(F.col("seq") % 3 == 0, "rejected").otherwise("approved").alias("decision"), F.lit(2).alias("seq"), F.col("seq").alias("n"))
    return writeback.review(p, first.unionByName(last).where("n % 5 <> 0"), none)


@query("wb_review_apply", sql("pr", REVIEW + "select seq, case when review is null then 'skipped' else review end as outcome, row_number() over (order by seq) as place from rv"))
def _(s, d):
    return _reviewed(s, d).select("seq", "outcome", F.col("place").cast("long").alias("place"))


@query("wb_enriched_union", sql("pr", REVIEW + "select 'enriched_' || lpad(cast(place as varchar), 6, '0') || '_' || seq as id, head, relation, tail from (select *, row_number() over (order by seq) as place from rv) where review = 'approved' union all select 'n1', 'n1', 'in_region', 'r1'"))
def _(s, d):
    have = s.createDataFrame([("n1", "n1", "in_region", "r1")], "id string, head string, relation string, tail string")
    return writeback.enriched(have, writeback.approved_edges(_reviewed(s, d))).select("id", "head", "relation", "tail")


PRF = "select round_even(h / p, 4) as precision, round_even(h / g, 4) as recall, round_even(2 * (h / p) * (h / g) / (h / p + h / g), 4) as f1, h as hit_count, p as predicted_edge_count, g as gold_count from (select (select count(distinct doc_id) from documents where lang = 'en') as p, (select count(distinct doc_id) from labels where quality = 1) as g, (select count(distinct doc_id) from documents join labels using (doc_id) where lang = 'en' and quality = 1) as h)"


@query("eval_prf", PRF)
def _(s, d):
    t = P.Tables(s, d)
    return metrics.prf(t.documents.where("lang = 'en'"), t.labels.where("quality = 1"), ["doc_id"])


@query("eval_v2_report", sql("pr", HARD + "select count(*) filter (ok) as hard_pass_count, count(*) filter (not ok) as hard_fail_count, count(*) filter (ok and decision = 'accept' and seq % 2 = 0) as semantic_supported_count, count(*) filter (not (ok and decision = 'accept' and seq % 2 = 0)) as semantic_not_supported_count, count(*) filter (false) as semantic_conflicted_count from f"))
def _(s, d):
    return metrics.verifier_report(_folded(s, d))


@query("eval_decisions", sql("pr", FAIL + "select count(*) as candidate_count, count(*) filter (d2 = 'accept') as accepted_count, count(*) filter (d2 = 'reject') as rejected_count, count(*) filter (d2 = 'uncertain') as uncertain_count, round_even(count(*) filter (ok) / count(*), 4) as verifier_pass_rate, round_even(cast(sum(cast(confidence as decimal(12,6))) as double) / count(*), 4) as average_confidence from (select *, schema_ok and grounded and not dup and not weak as ok, case when not schema_ok or not grounded or dup then 'reject' when weak then 'uncertain' else decision end as d2 from f)"))
def _(s, d):
    v = verify.single_relation(P.predictions(P.Tables(s, d)), Verification())
    return metrics.decision_report(v.drop("decision").withColumnRenamed("final_decision", "decision"))


@query("eval_risk_stats", sql("pr", "select count(*) filter (decision = 'accept') - count(distinct case when decision = 'accept' then head || '|' || relation || '|' || tail end) as duplicate_accept_count, count(*) filter (decision = 'accept' and not schema_ok) as schema_violation_count, count(*) filter (decision = 'accept' and confidence < 0.7) as low_confidence_accept_count, count(*) filter (not grounded) as invalid_citation_count from pr"))
def _(s, d):
    p = P.predictions(P.Tables(s, d)).withColumn("supporting_evidence_ids", F.array(F.when(F.col("grounded"), "known").otherwise("lost")))
    return metrics.risks(p, s.createDataFrame([("known",)], "id string"))


@query("eval_counts_by_relation", sql("pr", "select relation, count(*) as candidate_count from pr group by relation"))
def _(s, d):
    return metrics.by_relation(P.predictions(P.Tables(s, d)))


@query("d_precision_coverage", "with x as (select round_even(n_chars / 10000, 2) as confidence, quality from documents join labels using (doc_id)), l as (select confidence, count(*) as n, sum(quality) as h from x group by confidence), c as (select confidence, sum(n) over (order by confidence desc) as accepted, sum(h) over (order by confidence desc) as hits from l) select confidence, cast(accepted as bigint) as accepted, cast(hits as bigint) as hits, round_even(accepted / (select count(*) from x), 4) as coverage, round_even(hits / accepted, 4) as precision from c")
def _(s, d):
    t = P.Tables(s, d)
    x = t.documents.join(t.labels, "doc_id").select(metrics.half_even(F.col("n_chars") / 10000, 2).alias("confidence"), F.col("quality").alias("is_gold"))
    return metrics.coverage_curve(x)


@query("stream_resume_dedup", sql("pr", "select seq, decision from pr where seq % 4 <> 0"))
def _(s, d):
    p = P.predictions(P.Tables(s, d))
    return resume.remaining(p, p.where("seq % 4 = 0"), ["seq"]).select("seq", "decision")
