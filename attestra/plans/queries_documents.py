"""Queries on document-level operators and the designed extensions, each with its twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.text import tokens
from attestra.operators import documents, mining
from attestra.plans import projection as P
from attestra.plans.queries_decide import TOKENS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("doc_sentences", "select 'sent_d' || doc_id || '_' || lpad(cast(i as varchar), cast(greatest(3, len(cast(i as varchar))) as integer), '0') as id, doc_id, len(s) as n_chars from (select doc_id, unnest(range(0, len(ls))) as i, unnest(ls) as s from (select doc_id, string_split(text, chr(10)) as ls from documents))")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = P.Tables(s, d).documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))
    return rows.select(F.concat(F.lit("sent_d"), F.col("doc_id").cast("string"), F.format_string("_%03d", "i")).alias("id"), "doc_id", F.length("s").cast("long").alias("n_chars"))


@query(
    "doc_mentions_fold",
    """with m as (select user_id as pos, event_id % 5 as ent, event_id as men, event_type as name, case when event_type = 'view' then 'UNKNOWN' else event_type end as type from events),
f as (select pos, ent, arg_min(type, men) filter (type <> 'UNKNOWN') as first from m group by pos, ent),
a as (select pos, ent, string_agg(name, ',' order by men) as aliases from (select pos, ent, name, min(men) as men from m group by pos, ent, name) group by pos, ent)
select m.pos, m.ent, coalesce(f.first, 'UNKNOWN') as type, a.aliases, count(*) filter (m.type <> 'UNKNOWN' and m.type <> f.first) as conflicts from m join f on f.pos = m.pos and f.ent = m.ent join a on a.pos = m.pos and a.ent = m.ent group by m.pos, m.ent, f.first, a.aliases""",
)
def _(s, d):
    e = P.Tables(s, d).events
    m = e.select(F.col("user_id").alias("pos"), (F.col("event_id") % 5).alias("ent"), F.col("event_id").alias("men"), F.col("event_type").alias("name"), F.lit(0).alias("sent_id"), F.array(F.lit(0)).alias("at"), F.when(F.col("event_type") == "view", "UNKNOWN").otherwise(F.col("event_type")).alias("type"))
    return documents.fold_mentions(m).select("pos", "ent", "type", F.array_join("aliases", ",").alias("aliases"), F.size("type_conflicts").cast("long").alias("conflicts"))


STATUS = "case event_type when 'view' then 'missing' when 'click' then 'empty' when 'error' then 'invalid' else 'present' end"


@query(
    "doc_label_merge",
    f"""with l as (select user_id as pos, event_id % 4 as h, event_id as label, event_id % 10 as idx, {STATUS} as status from events),
v as (select pos, h, string_agg(cast(idx as varchar), ',' order by idx) as evidence from (select distinct pos, h, idx from l where status in ('present', 'invalid')) group by pos, h)
select l.pos, l.h, min(label) as first, max(case status when 'missing' then 0 when 'empty' then 1 when 'present' then 2 else 3 end) as rank, count(*) as labels, coalesce(v.evidence, '') as evidence from l left join v on v.pos = l.pos and v.h = l.h group by l.pos, l.h, v.evidence""",
)
def _(s, d):
    status = F.when(F.col("event_type") == "view", "missing").when(F.col("event_type") == "click", "empty").when(F.col("event_type") == "error", "invalid").otherwise("present")
    valid = F.when(status.isin("present", "invalid"), F.array((F.col("event_id") % 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    labels = P.Tables(s, d).events.select(F.col("user_id").alias("pos"), (F.col("event_id") % 4).alias("h"), F.col("event_id").alias("label"), status.alias("status"), valid.alias("valid"), F.col("props").alias("raw"))
    m = documents.merge_labels(labels, ["pos", "h"])
    return m.select("pos", "h", "first", (F.array_position(F.array(*map(F.lit, documents.STATUS)), F.col("status")) - 1).cast("int").alias("rank"), F.size("raws").cast("long").alias("labels"), F.array_join("evidence_sent_ids", ",").alias("evidence"))


@query("doc_evidence_status", "select event_id, case event_type when 'view' then 'missing' when 'click' then 'empty' when 'error' then 'invalid' when 'signup' then 'invalid' else case when k < 50 then 'present' else 'invalid' end end as status, case when event_type = 'purchase' then case when k < 50 then case when k < 3 then cast(k as varchar) || ',3' when k = 3 then '3' else '3,' || k end else '3' end else '' end as valid from (select *, cast(regexp_extract(props, '[0-9]+') as bigint) as k from events)")
def _(s, d):
    k = F.regexp_extract("props", "[0-9]+", 0)
    kind = F.col("event_type")
    body = F.when(kind == "click", F.lit('{"evidence": []}')).when(kind == "error", F.lit('{"evidence": "x"}')).when(kind == "signup", F.lit('{"evidence": [true]}')).when(kind == "purchase", F.concat(F.lit('{"evidence": ['), k, F.lit(", 3, 3]}"))).otherwise(F.lit("{}"))
    v = F.try_parse_json(body)
    e = documents.evidence_status(documents.get(v, "evidence"), documents.has(v, "evidence"), F.lit(50))
    return P.Tables(s, d).events.withColumn("e", e).select("event_id", "e.status", F.array_join("e.valid", ",").alias("valid"))


@query("doc_stats", f"select {STATUS} as status, count(*) as n, count(distinct user_id) as documents from events group by 1")
def _(s, d):
    status = F.when(F.col("event_type") == "view", "missing").when(F.col("event_type") == "click", "empty").when(F.col("event_type") == "error", "invalid").otherwise("present")
    return P.Tables(s, d).events.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("documents"))


@query("doc_schema_keys", "select 'k' as key, min(event_id) as first from events")
def _(s, d):
    e = P.Tables(s, d).events
    keys = e.select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.min("event_id").alias("first"))


@query(
    "d_neg_sampling",
    """with pos as (select d.doc_id, d.lang from documents d join labels l using (doc_id) where quality = 1 and toxic = 1),
m as (select lang, count(*) * 2 as most from pos group by lang),
f as (select d.doc_id, d.lang, most, row_number() over (partition by d.lang order by md5(cast(d.doc_id as varchar)), d.doc_id) as n from documents d join m on m.lang = d.lang where d.doc_id not in (select doc_id from pos))
select doc_id, lang from f where n <= most""",
)
def _(s, d):
    t = P.Tables(s, d)
    pos = t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1 and toxic = 1").select("doc_id"), "doc_id")
    return mining.sample_negatives(t.documents.select("doc_id", "lang"), pos, "lang", "doc_id", 2).select("doc_id", "lang")


@query(
    "d_bm25",
    f"""with q as (select item_id as q, unnest({TOKENS.format("text")}) as word from benchmark),
c as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents),
tf as (select id, word, count(*) as tf from c group by id, word), size as (select id, count(*) as size from c group by id),
tot as (select count(*) as docs, avg(size) as mean from size), df as (select word, count(*) as df from tf group by word),
sc as (select q, tf.id, round_even(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 4) as score from q join df using (word) join tf using (word) join size on size.id = tf.id cross join tot group by q, tf.id)
select q, id, score from (select *, row_number() over (partition by q order by score desc, id) as k from sc) where k <= 5""",
)
def _(s, d):
    t = P.Tables(s, d)
    q = t.benchmark.select(F.col("item_id").alias("q"), F.explode(tokens(F.col("text"))).alias("word"))
    c = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    scored = mining.bm25(q, c)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("k", F.row_number().over(w)).where("k <= 5").select("q", "id", "score")


@query(
    "d_bridge",
    """with m as (select distinct o_custkey as doc, o_orderkey as sent, 's' || l_suppkey as s, 'p' || l_partkey as p from orders join lineitem on l_orderkey = o_orderkey),
a as (select distinct x.doc, x.sent, x.s, y.p from m x join m y on x.doc = y.doc and x.sent = y.sent)
select distinct h.doc, h.s as head, t.s as tail, h.p as bridge from a h join a t on h.doc = t.doc and h.p = t.p and h.sent <> t.sent and h.s <> t.s""",
)
def _(s, d):
    t = P.Tables(s, d)
    m = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("sent"), F.explode(F.array(P.key("s", "l_suppkey"), P.key("p", "l_partkey"))).alias("entity")).distinct()
    sup, par = (m.where(F.col("entity").startswith(x)).select("entity").distinct() for x in "sp")
    return mining.bridges(m, sup, sup, par)


@query("d_evidence_prf", "with l as (select distinct l_orderkey as o, l_linenumber as n, l_quantity > 25 as p, l_returnflag = 'R' as g from lineitem), x as (select o, n, bool_or(p) as p, bool_or(g) as g from l group by o, n), c as (select count(*) filter (p and g) as h, count(*) filter (p) as np, count(*) filter (g) as ng from x) select h as hits, round_even(h / np, 4) as precision, round_even(h / ng, 4) as recall, round_even(2 * (h / np) * (h / ng) / (h / np + h / ng), 4) as f1 from c")
def _(s, d):
    line = F.col("l_linenumber")
    none = F.array().cast("array<int>")
    rows = P.Tables(s, d).lineitem.groupBy("l_orderkey").agg(F.coalesce(F.collect_set(F.when(F.col("l_quantity") > 25, line)), none).alias("p"), F.coalesce(F.collect_set(F.when(F.col("l_returnflag") == "R", line)), none).alias("g"))
    return mining.evidence_prf(rows, "p", "g")
