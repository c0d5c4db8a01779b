"""Queries on lookups, traversal and candidates, each with its twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.config import Relation, relation_table
from attestra.functions.text import attribute_tokens, entity_id, normal, tokens
from attestra.operators import candidates, checks, graph, routes
from attestra.operators.ingest import fold_entities, lookup
from attestra.plans import projection as P
from attestra.plans.projection import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def joined(c: str):
    return F.array_join(c, ",")


@query("kg_entities_by_type", sql("e", "select id, name from e where type in ('nation', 'supplier')"))
def _(s: SparkSession, d: str) -> DataFrame:
    return graph.by_types(P.entities(P.Tables(s, d)), ["nation", "supplier"]).select("id", "name")


@query("kg_entity_lookup", sql("e", "select id, type, name from e where id = 's7'"))
def _(s, d):
    return graph.by_id(P.entities(P.Tables(s, d)), "s7").select("id", "type", "name")


@query("kg_search_entities", sql("e", "select id from e where trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') = 'customer_000000012'"))
def _(s, d):
    return graph.search(P.entities(P.Tables(s, d)), " Customer 000000012").select("id")


@query("kg_triples_build", sql("t", "select head, relation, tail from t"))
def _(s, d):
    return P.triples(P.Tables(s, d)).select("head", "relation", "tail")


@query("kg_pk_violations", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def _(s, d):
    return checks.duplicate_keys(P.Tables(s, d).lineitem, "l_orderkey", "l_linenumber")


@query("kg_fk_violations", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(s, d):
    t = P.Tables(s, d)
    return checks.orphans(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey")


@query("kg_triples_between", sql("t", "select head, relation, tail from t where (head = 's7' and tail = 'n1') or (head = 'n1' and tail = 's7') or (head = 's7' and relation = 'in_nation')"))
def _(s, d):
    t = P.triples(P.Tables(s, d))
    own = t.where("head = 's7' and relation = 'in_nation'")
    return graph.between(t, "s7", "n1", both=True).unionByName(own).select("head", "relation", "tail").distinct()


@query("kg_related_triples", sql("t", "select head, relation, tail from t where head = 'n3' union all select head, relation, tail from t where tail = 'n3'"))
def _(s, d):
    return graph.related(P.triples(P.Tables(s, d)), "n3").select("head", "relation", "tail")


@query("kg_triples_for_entities", sql("t e", "select distinct head, relation, tail from t where head in (select id from e where type = 'region') or tail in (select id from e where type = 'region')"))
def _(s, d):
    t = P.Tables(s, d)
    return graph.at_entities(P.triples(t), P.entities(t).where("type = 'region'")).select("head", "relation", "tail")


@query("kg_has_edge", sql("t", "select distinct 's' || l_suppkey as head, 'supplies' as relation, 'p' || (l_partkey + 1) as tail from lineitem where exists (select 1 from t where head = 's' || l_suppkey and relation = 'supplies' and tail = 'p' || (l_partkey + 1))"))
def _(s, d):
    """Of every supplier's parts: does it supply the part after it, too?"""
    t = P.Tables(s, d)
    pairs = t.lineitem.select(P.key("s", "l_suppkey").alias("head"), F.lit("supplies").alias("relation"), F.concat(F.lit("p"), (F.col("l_partkey") + 1).cast("string")).alias("tail")).distinct()
    return graph.existing(pairs, P.triples(t), keep=True)


for _name, _dir, _body in (
    ("kg_neighbors_out", "out", "select distinct head as entity, tail as neighbor from t where relation = 'in_nation'"),
    ("kg_neighbors_in", "in", "select distinct tail as entity, head as neighbor from t where relation = 'in_nation'"),
    ("kg_neighbors_both", "both", "select head as entity, tail as neighbor from t where relation = 'in_nation' union select tail, head from t where relation = 'in_nation'"),
):
    query(_name, sql("t", _body))(lambda s, d, way=_dir: graph.neighbors(P.triples(P.Tables(s, d)), way, "in_nation"))


@query("kg_common_neighbors", sql("t u e", "select h.a as head, x.a as tail, count(*) as n, string_agg(h.b, ',' order by h.b) as common from u h join u x on h.b = x.b and h.a <> x.a join e eh on eh.id = h.a and eh.type = 'customer' join e et on et.id = x.a and et.type = 'supplier' group by h.a, x.a"))
def _(s, d):
    t = P.Tables(s, d)
    e = P.entities(t)
    return graph.common_neighbors(graph.neighbors(P.triples(t)), e.where("type = 'customer'"), e.where("type = 'supplier'")).select("head", "tail", F.size("common").cast("long").alias("n"), joined("common").alias("common"))


@query(
    "kg_shortest_path_len",
    sql("t u e", """&
g as (select a, b from u),
h1 as (select g.a as head, g.b as loc from g join e on e.id = g.a and e.type = 'region'),
h2 as (select distinct head, g.b as loc from h1 join g on g.a = h1.loc),
h3 as (select distinct head, g.b as loc from h2 join g on g.a = h2.loc),
every as (select head, loc as tail, 1 as hops from h1 union all select head, loc, 2 from h2 union all select head, loc, 3 from h3)
select head, tail, min(hops) as hops from every join e on e.id = tail and e.type in ('nation', 'supplier') where head <> tail group by head, tail"""),
)
def _(s, d):
    t = P.Tables(s, d)
    e = P.entities(t)
    return graph.reachable(graph.ranked_edges(P.triples(t)), e.where("type = 'region'").select("id"), e.where("type in ('nation', 'supplier')").select("id"))


@query(
    "kg_simple_paths_le3",
    sql("t u e", """&
g as (select a, b from u),
w as (select id as head, id as loc, [id] as path from e where type = 'nation' union all select w.head, g.b, list_append(w.path, g.b) from w join g on g.a = w.loc where len(w.path) <= 3 and not list_contains(w.path, g.b))
select head, loc as tail, len(path) - 1 as hops, array_to_string(path, '>') as path from w join e on e.id = loc and e.type = 'nation' where len(path) > 1""", recursive=True),
)
def _(s, d):
    t = P.Tables(s, d)
    e = P.entities(t).where("type = 'nation'").select("id")
    return graph.simple_paths(graph.ranked_edges(P.triples(t)), e, e).select("head", "tail", F.col("hops").cast("long").alias("hops"), F.array_join("path", ">").alias("path"))


def _ends(t: P.Tables, spark: SparkSession):
    specs = P.relations(spark).where("relation = 'serves'")
    return specs, tuple(routes.legal_ends(P.entities(t), specs, side) for side in ("head", "tail"))


SHARED = "select h.entity_id as head, x.entity_id as tail, h.evidence_id from ve h join ve x on h.evidence_id = x.evidence_id where h.entity_id[1] = 's' and x.entity_id[1] = 'c'"


@query("kg_evidence_cooccurrence", sql("ve", f"select head, tail, count(*) as n, cast(least(0.5, 0.18 + 0.08 * count(*)) as double) as score from ({SHARED}) group by head, tail"))
def _(s, d):
    t = P.Tables(s, d)
    _, ends = _ends(t, s)
    return routes.by_cooccurrence(routes.shared_evidence(P.evidence(t), ends)).select("head", "tail", F.col("evidence_count").cast("long").alias("n"), F.col("score").cast("double").alias("score"))


@query("kg_source_specific", sql("ve v", f"select head, tail, cast(least(0.75, 0.45 + 0.1 * count(*)) as double) as score, string_agg(distinct source, ',' order by source) as source_hits from ({SHARED}) x join v on v.id = x.evidence_id where source in ('1-URGENT', '2-HIGH') and text like '%order%' group by head, tail"))
def _(s, d):
    t = P.Tables(s, d)
    _, ends = _ends(t, s)
    shared = routes.shared_evidence(P.evidence(t), ends)
    facts = P.evidence(t).where("source in ('1-URGENT', '2-HIGH')").withColumn("source", F.col("source"))
    return routes.by_source(shared, facts, {"serves": (["1-URGENT", "2-HIGH"], ["order"])}).select("head", "tail", F.col("score").cast("double").alias("score"), joined("source_hits").alias("source_hits"))


@query(
    "kg_attribute_jaccard",
    sql("e", """&
w as (select id, type, list_filter(list_distinct(regexp_extract_all(lower(id || ' ' || name), '[a-z0-9]+')), lambda x: x not in ('svc', 'team', 'app', 'ip', 'host', 'prod')) as ts from e where type in ('supplier', 'customer')),
x as (select id, type, len(ts) as n, unnest(ts) as tok from w)
select a.id as head, b.id as tail, count(*) as shared, round_even(count(*) / (a.n + b.n - count(*)), 4) as jaccard
from x a join x b on a.tok = b.tok and a.type = 'supplier' and b.type = 'customer' group by a.id, b.id, a.n, b.n"""),
)
def _(s, d):
    """Every supplier against every customer."""
    e = P.entities(P.Tables(s, d))
    found = routes.attribute_overlap(e, e.where("type = 'supplier'").select("id"), e.where("type = 'customer'").select("id"))
    return found.select("head", "tail", F.size("shared").cast("long").alias("shared"), F.bround("jaccard", 4).alias("jaccard"))


@query("kg_schema_pairs_anti_existing", sql("t e", "select h.id as head, x.id as tail from e h join e x on h.type = 'supplier' and x.type = 'nation' where not exists (select 1 from t where t.head = h.id and t.relation = 'in_nation' and t.tail = x.id)"))
def _(s, d):
    """All legal pairs of a relation whose tails are few, without those that exist."""
    t = P.Tables(s, d)
    specs = s.createDataFrame([("in_nation", ["supplier"], ["nation"])], "relation string, head_types array<string>, tail_types array<string>")
    pairs = routes.legal_pairs(tuple(routes.legal_ends(P.entities(t), specs, side) for side in ("head", "tail")))
    return graph.existing(pairs, P.triples(t), keep=False).select("head", "tail")


FILL = """&
legal as (select h.id as head, x.id as tail from e h join e x on h.type = 'region' and x.type = 'nation'),
free as (select head, tail, row_number() over (order by head, tail) as k from legal where not exists (select 1 from t where t.head = legal.head and t.relation = 'spans' and t.tail = legal.tail))
select 'spans' as relation, head, tail, cast(0.05 as double) as candidate_score from free where k <= 20"""


@query("kg_schema_fillers", sql("t e", FILL))
def _(s, d):
    """A relation that only the type route speaks for: its first legal pairs, which fill the top list."""
    only = Relation("spans", "region spans nation", ["region"], ["nation"], [], ["schema_type"], "", "", 20)
    return candidates.multi_route(P.graph(s, d), relation_table(s, [only])).select("relation", "head", "tail", "candidate_score")


V1 = """&
c as (select id from e where type = 'customer'), s as (select id from e where type = 'supplier'),
h1 as (select distinct c.id as head, u.b as loc from c join u on u.a = c.id),
h2 as (select distinct head, u.b as loc from h1 join u on u.a = h1.loc where u.b <> head),
h3 as (select distinct h2.head, u.b as loc from h2 join u on u.a = h2.loc where u.b[1] = 's' and h2.loc[1] <> 's'),
p as (select head, loc as tail, min(k) as hops from (select head, loc, 1 as k from h1 where loc[1] = 's' union all select head, loc, 2 from h2 where loc[1] = 's' union all select head, loc, 3 from h3) group by head, loc),
n as (select h1.head, s.id as tail, count(*) as n from h1 join u on u.b = h1.loc join s on s.id = u.a group by h1.head, s.id),
o as (select distinct x.entity_id as head, h.entity_id as tail from ve h join ve x on h.evidence_id = x.evidence_id where h.entity_id[1] = 's' and x.entity_id[1] = 'c'),
k as (select head, tail from p union select head, tail from n union select head, tail from o),
r as (select k.head, k.tail, cast(round(case when p.hops <= 2 then 0.4 when p.hops is not null then 0.25 else 0.0 end + case when n.n > 0 then least(0.3, 0.15 + 0.05 * n.n) else 0.0 end + case when o.head is not null then 0.2 else 0.0 end, 3) as double) as candidate_score
from k left join p on p.head = k.head and p.tail = k.tail left join n on n.head = k.head and n.tail = k.tail left join o on o.head = k.head and o.tail = k.tail)
"""


def _v1(s: SparkSession, d: str, best: int | None = None) -> DataFrame:
    """Scored pairs of the single-relation rules, by reachability instead of single paths; best: at least the first so many."""
    t = P.Tables(s, d)
    e = P.entities(t)
    ends = [e.where(F.col("type") == k).select("id") for k in ("customer", "supplier")]
    return candidates.single_relation_scores({"entities": e, "triples": P.triples(t), "evidence": P.evidence(t)}, ends, best)


@query("kg_candidates_v1_scored", sql("t u ve e", V1 + "select head, tail, candidate_score from r"))
def _(s, d):
    return _v1(s, d)


@query("kg_candidate_window", sql("t u ve e", V1 + "select * from (select head, tail, candidate_score, row_number() over (order by candidate_score desc, head, tail) as seq from r) where seq > 100 and seq <= 150"))
def _(s, d):
    best = _v1(s, d, 150).orderBy(F.desc("candidate_score"), "head", "tail").limit(150)  # the window's end bounds the sort
    from pyspark.sql import Window

    ranked = best.withColumn("seq", F.row_number().over(Window.orderBy(F.desc("candidate_score"), "head", "tail")).cast("long"))
    return candidates.window(ranked, 100, 50)


V2 = """&
s as (select id from e where type = 'supplier'), c as (select id from e where type = 'customer'), pt as (select id from e where type = 'part'),
h1 as (select distinct s.id as head, u.b as loc from s join u on u.a = s.id),
h2 as (select distinct head, u.b as loc from h1 join u on u.a = h1.loc),
h3 as (select distinct h2.head, u.b as loc from h2 join u on u.a = h2.loc where u.b[1] = 'c'),
p as (select head, loc as tail, min(k) as hops from (select head, loc, 1 as k from h1 where loc[1] = 'c' union all select head, loc, 2 from h2 where loc[1] = 'c' union all select head, loc, 3 from h3) group by head, loc),
n as (select h1.head, c.id as tail, count(*) as n from h1 join u on u.b = h1.loc join c on c.id = u.a group by h1.head, c.id),
o as (select h.entity_id as head, x.entity_id as tail, count(*) as n from ve h join ve x on h.evidence_id = x.evidence_id where h.entity_id[1] = 's' and x.entity_id[1] = 'c' group by h.entity_id, x.entity_id),
w as (select id, list_filter(list_distinct(regexp_extract_all(lower(id || ' ' || name), '[a-z0-9]+')), lambda x: x not in ('svc', 'team', 'app', 'ip', 'host', 'prod')) as ts from e where type in ('supplier', 'customer')),
tok as (select id, len(ts) as n, unnest(ts) as tk from w),
a as (select x.id as head, y.id as tail, count(*) / (x.n + y.n - count(*)) as j from tok x join tok y on x.tk = y.tk where x.id[1] = 's' and y.id[1] = 'c' group by x.id, y.id, x.n, y.n),
k as (select head, tail from p union select head, tail from n union select head, tail from o union select head, tail from a),
serves as (select 'serves' as relation, k.head, k.tail, round_even(0.05 + cast(case when p.hops <= 2 then 0.45 when p.hops is not null then 0.25 else 0 end as decimal(12,6)) + cast(case when n.n > 0 then least(0.3, 0.12 + 0.04 * n.n) else 0 end as decimal(12,6)) + cast(case when o.n > 0 then least(0.5, 0.18 + 0.08 * o.n) else 0 end as decimal(12,6)) + cast(case when a.j is not null then least(0.35, 0.1 + a.j) else 0 end as decimal(12,6)), 4) as sc
from k left join p on p.head = k.head and p.tail = k.tail left join n on n.head = k.head and n.tail = k.tail left join o on o.head = k.head and o.tail = k.tail left join a on a.head = k.head and a.tail = k.tail),
supplies as (select 'supplies' as relation, h.entity_id as head, x.entity_id as tail, cast(least(0.5, 0.18 + 0.08 * count(*)) as decimal(12,6)) as sc from ve h join ve x on h.evidence_id = x.evidence_id where h.entity_id[1] = 's' and x.entity_id[1] = 'p' and not exists (select 1 from t where t.head = h.entity_id and t.relation = 'supplies' and t.tail = x.entity_id) group by h.entity_id, x.entity_id),
best as (select relation, head, tail, cast(sc as double) as candidate_score, row_number() over (partition by relation order by sc desc, head, tail) as k from (select * from serves union all select * from supplies))
"""


@query("kg_candidates_v2_topk", sql("t u ve e", V2 + "select 'cand_' || lpad(cast(row_number() over (order by relation, k) as varchar), 6, '0') as candidate_id, relation, head, tail, candidate_score from best where k <= 50"))
def _(s, d):
    return candidates.multi_route(P.graph(s, d), P.relations(s)).select("candidate_id", "relation", "head", "tail", "candidate_score")


@query("ing_normalize_ids", "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as token, case when starts_with(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_'), 'team_') then trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') else 'team_' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') end as team from part")
def _(s, d):
    return P.Tables(s, d).part.select("p_partkey", normal(F.col("p_name")).alias("token"), entity_id("team", F.col("p_brand")).alias("team"))


@query("ing_entity_fold", "select 'b' || p_brand as id, arg_min(p_name, p_partkey) as name, string_agg(distinct p_type, ',' order by p_type) as aliases, arg_max(cast(p_size as varchar), p_partkey) as size from part group by p_brand")
def _(s, d):
    met = P.Tables(s, d).part.select(F.concat(F.lit("b"), "p_brand").alias("id"), F.lit("brand").alias("type"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("properties"), F.lit(0).alias("stage"), F.col("p_partkey").alias("row"), F.lit(0).alias("sub"))
    return fold_entities(met).select("id", "name", joined("aliases").alias("aliases"), F.element_at("properties", "size").alias("size"))


@query("ing_lookup_last_wins", "select c_mktsegment as key, arg_max('c' || c_custkey, c_custkey) as id from customer group by c_mktsegment")
def _(s, d):
    return lookup(P.Tables(s, d).customer.select(F.col("c_mktsegment").alias("key"), P.key("c", "c_custkey").alias("id"), F.col("c_custkey").alias("seq")))


@query("ing_leak_check", sql("t", "select distinct 's' || l_suppkey as head, 'supplies' as relation, 'p' || l_partkey as tail from lineitem where l_linenumber = 1 and exists (select 1 from t where t.head = 's' || l_suppkey and t.relation = 'supplies' and t.tail = 'p' || l_partkey)"))
def _(s, d):
    t = P.Tables(s, d)
    gold = t.lineitem.where("l_linenumber = 1").select(P.key("s", "l_suppkey").alias("head"), F.lit("supplies").alias("relation"), P.key("p", "l_partkey").alias("tail")).distinct()
    return checks.leaked(gold, P.triples(t))


@query("fn_tokens", """with w as (select item_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') as ws from benchmark)
select item_id, len(list_distinct(list_concat(ws, list_filter(flatten(list_transform(ws, lambda x: regexp_split_to_array(x, '[_./:-]+'))), lambda x: x <> '')))) as n from w""")
def _(s, d):
    return P.Tables(s, d).benchmark.select("item_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("fn_attribute_tokens", "select p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower('p' || p_partkey || ' ' || p_name || ' ' || p_brand), '[a-z0-9]+'))), ',') as toks from part")
def _(s, d):
    got = attribute_tokens(P.key("p", "p_partkey"), F.col("p_name"), F.array("p_brand"), F.create_map().cast("map<string,string>"))
    return P.Tables(s, d).part.select("p_partkey", F.array_join(F.array_sort(got), ",").alias("toks"))
