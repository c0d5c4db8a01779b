"""The driver's tables as a knowledge graph, and the same graph as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.config import Relation, Task, relation_table

#: The projection in SQL; what a query needs of it is prepended to its own text.
CTE = {
    "e": "e as (select 'c' || c_custkey as id, 'customer' as type, c_name as name from customer union all select 's' || s_suppkey, 'supplier', s_name from supplier union all select 'p' || p_partkey, 'part', p_name from part union all select 'n' || n_nationkey, 'nation', n_name from nation union all select 'r' || r_regionkey, 'region', r_name from region)",
    "t": "t as (select 'c' || c_custkey as head, 'in_nation' as relation, 'n' || c_nationkey as tail from customer union all select 's' || s_suppkey, 'in_nation', 'n' || s_nationkey from supplier union all select 'n' || n_nationkey, 'in_region', 'r' || n_regionkey from nation union all select distinct 's' || l_suppkey, 'supplies', 'p' || l_partkey from lineitem)",
    "v": "v as (select 'o' || o_orderkey as id, o_orderpriority as source, lower(o_orderpriority) || ' order ' || o_orderstatus as text, case o_orderstatus when 'F' then 0.9 when 'O' then 0.8 else 0.6 end as reliability from orders)",
    "ve": "ve as (select 'o' || o_orderkey as evidence_id, 'c' || o_custkey as entity_id from orders union select 'o' || l_orderkey, 's' || l_suppkey from lineitem union select 'o' || l_orderkey, 'p' || l_partkey from lineitem)",
    "u": "u as (select head as a, tail as b from t union select tail, head from t)",
    "pr": "pr as (select event_id as seq, 'u' || user_id as head, event_type as relation, 'k' || (event_id % 3) as tail, case when event_type in ('click', 'purchase') then 'accept' when event_type = 'error' then 'reject' else 'uncertain' end as decision, least(1.0, value / 100.0) as confidence, user_id % 10 <> 0 as schema_ok, event_id % 7 <> 0 as grounded, event_type <> 'purchase' or event_id % 5 <> 0 as backed from events)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A query over some of the projection's tables."""
    return f"with {'recursive ' if recursive else ''}" + ", ".join(CTE[n] for n in names.split()) + (", " if body.lstrip().startswith("&") else " ") + body.lstrip().lstrip("&")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


class Tables:
    """Lazy frames over one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def entities(t: Tables) -> DataFrame:
    rows = [(t.customer, "c", "c_custkey", "customer", "c_name"), (t.supplier, "s", "s_suppkey", "supplier", "s_name"), (t.part, "p", "p_partkey", "part", "p_name"), (t.nation, "n", "n_nationkey", "nation", "n_name"), (t.region, "r", "r_regionkey", "region", "r_name")]
    out = None
    for df, p, k, kind, name in rows:
        e = df.select(key(p, k).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.array().cast("array<string>").alias("aliases"), F.create_map().cast("map<string,string>").alias("properties"), F.col(k).cast("long").alias("seq"))
        out = e if out is None else out.unionByName(e)
    return out


def triples(t: Tables) -> DataFrame:
    def edge(df: DataFrame, head: Column, relation: str, tail: Column) -> DataFrame:
        return df.select(head.alias("head"), F.lit(relation).alias("relation"), tail.alias("tail"))

    every = (
        edge(t.customer, key("c", "c_custkey"), "in_nation", key("n", "c_nationkey"))
        .unionByName(edge(t.supplier, key("s", "s_suppkey"), "in_nation", key("n", "s_nationkey")))
        .unionByName(edge(t.nation, key("n", "n_nationkey"), "in_region", key("r", "n_regionkey")))
        .unionByName(edge(t.lineitem.select("l_suppkey", "l_partkey").distinct(), key("s", "l_suppkey"), "supplies", key("p", "l_partkey")))
    )
    return every.select(F.concat_ws("|", "head", "relation", "tail").alias("id"), "head", "relation", "tail", F.xxhash64("head", "relation", "tail").alias("seq"))


def evidence(t: Tables) -> DataFrame:
    """One row an order, naming its customer, suppliers and parts."""
    related = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.array_union(F.collect_set(key("s", "l_suppkey")), F.collect_set(key("p", "l_partkey")))).alias("lines"))
    o = t.orders.join(related, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    named = F.concat(F.array(key("c", "o_custkey")), F.coalesce("lines", F.array().cast("array<string>")))
    text = F.concat(F.lower("o_orderpriority"), F.lit(" order "), F.col("o_orderstatus"))
    sure = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.8).otherwise(0.6)
    return o.select(key("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), text.alias("text"), named.alias("related_entities"), sure.alias("reliability"), F.col("o_orderkey").alias("seq"))


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = Tables(spark, sf_dir)
    return {"entities": entities(t), "triples": triples(t), "evidence": evidence(t)}


def predictions(t: Tables) -> DataFrame:
    """Ordered decisions from events."""
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("seq"), key("u", "user_id").alias("head"), kind.alias("relation"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("tail"),
        F.when(kind.isin("click", "purchase"), "accept").when(kind == "error", "reject").otherwise("uncertain").alias("decision"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"),
        (F.col("user_id") % 10 != 0).alias("schema_ok"), (F.col("event_id") % 7 != 0).alias("grounded"), ((kind != "purchase") | (F.col("event_id") % 5 != 0)).alias("backed"), F.col("event_id").cast("string").alias("candidate_id"),
    )


def relations(spark: SparkSession) -> DataFrame:
    """Which customers a supplier may serve and which parts it may supply, to be completed by all routes that the tables feed."""
    every = ["schema_type", "path_rule", "common_neighbor", "evidence_cooccurrence", "attribute_similarity", "source_specific_rule"]
    serves = Relation("serves", "supplier serves customer", ["supplier"], ["customer"], ["1-URGENT", "2-HIGH"], every, "Tell whether the supplier serves the customer.", "Orders name both.", 50)
    supplies = Relation("supplies", "supplier supplies part", ["supplier"], ["part"], ["3-MEDIUM"], ["evidence_cooccurrence"], "Tell whether the supplier supplies the part.", "Orders name both.", 50)
    return relation_table(spark, [serves, supplies])


TASK = Task("partners", "likely_served_by", ["customer"], ["supplier"], ["two_hop_path", "common_neighbor", "evidence_overlap"])
