"""Star-schema tables into entities, triples, evidence and gold.

Each table yields rows of a stage; (stage, row, sub) is the order in which a record is met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import entity_id, normal
from attestra.operators.checks import leaked, must_be_empty

ORDER = ["stage", "row", "sub"]
STAGES = ["teams", "assets", "services", "dns_records", "tickets", "alerts", "service_dependencies"]


def _props(**values: Column) -> Column:
    """Properties that are not empty."""
    return F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v != "")


def _entity(id_: Column, kind: str, name: Column, aliases: list[Column], /, **props: Column) -> Column:
    own = F.filter(F.array(*aliases) if aliases else F.array().cast("array<string>"), lambda a: a != "")
    return F.struct(id_.alias("id"), F.lit(kind).alias("type"), name.alias("name"), own.alias("aliases"), (_props(**props) if props else F.create_map().cast("map<string,string>")).alias("properties"))


def _edge(head: str, relation: str, tail: str, file: str, row_id: str, confidence: float) -> Column:
    return F.struct(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.lit(file).alias("source"), F.col(row_id).alias("source_row_id"), F.lit(confidence).alias("confidence"))


def _rows(df: DataFrame, stage: str, items: list[Column]) -> DataFrame:
    return df.select(F.lit(STAGES.index(stage)).alias("stage"), F.col("seq").alias("row"), F.posexplode(F.array(*items)).alias("sub", "r")).where("r is not null").select("r.*", *ORDER)


def fold_entities(met: DataFrame) -> DataFrame:
    """One row an id from all its records in order: first type and name, all aliases sorted, each property's last value."""
    order = F.struct(*ORDER)
    base = met.groupBy("id").agg(F.min_by("type", order).alias("type"), F.min_by("name", order).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    values = met.select("id", order.alias("o"), F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "o").alias("v"))
    props = values.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return base.join(props, "id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def lookup(entries: DataFrame) -> DataFrame:
    """key -> id of (key, id, seq): the last entry of a key stands."""
    return entries.where("key != ''").groupBy("key").agg(F.max_by("id", "seq").alias("id"))


def require(df: DataFrame, column: str, table: DataFrame, out: str, what: str, normalised: bool = True) -> DataFrame:
    """df with the id that a column refers to; an unknown reference raises."""
    key = normal(F.col(column)) if normalised else F.col(column)
    joined = df.withColumn("_key", key).join(F.broadcast(table.select(F.col("key").alias("_key"), F.col("id").alias("_id"))), "_key", "left")
    lost = F.raise_error(F.concat(F.lit(f"unknown {what} reference: "), F.col(column)))
    return joined.withColumn(out, F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(lost)).drop("_key", "_id")


def build(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """entities, triples, evidence, gold with ids in the order of building; a gold edge among the triples raises."""
    c = F.col

    def either(a: str, b: str) -> Column:
        return F.when(c(a) != "", c(a)).otherwise(c(b))

    teams = tables["teams"].withColumn("id", entity_id("team", either("team_id", "team_name")))
    assets = tables["assets"].withColumn("ip_id", entity_id("ip", c("ip"))).withColumn("host_id", entity_id("host", c("hostname")))
    services = tables["services"].withColumn("id", entity_id("service", either("service_id", "service_name"))).withColumn("app_id", entity_id("application", c("app_name"))).withColumn("port_id", entity_id("port", c("port")))

    def keys(df: DataFrame, names: list[str], id_: str, plain: bool = False) -> DataFrame:
        entries = F.array(*(F.struct((c(n) if plain else normal(c(n))).alias("key"), F.struct("seq", F.lit(i).alias("i")).alias("seq")) for i, n in enumerate(names)))
        return lookup(df.select(c(id_).alias("id"), F.explode(entries).alias("e")).select("e.key", "id", "e.seq"))

    team_of, ip_of, service_of = keys(teams, ["team_id", "team_name"], "id"), keys(assets, ["ip"], "ip_id", True), keys(services, ["service_id", "service_name"], "id")
    services = require(require(services, "host_ip", ip_of, "ip_id", "ip", False), "owner_team", team_of, "team", "team")
    dns = tables["dns_records"].withColumn("id", entity_id("domain", c("domain"))).join(F.broadcast(ip_of.select(c("key").alias("value"), c("id").alias("ip_id"))), "value", "left")

    def reported(name: str, kind: str, own: str) -> DataFrame:
        df = tables[name].withColumn("id", entity_id(kind, c(own)))
        for column, table, out, what, norm in (("related_service", service_of, "service", "service", True), ("related_ip", ip_of, "ip_id", "ip", False), ("assigned_team", team_of, "team", "team", True)):
            df = require(df, column, table, out, what, norm)
        return df

    tickets, alerts = reported("tickets", "ticket", "ticket_id"), reported("alerts", "alert", "alert_id")
    deps = require(require(tables["service_dependencies"], "source_service", service_of, "head_id", "service"), "target_service", service_of, "tail_id", "service")
    deps = deps.withColumn("row_id", F.format_string("dep_%03d", F.row_number().over(Window.orderBy("seq"))))
    dns = dns.withColumn("row_index", F.row_number().over(Window.orderBy("seq")))

    met = [
        _rows(teams, "teams", [_entity(c("id"), "team", c("team_name"), [c("team_id")], department=c("department"), oncall_email=c("oncall_email"))]),
        _rows(assets, "assets", [_entity(c("ip_id"), "ip", c("ip"), [], asset_id=c("asset_id"), env=c("env"), region=c("region")), _entity(c("host_id"), "host", c("hostname"), [c("asset_id")], asset_type=c("asset_type"), env=c("env"), region=c("region"))]),
        _rows(services, "services", [_entity(c("id"), "service", c("service_name"), [c("service_id")], app_name=c("app_name"), port=c("port")), _entity(c("app_id"), "application", c("app_name"), []), _entity(c("port_id"), "port", c("port"), [F.concat("port", F.lit("/tcp"))], protocol=F.lit("tcp"))]),
        _rows(dns, "dns_records", [_entity(c("id"), "domain", c("domain"), [], record_type=c("record_type"), source=c("source"))]),
        _rows(tickets, "tickets", [_entity(c("id"), "ticket", c("ticket_id"), [], title=c("title"))]),
        _rows(alerts, "alerts", [_entity(c("id"), "alert", c("alert_id"), [], severity=c("severity"))]),
    ]
    edges = [
        _rows(assets, "assets", [_edge("host_id", "has_ip", "ip_id", "assets.csv", "asset_id", 0.95)]),
        _rows(services, "services", [_edge("id", "belongs_to_application", "app_id", "services.csv", "service_id", 0.9), _edge("id", "runs_on", "ip_id", "services.csv", "service_id", 0.92), _edge("id", "uses_port", "port_id", "services.csv", "service_id", 0.88)]),
        _rows(dns.where("ip_id is not null"), "dns_records", [_edge("id", "resolves_to", "ip_id", "dns_records.csv", "domain", 0.9)]),
        _rows(tickets, "tickets", [_edge("id", "mentions", "service", "tickets.csv", "ticket_id", 0.8), _edge("id", "mentions", "ip_id", "tickets.csv", "ticket_id", 0.8), _edge("id", "assigned_to", "team", "tickets.csv", "ticket_id", 0.85)]),
        _rows(alerts, "alerts", [_edge("id", "alerts_on", "service", "alerts.csv", "alert_id", 0.82), _edge("id", "alerts_on", "ip_id", "alerts.csv", "alert_id", 0.78), _edge("id", "routed_to", "team", "alerts.csv", "alert_id", 0.84)]),
    ]

    def proof(source: str, file: str, row_id: str, text: Column, about: list[str], reliability: float, /, **meta: Column) -> Column:
        said = F.trim(text)
        checked = F.when(said != "", said).otherwise(F.raise_error(F.concat(F.lit(f"evidence text is required for {file}:"), c(row_id))))
        named = F.array_sort(F.array_distinct(F.filter(F.array(*(F.coalesce(c(a), F.lit("")) for a in about)), lambda x: x != "")))
        kept = F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v))) if meta else F.create_map().cast("map<string,string>")
        return F.struct(F.lit(source).alias("source"), F.lit(file).alias("source_file"), c(row_id).alias("source_row_id"), checked.alias("text"), named.alias("related_entities"), c("timestamp").alias("timestamp"), F.lit(reliability).alias("reliability"), kept.alias("metadata"))

    proofs = [
        _rows(dns, "dns_records", [proof("dns", "dns_records.csv", "domain", F.format_string("DNS %s record maps %s to %s.", "record_type", "domain", "value"), ["id", "ip_id"], 0.82, row_index=c("row_index").cast("string"), source=c("source"))]),
        _rows(tickets, "tickets", [proof("ticket", "tickets.csv", "ticket_id", F.concat_ws(" ", "title", "description"), ["id", "service", "ip_id", "team"], 0.86)]),
        _rows(alerts, "alerts", [proof("alert", "alerts.csv", "alert_id", F.format_string("%s %s Severity %s.", "title", "description", "severity"), ["id", "service", "ip_id", "team"], 0.8, severity=c("severity"))]),
        _rows(deps, "service_dependencies", [proof("service_dependency", "service_dependencies.csv", "row_id", F.format_string("%s depends on %s according to %s.", "source_service", "target_service", "evidence_source"), ["head_id", "tail_id"], 0.84, evidence_source=c("evidence_source"))]),
    ]

    def gold_row(head: str, relation: str, tail: str, file: str, row_id: str) -> Column:
        return F.struct(c(head).alias("head"), F.lit(relation).alias("relation"), c(tail).alias("tail"), F.lit(file).alias("source"), c(row_id).alias("source_row_id"), F.lit("evaluation_gold").alias("hide_reason"))

    hidden = [_rows(services, "services", [gold_row("id", "owned_by", "team", "services.csv", "service_id")]), _rows(deps, "service_dependencies", [gold_row("head_id", "depends_on", "tail_id", "service_dependencies.csv", "row_id")])]

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), frames)

    def in_order(df: DataFrame, form: str | None) -> DataFrame:
        """Numbered in building order; the records' number is a single sequence by definition."""
        n = df.withColumn("seq", F.row_number().over(Window.orderBy(*ORDER)).cast("long")).drop(*ORDER)
        return n if form is None else n.select(F.format_string(form, "seq").alias("id"), *[x for x in n.columns])

    triples = in_order(union(edges), "triple_%06d").withColumn("properties", F.create_map().cast("map<string,string>"))
    gold = in_order(union(hidden), None)
    must_be_empty(leaked(gold, triples), "hidden gold edges leaked into triples")
    return {"entities": fold_entities(union(met)), "triples": triples, "evidence": in_order(union(proofs), "ev_%06d"), "gold_hidden_edges": gold}


def summary(built: dict[str, DataFrame]) -> dict[str, int]:
    names = {"entities": "entity_count", "triples": "triple_count", "evidence": "evidence_count", "gold_hidden_edges": "gold_hidden_edge_count"}
    return {v: built[k].count() for k, v in names.items()}
