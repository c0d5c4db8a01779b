"""Sources: JSONL, CSV and JSON-array scans with the checks that belong to them."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import schemas
from attestra.functions.text import clean

#: Columns that the tables of a star-schema build must have.
STAR_TABLES = {
    "teams": ["team_id", "team_name", "department", "oncall_email"],
    "assets": ["asset_id", "asset_type", "ip", "hostname", "env", "region"],
    "services": ["service_id", "service_name", "app_name", "owner_team", "host_ip", "port"],
    "dns_records": ["domain", "record_type", "value", "source", "timestamp"],
    "tickets": ["ticket_id", "title", "description", "related_service", "related_ip", "assigned_team", "timestamp"],
    "alerts": ["alert_id", "title", "description", "related_service", "related_ip", "assigned_team", "severity", "timestamp"],
    "service_dependencies": ["source_service", "target_service", "evidence_source", "timestamp"],
}
#: Fields of a relation's metadata record.
METADATA_FIELDS = ["relation_id", "wikidata_label", "wikidata_description", "wikidata_aliases", "relation_name", "description", "aliases", "source", "needs_review"]
SPLITS = ("train", "dev", "test")


def numbered(df: DataFrame, name: str = "seq") -> DataFrame:
    """A record's place in its file. A split of a file keeps its lines' order, and a later split has larger ids."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON lines with an explicit schema and seq; blank lines are skipped, malformed ones raise."""
    lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schemas.struct(ddl), {"mode": "FAILFAST"}).alias("r"), "seq").select("r.*", "seq")


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A knowledge-graph table in either record shape; fields that the newer shape requires and the older lacks get defaults.

    A record of the newer shape that lacks a required field raises.
    """
    old = schemas.OLD_NAMES[table]
    ddl = schemas.TABLES[table]
    extra = ", ".join(f"{o} {'map<string,string>' if n == 'properties' else 'string'}" for o, n in old.items())
    lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schemas.struct(ddl + (", " + extra if extra else "")), {"mode": "FAILFAST"}).alias("r"), F.json_object_keys("value").alias("keys"), "seq")
    names = {f.name: f.dataType for f in schemas.struct(ddl).fields}
    empty: dict[str, Column] = {"aliases": F.array().cast("array<string>"), "properties": F.create_map().cast("map<string,string>"), "metadata": F.create_map().cast("map<string,string>"), "evidence_ids": F.array().cast("array<string>")}
    is_old = F.exists("keys", lambda k: k.isin(*[o for o in old if o.endswith("_id")])) if old else F.lit(False)
    lacking = F.array_except(F.array(*map(F.lit, schemas.REQUIRED[table])), F.col("keys"))
    checked = parsed.withColumn("r", F.when(is_old | (F.size(lacking) == 0), F.col("r")).otherwise(F.raise_error(F.concat(F.lit(f"{table}: a record lacks "), F.array_join(lacking, ", ")))))
    back = {n: o for o, n in old.items()}
    columns = []
    for name in names:
        c = F.coalesce(F.col(f"r.{name}"), F.col(f"r.{back[name]}")) if name in back else F.col(f"r.{name}")
        columns.append((F.coalesce(c, empty[name]) if name in empty else c).alias(name))
    return checked.select(*columns, "seq")


def read_knowledge_graph(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """entities, triples, evidence and, if there, gold of a directory."""
    files = {"entities": "entities", "triples": "triples", "evidence": "evidence", "gold": "gold_hidden_edges"}
    return {t: read_table(spark, f"{directory}/{f}.jsonl", t) for t, f in files.items() if t != "gold" or Path(f"{directory}/{f}.jsonl").exists()}


def load_manifest(path: str | Path) -> dict[str, Any]:
    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    tables = given.get("tables")
    if not isinstance(tables, dict):
        raise ValueError("a manifest needs a mapping of tables")
    if lacking := sorted(set(STAR_TABLES) - set(tables)):
        raise ValueError(f"the manifest lacks tables: {lacking}")
    return given


def read_csv_table(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """CSV with a header: all columns as clean strings, and seq; lacking columns raise."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    if lacking := [c for c in required if c not in raw.columns]:
        raise ValueError(f"{path} lacks columns: {lacking}")
    return numbered(raw.select(*(clean(F.col(c)).alias(c) for c in raw.columns)))


def read_star(spark: SparkSession, manifest: str | Path, directory: str) -> dict[str, DataFrame]:
    """The tables of a star-schema build."""
    out = {}
    tables = load_manifest(manifest)["tables"]
    for name, required in STAR_TABLES.items():
        if not tables[name].get("file"):
            raise ValueError(f"table {name} has no file")
        path = f"{directory}/{tables[name]['file']}"
        if "://" not in path and not Path(path).exists():
            raise FileNotFoundError(f"table {name}: {path}")
        out[name] = read_csv_table(spark, path, required)
    return out


def read_split(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """(pos, doc variant, raw text) of a file that is one JSON array; anything else raises."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")), F.lit(False))
    checked = whole.select(F.when(good, F.col("v")).otherwise(F.raise_error(F.lit(f"{path} is not a JSON array"))).alias("v"))
    docs = checked.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("pos").cast("long").alias("pos"), F.col("value").alias("doc"))
    return docs if max_docs is None else docs.where(F.col("pos") < max_docs)


def select_splits(files: dict[str, str | None], split: str | None = None, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """An explicit split, else the given files, else those defaults that exist; an error if none does."""
    defaults = defaults or {}
    if split:
        path = files.get(split) or defaults.get(split)
        if split not in SPLITS or not path:
            raise ValueError(f"no such split: {split}")
        chosen = {split: path}
    else:
        chosen = {k: v for k, v in files.items() if v} or {k: v for k, v in defaults.items() if Path(v).exists()}
    if lacking := [v for v in chosen.values() if not Path(v).exists()]:
        raise FileNotFoundError(f"no such file: {lacking}")
    if not chosen:
        raise FileNotFoundError("no split to read")
    return chosen


def read_relation_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Relation metadata: exactly the nine fields, right types, reviewed, unique ids; a blank line is an error."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    lines = numbered(spark.read.text(path)).select("value", F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("keys"), "seq")
    texts = ["relation_id", "wikidata_label", "wikidata_description", "relation_name", "description", "source"]
    want = F.array(*map(F.lit, sorted(METADATA_FIELDS)))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))

    wrong = F.lit(False)
    for name in texts:
        wrong = wrong | ~F.coalesce(kind(name) == "STRING", F.lit(False))
    for name in ("wikidata_aliases", "aliases"):
        wrong = wrong | ~F.coalesce(kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>"), F.lit(False))
    problem = (
        F.when(F.trim("value") == "", "blank line")
        .when(F.col("v").isNull() | F.col("keys").isNull(), "not a JSON object")
        .when(F.array_sort("keys") != want, "wrong fields")
        .when(wrong | ~F.coalesce(kind("needs_review") == "BOOLEAN", F.lit(False)), "wrong type")
        .when(F.try_variant_get("v", "$.needs_review", "boolean"), "not reviewed")
    )
    first = lines.select("seq", problem.alias("problem")).where("problem is not null").orderBy("seq").limit(1).collect()
    if first:
        raise ValueError(f"relation metadata {path}: {first[0].problem}")
    ddl = ", ".join(f"{n} {'array<string>' if n.endswith('aliases') else 'boolean' if n == 'needs_review' else 'string'}" for n in METADATA_FIELDS)
    table = lines.select(F.from_json("value", schemas.struct(ddl)).alias("r"), "seq").select("r.*", "seq")
    if twice := table.groupBy("relation_id").count().where("count > 1").limit(1).collect():
        raise ValueError(f"relation metadata {path}: duplicate relation_id {twice[0].relation_id}")
    return table
