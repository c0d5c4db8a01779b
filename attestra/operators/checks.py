"""Constraints: keys, references, leaks. Each has a table of violations and a form that raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, and how many do."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is no key of the target."""
    return df.join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def links(evidence: DataFrame) -> DataFrame:
    """(evidence_id, entity_id, place, evidence's seq) of every distinct mention."""
    seen = evidence.select(F.col("id").alias("evidence_id"), "seq", F.posexplode("related_entities").alias("place", "entity_id"))
    return seen.groupBy("evidence_id", "entity_id").agg(F.min("place").alias("place"), F.first("seq").alias("seq"))


def leaked(gold: DataFrame, triples: DataFrame) -> DataFrame:
    """Gold edges that stand among the triples."""
    return gold.join(triples.select("head", "relation", "tail"), ["head", "relation", "tail"], "left_semi")


def must_be_empty(bad: DataFrame, what: str) -> None:
    if found := bad.limit(3).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def check_graph(kg: dict[str, DataFrame]) -> None:
    """Unique ids, and references of triples and evidence into entities."""
    for name in ("entities", "triples", "evidence"):
        must_be_empty(duplicate_keys(kg[name], "id"), f"duplicate ids in {name}")
    for end in ("head", "tail"):
        must_be_empty(orphans(kg["triples"], end, kg["entities"], "id"), f"unknown {end} in triples")
    must_be_empty(orphans(links(kg["evidence"]), "entity_id", kg["entities"], "id"), "unknown entity in evidence")


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    if list(df.columns) != list(names):
        raise ValueError(f"{what}: columns {df.columns}, not {list(names)}")
