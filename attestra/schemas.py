"""Explicit schemas of the engine's tables. seq is a record's place in its file."""

from __future__ import annotations

from pyspark.sql.types import StructType

STRING_MAP = "map<string,string>"

ENTITIES = "id string, type string, name string, aliases array<string>, properties map<string,string>"
TRIPLES = "id string, head string, relation string, tail string, source string, source_row_id string, confidence double, properties map<string,string>, evidence_ids array<string>"
EVIDENCE = "id string, source string, source_file string, source_row_id string, text string, related_entities array<string>, timestamp string, reliability double, metadata map<string,string>"
GOLD = "head string, relation string, tail string"
REVIEWS = "candidate_id string, decision string"

#: Fields that a record must have, by table.
REQUIRED = {
    "entities": ["id", "type", "name", "aliases", "properties"],
    "triples": ["id", "head", "relation", "tail", "source", "source_row_id", "confidence", "properties"],
    "evidence": ["id", "source", "source_file", "source_row_id", "text", "related_entities", "timestamp", "reliability", "metadata"],
    "gold": ["head", "relation", "tail"],
}

#: Names that the older record shape has for the same fields.
OLD_NAMES = {"entities": {"entity_id": "id", "attributes": "properties"}, "triples": {"triple_id": "id"}, "evidence": {"evidence_id": "id"}, "gold": {}}

TABLES = {"entities": ENTITIES, "triples": TRIPLES, "evidence": EVIDENCE, "gold": GOLD}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
