"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id prefixes of entity types.
PREFIXES = {
    "application": "app",
    "asset": "asset",
    "alert": "alert",
    "domain": "domain",
    "host": "host",
    "ip": "ip",
    "port": "port",
    "service": "svc",
    "team": "team",
    "ticket": "ticket",
}
#: Tokens that say nothing about likeness, words that speak against a relation.
STOP_TOKENS = ["svc", "team", "app", "ip", "host", "prod"]
CONFLICT_WORDS = ["not", "no", "without", "unknown", "unassigned", "unowned"]
#: Language that supports a relation.
SUPPORT_WORDS = {
    "owned_by": ["team", "handled", "investigated", "reviewed", "routed", "responsible"],
    "depends_on": ["depends", "upstream", "calls", "validation", "storage", "trace"],
    "runs_on": ["on", "maps", "host", "fired", "prod"],
}


def clean(c: Column) -> Column:
    """Null as empty, white space off both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def normal(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def strict_normal(c: Column) -> Column:
    """normal(), or an error where nothing is left."""
    n = normal(c)
    return F.when(n != "", n).otherwise(F.raise_error(F.concat(F.lit("cannot normalize entity value: "), F.coalesce(c, F.lit("null")))))


def entity_id(kind: str, c: Column) -> Column:
    """Prefix of the type and the normal form, the prefix not doubled."""
    prefix = PREFIXES.get(kind) or "_".join(x for x in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in kind.lower()).split())
    token = strict_normal(c)
    return F.when(F.startswith(token, F.lit(prefix + "_")), token).otherwise(F.concat(F.lit(prefix + "_"), token))


def tokens(c: Column) -> Column:
    """Distinct retrieval tokens: runs of letters, digits and _ . / : -, and their parts between the latter."""
    whole = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_./:-]+"), F.lit(0))
    parts = F.flatten(F.transform(whole, lambda t: F.split(t, "[_./:-]+")))
    return F.array_distinct(F.concat(whole, F.filter(parts, lambda t: t != "")))


def attribute_tokens(id_: Column, name: Column, aliases: Column, properties: Column) -> Column:
    """Distinct a-z0-9 tokens of an entity's id, name, aliases and property values, without stop tokens."""
    values = F.filter(F.map_values(properties), lambda v: v.isNotNull() & (v != ""))
    text = F.lower(F.concat_ws(" ", id_, name, F.array_join(aliases, " "), F.array_join(values, " ")))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP_TOKENS)))


def entity_text(id_: Column, name: Column, kind: Column, properties: Column) -> Column:
    """id, name, type and sorted properties, empty parts left out."""
    pairs = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat_ws(" ", e["key"], F.coalesce(e["value"], F.lit("None"))))
    props = F.array_join(pairs, " ")
    return F.concat_ws(" ", *(F.when(p != "", p) for p in (id_, name, kind, props)))


def json_object(c: Column) -> Column:
    """The JSON value of a text, else of the span from its first { to its last }; null if neither parses."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.when(inner != "", inner)))


def error_class(c: Column, old: bool = False) -> Column:
    """timeout, parse_failure, provider_error or reasoner_error by what an error says; empty for no text."""
    low = F.lower(F.coalesce(c, F.lit("")))

    def says(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(low, F.lit(p))
        return out

    provider = ("llm request failed", "missing api key") if old else ("missing api key", "provider", "response missing content")
    return (
        F.when(says("timed out", "timeout"), "timeout")
        .when(says("no json object", "jsondecodeerror", "invalid json"), "parse_failure")
        .when(says(*provider), "provider_error")
        .when(low != "", "reasoner_error")
        .otherwise("")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over their common length; 0 where either has no length."""
    n = F.least(F.size(a), F.size(b))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))
    norms = [F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double")))) for x in (a, b)]
    return F.when((norms[0] == 0) | (norms[1] == 0), F.lit(0.0)).otherwise(dot / (norms[0] * norms[1]))


def even(c: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(c, digits)
