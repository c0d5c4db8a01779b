"""Document-level relation data (a JSON array a split) into documents, entities, sentence evidence and gold triples.

Everything follows the raw order by (pos, index, ...) columns. Errors are rows of a
diagnostics table; strict mode raises the first of them, lenient mode leaves out the unit that it affects.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.checks import duplicate_keys, must_be_empty, orphans, require_columns
from attestra.sources.readers import read_relation_metadata, read_split, select_splits
from attestra.sources.shared import cut
from attestra.sources.writers import commit

#: Columns of the outputs, in order.
COLUMNS = {
    "documents": ["doc_id", "split", "title", "raw_doc_index", "sentence_ids", "entity_ids", "label_count", "metadata"],
    "entities": ["id", "doc_id", "local_entity_index", "type", "name", "aliases", "mentions", "properties"],
    "evidence": ["id", "doc_id", "sent_id", "source", "source_file", "source_row_id", "text", "tokens", "related_entities", "mention_ids", "timestamp", "reliability", "metadata"],
    "gold_triples": ["gold_id", "doc_id", "split", "head", "head_index", "head_name", "relation", "relation_name", "relation_description", "relation_aliases", "tail", "tail_index", "tail_name", "evidence_ids", "evidence_sent_ids", "evidence_annotation_status", "source", "oracle_only", "metadata"],
}
#: What only an evaluation may see.
ORACLE_COLUMNS = ["evidence_ids", "evidence_sent_ids", "evidence_annotation_status", "oracle_only"]
STATUS = ["missing", "empty", "present", "invalid"]  # by precedence


class AdapterError(ValueError):
    def __init__(self, code: str, message: str, unit: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.unit = code, unit


def get(v: Column, name: str) -> Column:
    """A field as a variant, null where it is absent or v is no object."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID ... of a variant; null for null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_kind(v: Column, name: str) -> Column:
    return F.coalesce(kind(v) == name, F.lit(False))


def integer(v: Column) -> Column:
    """A strict integer, else null: neither a boolean nor a string of digits counts."""
    return F.when(is_kind(v, "BIGINT"), F.try_variant_get(v, "$", "bigint"))


def text(v: Column) -> Column:
    """A non-empty string, else null."""
    s = F.when(is_kind(v, "STRING"), F.try_variant_get(v, "$", "string"))
    return F.when(s != "", s)


def items(v: Column) -> Column:
    """Elements of a list as variants."""
    return F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def has(v: Column, name: str) -> Column:
    """Whether an object has a field, be it null."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.to_json(v)), name), F.lit(False))


def _all(list_: Column, test) -> Column:
    return F.coalesce(F.forall(list_, test), F.lit(False))


def _classified(docs: DataFrame, split: str) -> DataFrame:
    """docs with parsed fields and `problem`, the first structural error of a document."""
    d = F.col("doc")
    raw = docs.select("pos", "doc", text(get(d, "title")).alias("title"), items(get(d, "sents")).alias("sents"), items(get(d, "vertexSet")).alias("vertex"), items(get(d, "labels")).alias("labels"), has(d, "labels").alias("labels_available"), is_kind(d, "OBJECT").alias("is_object"))
    good_sentence = lambda s: is_kind(s, "ARRAY") & (F.size(items(s)) > 0) & _all(items(s), lambda t: is_kind(t, "STRING"))
    problem = (
        F.when(~F.col("is_object"), "DOCUMENT_NOT_OBJECT")
        .when(F.col("title").isNull(), "DOCUMENT_TITLE_INVALID")
        .when(F.col("sents").isNull(), "DOCUMENT_SENTS_INVALID")
        .when(~_all(F.col("sents"), good_sentence), "SENTENCE_INVALID")
        .when(F.col("vertex").isNull(), "VERTEX_SET_INVALID")
    )
    if split == "test":
        problem = problem.when(F.col("labels_available") & F.col("labels").isNull(), "TEST_LABELS_INVALID")
    else:
        problem = problem.when(F.col("labels").isNull(), "LABELS_INVALID")
    return raw.withColumn("problem", problem).withColumn("labels", F.coalesce("labels", F.array().cast("array<variant>")))


def _mentions(docs: DataFrame) -> DataFrame:
    """A row for each raw mention of structurally sound documents, with `problem` and its valid fields."""
    ent = docs.select("pos", "tokens", F.posexplode("vertex").alias("ent", "raw"))
    m = ent.where(is_kind(F.col("raw"), "ARRAY")).select("pos", "tokens", "ent", F.posexplode(items(F.col("raw"))).alias("men", "m"))
    v = F.col("m")
    m = m.select("pos", "ent", "men", "m", "tokens", text(get(v, "name")).alias("name"), integer(get(v, "sent_id")).alias("sent_id"), items(get(v, "pos")).alias("span"), F.coalesce(text(get(v, "type")), F.lit("UNKNOWN")).alias("type"))
    ints = F.transform("span", integer)
    m = m.withColumn("at", F.when((F.size("span") == 2) & F.forall(ints, lambda x: x.isNotNull()), ints))
    in_doc = F.coalesce((F.col("sent_id") >= 0) & (F.col("sent_id") < F.size("tokens")), F.lit(False))
    a, b = F.get("at", F.lit(0)), F.get("at", F.lit(1))
    size = F.size(F.get("tokens", F.when(in_doc, F.col("sent_id").cast("int"))))
    problem = (
        F.when(F.col("name").isNull(), "MENTION_NAME_INVALID")
        .when(~in_doc, "MENTION_SENT_ID_INVALID")
        .when(F.col("at").isNull(), "MENTION_POS_INVALID")
        .when(~((a >= 0) & (a < b) & (b <= size)), "MENTION_SPAN_OUT_OF_RANGE")
    )
    return m.withColumn("problem", problem).drop("tokens", "span", "m")


def fold_mentions(valid: DataFrame) -> DataFrame:
    """(pos, ent): first known type, later different types in order, first-seen names, mentions in order."""
    ordered = F.array_sort(F.collect_list(F.struct("men", "name", "sent_id", "at", "type")))
    g = valid.groupBy("pos", "ent").agg(ordered.alias("ms"))
    known = F.filter(F.transform("ms", lambda x: x["type"]), lambda t: t != "UNKNOWN")
    first = F.get(known, F.lit(0))
    return g.select("pos", "ent", "ms", F.coalesce(first, F.lit("UNKNOWN")).alias("type"), F.filter(known, lambda t: t != first).alias("type_conflicts"), F.array_distinct(F.transform("ms", lambda x: x["name"])).alias("aliases"))


def evidence_status(v: Column, present: Column, n_sentences: Column) -> Column:
    """status and sorted distinct valid indices of a label's evidence."""
    list_ = items(v)
    ok = F.transform(list_, integer)
    good = F.filter(ok, lambda i: i.isNotNull() & (i >= 0) & (i < n_sentences))
    status = (
        F.when(~present | v.isNull() | is_kind(v, "VOID"), "missing")
        .when(list_.isNull(), "invalid")
        .when(F.size(list_) == 0, "empty")
        .when(F.size(good) < F.size(list_), "invalid")
        .otherwise("present")
    )
    return F.struct(status.alias("status"), F.coalesce(F.array_sort(F.array_distinct(good)), F.array().cast("array<bigint>")).alias("valid"), F.coalesce(F.size(list_) - F.size(good), F.lit(0)).alias("bad"))


def merge_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of one key as one: first place, union of indices, the gravest status, raw places in order."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    merged = labels.groupBy(*keys).agg(F.min("label").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("valid")))).alias("evidence_sent_ids"), F.max(rank).alias("rank"), F.array_sort(F.collect_list(F.struct("label", "raw"))).alias("raws"))
    return merged.withColumn("status", F.element_at(F.array(*map(F.lit, STATUS)), F.col("rank").cast("int"))).drop("rank")


@dataclass
class Converted:
    """Tables of one split, diagnostics in traversal order, and raw counts."""

    tables: dict[str, DataFrame]
    diagnostics: DataFrame
    stats: dict[str, Any]
    summary: dict[str, Any]


def convert(docs: DataFrame, metadata: DataFrame, split: str, raw_file: str, source: str = "redocred", strict: bool = False) -> Converted:
    """Convert (pos, doc) of a split; metadata: reviewed relation records."""
    spark = docs.sparkSession
    checked = cut(_classified(docs, split), "docs")
    sound = checked.where("problem is null").withColumn("tokens", F.transform("sents", lambda s: F.transform(items(s), lambda t: F.try_variant_get(t, "$", "string"))))
    doc_id = F.format_string(f"redocred_{split}_%06d", "pos")

    entries = sound.select("pos", F.posexplode("vertex").alias("ent", "raw"))
    bad_entry = entries.where(~is_kind(F.col("raw"), "ARRAY")).groupBy("pos").agg(F.min("ent").alias("bad_entry"))
    mentions = cut(_mentions(sound), "mentions")
    valid = mentions.where("problem is null")
    sizes = entries.where(is_kind(F.col("raw"), "ARRAY")).select("pos", "ent", F.size(items(F.col("raw"))).alias("n"))
    empty = sizes.join(valid.select("pos", "ent").distinct(), ["pos", "ent"], "left_anti").groupBy("pos").agg(F.min("ent").alias("empty_entity"))
    fatal = bad_entry.join(empty, "pos", "full").select("pos", F.least("bad_entry", "empty_entity").alias("fatal"), (F.coalesce(F.col("bad_entry") <= F.col("empty_entity"), F.col("empty_entity").isNull())).alias("is_entry"))
    kept = cut(sound.join(fatal.select("pos"), "pos", "left_anti"), "kept")
    reached = lambda df: df.join(fatal, "pos", "left").where(F.col("fatal").isNull() | (F.col("ent") <= F.col("fatal")))

    ids = kept.select("pos", doc_id.alias("doc_id"))
    folded = fold_mentions(valid).join(ids, "pos").join(sizes, ["pos", "ent"])
    ent_id = F.concat(F.lit("ent_"), "doc_id", F.format_string("_%03d", "ent"))
    entities = cut(folded.withColumn("id", ent_id), "entities")
    sent_name = lambda d, i: F.concat(F.lit("sent_"), d, F.format_string("_%03d", i))
    men_name = lambda d, e, m: F.concat(F.lit("men_"), d, F.format_string("_%03d_%03d", e, m))
    mention_rows = F.transform("ms", lambda m: F.struct(men_name(F.col("doc_id"), F.col("ent"), m["men"]).alias("mention_id"), m["men"].alias("local_mention_index"), m["name"].alias("name"), m["sent_id"].alias("sent_id"), sent_name(F.col("doc_id"), m["sent_id"]).alias("sentence_id"), m["at"].alias("pos"), m["type"].alias("type")))
    entity_out = entities.select(
        "id", "doc_id", F.col("ent").alias("local_entity_index"), "type", F.get("ms", F.lit(0))["name"].alias("name"), "aliases", mention_rows.alias("mentions"),
        F.struct(F.lit("vertexSet").alias("source"), F.col("n").alias("mention_count"), F.size("ms").alias("valid_mention_count"), F.col("ent").alias("raw_entity_index"), "type_conflicts").alias("properties"), F.col("pos").alias("_pos"), F.col("ent").alias("_ent"),
    )

    at = entities.select("pos", "doc_id", "ent", "id", F.explode("ms").alias("m")).select("pos", F.col("m.sent_id").alias("sent_id"), "ent", "id", F.col("m.men").alias("men"), men_name(F.col("doc_id"), F.col("ent"), F.col("m.men")).alias("mention_id"))
    linked = at.groupBy("pos", "sent_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ent", "id"))), lambda x: x["id"])).alias("related_entities"), F.transform(F.array_sort(F.collect_list(F.struct("ent", "men", "mention_id"))), lambda x: x["mention_id"]).alias("mention_ids"))
    sentences = kept.join(ids, "pos").select("pos", "doc_id", "title", F.posexplode("tokens").alias("sent_id", "tokens")).withColumn("sent_id", F.col("sent_id").cast("long")).join(linked, ["pos", "sent_id"], "left")
    none = F.array().cast("array<string>")
    evidence_out = sentences.select(
        sent_name(F.col("doc_id"), F.col("sent_id")).alias("id"), "doc_id", "sent_id", F.lit("redocred_sentence").alias("source"), F.lit(raw_file).alias("source_file"), F.concat("doc_id", F.format_string(":sent:%03d", "sent_id")).alias("source_row_id"),
        F.array_join("tokens", " ").alias("text"), "tokens", F.coalesce("related_entities", none).alias("related_entities"), F.coalesce("mention_ids", none).alias("mention_ids"), F.lit("").alias("timestamp"), F.lit(1.0).alias("reliability"),
        F.struct("title", F.lit(split).alias("split"), F.col("sent_id").alias("sentence_index"), F.lit(source).alias("source")).alias("metadata"), F.col("pos").alias("_pos"), F.col("sent_id").alias("_sent"),
    )

    known = F.broadcast(metadata.select(F.col("relation_id").alias("r"), "relation_name", "description", "aliases"))
    lab = kept.select("pos", F.size("vertex").alias("n_ent"), F.size("tokens").alias("n_sent"), F.posexplode("labels").alias("label", "v"))
    v = F.col("v")
    full = has(v, "h") & has(v, "t") & has(v, "r")
    lab = lab.select("pos", "label", "n_sent", "v", is_kind(v, "OBJECT").alias("is_object"), (is_kind(v, "OBJECT") & full).alias("full"), has(v, "evidence").alias("has_evidence"), integer(get(v, "h")).alias("h"), integer(get(v, "t")).alias("t"), text(get(v, "r")).alias("r"), "n_ent").join(known, "r", "left")
    inside = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < F.col("n_ent")), F.lit(False))
    problem = F.when(~F.col("full"), "LABEL_REQUIRED_FIELD_MISSING").when(~(inside("h") & inside("t")), "LABEL_ENTITY_INDEX_INVALID").when(F.col("r").isNull(), "LABEL_REQUIRED_FIELD_MISSING").when(F.col("relation_name").isNull(), "UNKNOWN_RELATION_ID")
    parsed = evidence_status(get(v, "evidence"), F.col("has_evidence"), F.col("n_sent"))
    lab = cut(lab.withColumn("problem", problem).withColumn("e", parsed).withColumn("raw", F.to_json(get(v, "evidence"))).select("*", "e.status", "e.valid", "e.bad").drop("e"), "labels")
    good = lab.where("problem is null")
    merged = merge_labels(good, ["pos", "h", "r", "t"]).withColumn("gold_index", F.row_number().over(Window.partitionBy("pos").orderBy("first")) - 1)
    named = entities.select("pos", F.col("ent").cast("long").alias("ent"), "id", F.get("ms", F.lit(0))["name"].alias("name"))
    side = lambda i, n: named.select("pos", F.col("ent").alias(i), F.col("id").alias(n), F.col("name").alias(f"{n}_name"))
    gold = merged.join(ids, "pos").join(side("h", "head"), ["pos", "h"]).join(side("t", "tail"), ["pos", "t"]).join(known, "r")
    gold_out = gold.select(
        F.concat(F.lit("gold_"), "doc_id", F.format_string("_%06d", "gold_index")).alias("gold_id"), "doc_id", F.lit(split).alias("split"), "head", F.col("h").alias("head_index"), "head_name", F.col("r").alias("relation"), "relation_name",
        F.col("description").alias("relation_description"), F.col("aliases").alias("relation_aliases"), "tail", F.col("t").alias("tail_index"), "tail_name", F.transform("evidence_sent_ids", lambda i: sent_name(F.col("doc_id"), i)).alias("evidence_ids"), "evidence_sent_ids",
        F.col("status").alias("evidence_annotation_status"), F.lit("redocred_label").alias("source"), F.lit(True).alias("oracle_only"),
        F.struct(F.transform("raws", lambda x: x["label"]).alias("raw_label_indices"), F.col("r").alias("raw_relation"), F.transform("raws", lambda x: x["raw"]).alias("raw_evidence_by_label")).alias("metadata"), F.col("pos").alias("_pos"), F.col("gold_index").alias("_gold"),
    )

    n_gold = merged.groupBy("pos").agg(F.count("*").alias("label_count"))
    ent_ids = entities.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("ent", "id"))), lambda x: x["id"]).alias("entity_ids"))
    d = kept.join(ids, "pos").join(n_gold, "pos", "left").join(ent_ids, "pos", "left")
    document_out = d.select(
        "doc_id", F.lit(split).alias("split"), "title", F.col("pos").alias("raw_doc_index"), F.when(F.size("tokens") > 0, F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: sent_name(F.col("doc_id"), i))).otherwise(none).alias("sentence_ids"), F.coalesce("entity_ids", none).alias("entity_ids"), F.coalesce("label_count", F.lit(0)).alias("label_count"),
        F.struct(F.lit(source).alias("source"), F.lit(raw_file).alias("raw_file"), F.size("tokens").alias("sentence_count"), F.size("vertex").alias("entity_count"), F.size("labels").alias("raw_label_count"), "labels_available").alias("metadata"), F.col("pos").alias("_pos"),
    )

    no = F.lit(None).cast("int")

    def found(df: DataFrame, code: Column, severity: str, unit: str, step: int, ent: Column = no, men: Column = no, label: Column = no) -> DataFrame:
        return df.select("pos", F.lit(step).alias("step"), ent.cast("int").alias("ent"), men.cast("int").alias("men"), label.cast("int").alias("label"), code.alias("code"), F.lit(severity).alias("severity"), F.lit(unit).alias("affected_unit"))

    typed = fold_mentions(valid)
    conflicts = valid.join(typed.select("pos", "ent", F.col("type").alias("chosen")), ["pos", "ent"]).where("type != 'UNKNOWN' and type != chosen")
    parts = [
        found(checked.where("problem is not null"), F.col("problem"), "error", "document", 0),
        found(reached(mentions).where("problem is not null"), F.col("problem"), "error", "mention", 1, F.col("ent"), F.col("men")),
        found(reached(conflicts), F.lit("ENTITY_TYPE_CONFLICT"), "warning", "entity", 1, F.col("ent"), F.col("men")),
        found(reached(typed.where("type = 'UNKNOWN'")), F.lit("ENTITY_TYPE_UNKNOWN"), "warning", "entity", 1, F.col("ent"), F.lit(2**31 - 1)),
        found(fatal.withColumn("ent", F.col("fatal")), F.when(F.col("is_entry"), "ENTITY_ENTRY_INVALID").otherwise("ENTITY_NO_VALID_MENTION"), "error", "document", 1, F.col("fatal"), F.lit(2**31 - 1)),
        found(lab.where("problem is not null"), F.col("problem"), "error", "label", 2, label=F.col("label")),
        found(good.where("status = 'invalid' and bad = 0"), F.lit("EVIDENCE_VALUE_INVALID"), "error", "label", 2, label=F.col("label")),
        found(good.where("bad > 0").withColumn("each", F.explode(F.array_repeat(F.lit(1), F.col("bad")))), F.lit("EVIDENCE_INDEX_INVALID"), "error", "label", 2, label=F.col("label")),
        found(good.join(merged.select("pos", "h", "r", "t", "first"), ["pos", "h", "r", "t"]).where("label > first"), F.lit("DUPLICATE_LABEL_MERGED"), "warning", "label", 3, label=F.col("label")),
    ]
    diagnostics = cut(reduce(lambda a, b: a.unionByName(b), parts), "diagnostics")
    order = ["pos", F.least("step", F.lit(2)), F.coalesce("ent", F.lit(-1)), F.coalesce("men", F.lit(-1)), F.coalesce("label", F.lit(-1)), "step"]
    if strict:
        first = diagnostics.where("severity = 'error'").orderBy(*order).limit(1).collect()
        if first:
            raise AdapterError(first[0].code, f"document {first[0].pos}", first[0].affected_unit)

    tables = {"documents": document_out, "entities": entity_out, "evidence": evidence_out, "gold_triples": gold_out}
    n = {k: df.count() for k, df in tables.items()}
    by_code = {s: {r.code: r["count"] for r in diagnostics.where(F.col("severity") == s).groupBy("code").count().orderBy("code").collect()} for s in ("warning", "error")}
    statuses = {s: 0 for s in ("present", "empty", "missing", "invalid")} | {r.status: r["count"] for r in merged.groupBy("status").count().collect()}
    raw_mentions = reached(sizes).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    raw_docs = checked.count()
    unknown = lab.where("problem = 'UNKNOWN_RELATION_ID'").groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct("pos", "label")).alias("o")).orderBy("o").collect()
    stats = {
        "split": split, "raw_file": raw_file, "strict": strict, "document_count_raw": raw_docs, "document_count_written": n["documents"], "document_count_skipped": raw_docs - n["documents"], "sentence_count": n["evidence"], "entity_count": n["entities"],
        "mention_count_raw": raw_mentions, "mention_count_written": entity_out.agg(F.coalesce(F.sum(F.size("mentions")), F.lit(0)).alias("n")).first().n, "label_count_raw": lab.count(), "gold_triple_count": n["gold_triples"],
        "duplicate_label_count": by_code["warning"].get("DUPLICATE_LABEL_MERGED", 0), "skipped_label_count": lab.where("problem is not null").count(), "relations": {r.r: r["count"] for r in merged.groupBy("r").count().orderBy("r").collect()},
        "unknown_relation_ids": [{"relation_id": r.r, "count": r.n, "split": split} for r in unknown], "evidence": statuses, "warning_counts": by_code["warning"], "error_counts": by_code["error"],
        "diagnostics": [{"code": r.code, "severity": r.severity, "split": split, "raw_doc_index": r.pos, "raw_entity_index": r.ent, "raw_mention_index": None if r.men == 2**31 - 1 else r.men, "raw_label_index": r.label, "affected_unit": r.affected_unit} for r in diagnostics.orderBy(*order).collect()],
    }
    each = sound.select("pos", F.posexplode("vertex").alias("ent", "e")).where(is_kind(F.col("e"), "ARRAY")).select("pos", "ent", F.posexplode(items(F.col("e"))).alias("men", "m"))
    raw_objects = reached(each).where(is_kind(F.col("m"), "OBJECT")).select("pos", "ent", "men", F.to_json("m").alias("j"))
    summary = {"split": split, "raw_file": raw_file, "top_level_type": "list", "sentence_shape": sentence_shapes(checked), "labels_available": n["documents"] > 0 and document_out.where("not metadata.labels_available").isEmpty(), "evidence_field_available": not lab.where("is_object").isEmpty() and lab.where("is_object and not has_evidence").isEmpty(), "top_level_fields": first_keys(checked.where("is_object").select(F.struct("pos").alias("o"), F.to_json("doc").alias("j"))), "mention_fields": first_keys(raw_objects.select(F.struct("pos", "ent", "men").alias("o"), "j")), "label_fields": first_keys(lab.where("is_object").select(F.struct("pos", "label").alias("o"), F.to_json("v").alias("j"))), "relation_metadata_record_count": metadata.count(), "warnings": list(dict.fromkeys(x["code"] for x in stats["diagnostics"] if x["severity"] == "warning"))}
    return Converted(tables, diagnostics, stats, summary)


def sentence_shapes(checked: DataFrame) -> dict[str, int]:
    """How many sentences of each shape the documents hold, rejected ones included."""
    s = checked.where("is_object and title is not null").select(F.explode("sents").alias("s"))
    list_ = items(F.col("s"))
    shape = F.when(list_.isNull(), "non_list").when(F.size(list_) == 0, "empty_token_list").when(_all(list_, lambda t: is_kind(t, "STRING")), "list_of_string_tokens").otherwise("list_with_non_string_token")
    zero = dict.fromkeys(("list_of_string_tokens", "empty_token_list", "non_list", "list_with_non_string_token"), 0)
    return zero | {r.shape: r["count"] for r in s.select(shape.alias("shape")).groupBy("shape").count().collect()}


def first_keys(objects: DataFrame) -> list[str]:
    """Keys of JSON objects (o: order, j: text) in the order in which they are first seen."""
    keys = objects.select("o", F.posexplode(F.json_object_keys("j")).alias("i", "key"))
    return [r.key for r in keys.groupBy("key").agg(F.min(F.struct("o", "i")).alias("first")).orderBy("first").collect()]


def check_tables(tables: dict[str, DataFrame]) -> None:
    """Exact columns, unique ids and references among the four tables."""
    plain = {k: df.drop(*[c for c in df.columns if c.startswith("_")]) for k, df in tables.items()}
    for name, df in plain.items():
        require_columns(df, COLUMNS[name], name)
    for name, key in (("documents", "doc_id"), ("entities", "id"), ("evidence", "id"), ("gold_triples", "gold_id")):
        must_be_empty(duplicate_keys(plain[name], key), f"duplicate {key} in {name}")
    docs = plain["documents"]
    for name in ("entities", "evidence", "gold_triples"):
        must_be_empty(orphans(plain[name].select("doc_id"), "doc_id", docs, "doc_id"), f"{name} of unknown documents")
    for end in ("head", "tail"):
        must_be_empty(orphans(plain["gold_triples"].select(end), end, plain["entities"], "id"), f"gold triples of unknown {end}")
    must_be_empty(orphans(plain["gold_triples"].select(F.explode("evidence_ids").alias("e")), "e", plain["evidence"], "id"), "gold triples of unknown evidence")
    must_be_empty(orphans(plain["evidence"].select(F.explode("related_entities").alias("e")), "e", plain["entities"], "id"), "evidence of unknown entities")
    must_be_empty(orphans(plain["entities"].select(F.explode("mentions.sentence_id").alias("s")), "s", plain["evidence"], "id"), "mentions in unknown sentences")


def inference_view(gold: DataFrame) -> DataFrame:
    """Gold triples without what only an evaluation may see."""
    return gold.drop(*ORACLE_COLUMNS)


ORDER = {"documents": ["_pos"], "entities": ["_pos", "_ent"], "evidence": ["_pos", "_sent"], "gold_triples": ["_pos", "_gold"]}


def process_split(spark, path: str, metadata: DataFrame, split: str, target: str, source: str = "redocred", strict: bool = True, max_docs: int | None = None) -> dict[str, Any]:
    """One split from raw file to a committed folder; returns its stats."""
    done = convert(read_split(spark, path, max_docs), metadata, split, path.rsplit("/", 1)[-1], source, strict)
    s = done.stats
    if s["label_count_raw"] != s["gold_triple_count"] + s["duplicate_label_count"] + s["skipped_label_count"]:
        raise AdapterError("OUTPUT_WRITE_OR_VALIDATION_FAILED", "label counts do not close", "split")
    commit(done.tables, {"stats": s, "schema_summary": done.summary}, target, check_tables, ORDER)
    return s


def process(spark, metadata_path: str, out_dir: str, files: dict[str, str | None], split: str | None = None, source: str = "redocred", strict: bool = True, max_docs: int | None = None) -> dict[str, Any]:
    """All chosen splits; in lenient mode a split that fails leaves the others alone."""
    metadata = read_relation_metadata(spark, metadata_path)
    out: dict[str, Any] = {}
    for name, path in select_splits(files, split).items():
        try:
            out[name] = process_split(spark, path, metadata, name, f"{out_dir}/{name}", source, strict, max_docs)
        except Exception as e:
            if strict:
                raise
            out[name] = {"error": str(e)}
    return out
