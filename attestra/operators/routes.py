"""Recall routes: each maps the knowledge graph to scored pairs that it has something to say on.

A route's result has relation, head, tail, score, source and debug columns of its own.
Scores of constant weights are decimals, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import attribute_tokens
from attestra.operators import graph
from attestra.operators.checks import links
from attestra.sources.shared import cut

#: Fixed values. What source-specific rules ask of shared evidence: relation -> (sources, one of these texts, none for any).
SOURCE_RULES: dict[str, tuple[list[str], list[str]]] = {
    "owned_by": (["ticket", "alert"], []),
    "depends_on": (["service_dependency"], []),
    "runs_on": (["dns", "ticket", "alert"], [" on ", "maps", "fired on"]),
}

#: Fixed value. About how many pairs, counted once a shared evidence, a task groups.
SHARE = 1 << 19


def dec(c: Column | float | str) -> Column:
    return (F.lit(c) if not isinstance(c, Column) else c).cast("decimal(12,6)")


def capped(n: Column, cap: str, base: str, step: str) -> Column:
    """least(cap, base + step * n) for n > 0, else null: least() alone would pass over a null n."""
    return F.when(n > 0, F.least(dec(F.lit(cap)), dec(F.lit(base)) + dec(F.lit(step)) * n)).cast("decimal(12,6)")


def togetherness(n: Column) -> Column:
    """Score of n shared evidences."""
    return capped(n, "0.5", "0.18", "0.08")


def likeness(jaccard: Column) -> Column:
    return F.least(F.lit(0.35), F.lit(0.1) + jaccard).cast("decimal(12,6)")


def legal_ends(entities: DataFrame, specs: DataFrame, side: str) -> DataFrame:
    """(relation, id, type) of the entities whose type the relation allows at that end."""
    types = specs.select("relation", F.explode(f"{side}_types").alias("type"))
    return entities.select("id", "type").join(F.broadcast(types), "type").select("relation", "id", "type").distinct()


def alike(specs: DataFrame, route: str) -> list[list[str]]:
    """Relations that enable a route, those of the same types together. specs is configuration, so the driver reads it."""
    groups: dict[tuple, list[str]] = {}
    for r in specs.select("relation", "head_types", "tail_types", "recall_routes").collect():
        if route in r.recall_routes:
            groups.setdefault((frozenset(r.head_types), frozenset(r.tail_types)), []).append(r.relation)
    return list(groups.values())


def alike_hubs(specs: DataFrame, ends: tuple[DataFrame, DataFrame]) -> list[tuple[list[str], tuple[DataFrame, DataFrame]]]:
    """Relations of the same types that enable a route over neighbors, and their ends."""
    groups: dict[tuple, list[str]] = {}
    for r in specs.select("relation", "head_types", "tail_types", "recall_routes").collect():
        if {"path_rule", "common_neighbor"} & set(r.recall_routes):
            groups.setdefault((frozenset(r.head_types), frozenset(r.tail_types)), []).append(r.relation)
    return [(relations, tuple(e.where(F.col("relation").isin(relations)) for e in ends)) for relations in groups.values()]


def legal_pairs(ends: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(relation, head, tail) of every legal pair, for relations whose ends are few; the routes never build it."""
    heads, tails = (e.select("relation", F.col("id").alias(n)) for e, n in zip(ends, ("head", "tail")))
    return heads.join(tails, "relation").where("head != tail")


def _with_relations(pairs: DataFrame, ends: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Pairs (head, tail, ...) by relation, for those relations that allow both ends."""
    heads, tails = (e.select("relation", F.col("id").alias(n)) for e, n in zip(ends, ("head", "tail")))
    return pairs.where("head != tail").join(heads, "head").join(tails, ["relation", "tail"])


def _all(ends: DataFrame) -> DataFrame:
    return ends.select("id").distinct()


def by_path(edges: DataFrame, ends: tuple[DataFrame, DataFrame]) -> DataFrame:
    found = graph.reachable(edges, _all(ends[0]), _all(ends[1]))
    score = F.when(F.col("hops") <= 2, dec(F.lit("0.45"))).otherwise(dec(F.lit("0.25")))
    return _with_relations(found, ends).select("relation", "head", "tail", score.alias("score"), F.col("hops").alias("shortest_path_len"))


def by_common_neighbor(triples: DataFrame, ends: tuple[DataFrame, DataFrame]) -> DataFrame:
    found = graph.common_neighbors(graph.neighbors(triples), _all(ends[0]), _all(ends[1]))
    n = F.size("common")
    return _with_relations(found, ends).select("relation", "head", "tail", capped(n, "0.3", "0.12", "0.04").alias("score"), n.alias("common_neighbor_count"), F.slice("common", 1, 8).alias("common_neighbors"))


def shared_evidence(evidence: DataFrame, ends: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(relation, head, tail, evidence_id, seq) for each evidence that names both ends."""
    mentions = links(evidence)
    h = mentions.join(_all(ends[0]).withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select("evidence_id", "seq", F.col("entity_id").alias("head"))
    t = mentions.join(_all(ends[1]).withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").select("evidence_id", F.col("entity_id").alias("tail"))
    return _with_relations(h.join(t, "evidence_id"), ends)


def named(evidence: DataFrame, sides: dict[str, DataFrame]) -> DataFrame:
    """(evidence_id, seq, an array for each of sides) of the ids, columns `id`, that an evidence names, each once. One pass for all sides."""
    each = evidence.select(F.col("id").alias("evidence_id"), "seq", F.explode("related_entities").alias("entity_id"))
    for side, ids in sides.items():
        each = each.join(ids.select(F.col("id").alias("entity_id"), F.lit(True).alias(side)), "entity_id", "left")
    each = each.where(F.coalesce(*sides))
    return each.groupBy("evidence_id").agg(F.first("seq").alias("seq"), *(F.collect_set(F.when(F.col(side), F.col("entity_id"))).alias(side) for side in sides))


def grouped(rows: DataFrame) -> DataFrame:
    """(head, tail, evidence_count, attribute, rule, edge) by pairs of rows (head, tails, the same): counts are summed, of the others the largest is kept.

    Tails travel as arrays to their head's task and meet there, so single pairs are not shuffled. Heads
    of more than SHARE tails are split by tails over several tasks.
    """
    load = cut(rows.groupBy("head").agg(F.sum(F.size("tails")).alias("load")), "load")
    total = load.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    large = load.where(F.col("load") > SHARE).select("head", F.ceil(F.col("load") / SHARE).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(large), "head", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    mine = F.filter("tails", lambda t: F.pmod(F.xxhash64(t), F.col("parts")) == F.col("part"))
    dealt = dealt.withColumn("tails", F.when(F.col("parts").isNull(), F.col("tails")).otherwise(mine)).drop("parts")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARE + 1)
    pairs = dealt.repartition(tasks, "head", "part").withColumn("tail", F.explode("tails")).where("head != tail")
    return pairs.groupBy("head", "part", "tail").agg(F.sum("evidence_count").alias("evidence_count"), *(F.max(c).alias(c) for c in ("attribute", "rule", "edge"))).drop("part")


def by_cooccurrence(shared: DataFrame) -> DataFrame:
    found = shared.groupBy("relation", "head", "tail").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "evidence_id"))).alias("ids"))
    first = F.transform(F.slice("ids", 1, 8), lambda x: x["evidence_id"])
    return found.select("relation", "head", "tail", togetherness(F.col("n")).alias("score"), F.col("n").cast("int").alias("evidence_count"), first.alias("evidence_ids"))


def by_source(shared: DataFrame, evidence: DataFrame, rules: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    facts = evidence.select(F.col("id").alias("evidence_id"), "source", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    rule = F.lit(False)
    for relation, (sources, texts) in (SOURCE_RULES if rules is None else rules).items():
        says = F.lit(not texts)
        for x in texts:
            says = says | F.contains("text", F.lit(x))
        rule = rule | ((F.col("relation") == relation) & F.col("source").isin(sources) & says)
    found = shared.join(facts, "evidence_id").where(rule).groupBy("relation", "head", "tail").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("source_hits"))
    return found.select("relation", "head", "tail", capped(F.col("n"), "0.75", "0.45", "0.1").alias("score"), "source_hits")


def attribute_overlap(entities: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """(head, tail, shared, jaccard) of legal pairs with a token in common, by a join on tokens."""
    sets = entities.select("id", attribute_tokens(F.col("id"), F.col("name"), F.col("aliases"), F.col("properties")).alias("tokens"))
    rows = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    h = rows.join(heads, "id", "left_semi").select("token", F.col("id").alias("head"), F.col("n").alias("head_n"))
    t = rows.join(tails, "id", "left_semi").select("token", F.col("id").alias("tail"), F.col("n").alias("tail_n"))
    both = h.join(t, "token").where("head != tail").groupBy("head", "tail", "head_n", "tail_n").agg(F.array_sort(F.collect_list("token")).alias("shared"))
    return both.select("head", "tail", "shared", (F.size("shared") / (F.col("head_n") + F.col("tail_n") - F.size("shared"))).alias("jaccard"))


def by_attributes(entities: DataFrame, ends: tuple[DataFrame, DataFrame]) -> DataFrame:
    found = attribute_overlap(entities, _all(ends[0]), _all(ends[1]))
    return _with_relations(found, ends).select("relation", "head", "tail", likeness(F.col("jaccard")).alias("score"), F.bround("jaccard", 4).alias("attribute_similarity"), F.col("shared").alias("shared_tokens"))


def schema_fillers(ends: tuple[DataFrame, DataFrame], specs: DataFrame, triples: DataFrame, sparse: DataFrame) -> DataFrame:
    """Legal pairs that only the type route speaks for, as many of the first (by head, tail) as a top list may need.

    Every pair that another route hits outranks them, so a relation with max_candidates of
    those needs none, and the space of all legal pairs is never built: enough are the first
    2 * max_candidates heads that have a free tail, and as many tails more as they have edges.
    """
    typed = specs.where(F.array_contains("recall_routes", F.lit("schema_type"))).select("relation", "max_candidates", "allow_existing")
    hits = sparse.groupBy("relation").agg(F.count("*").alias("hits"))
    open_ = F.broadcast(typed.join(hits, "relation", "left").where(F.coalesce("hits", F.lit(0)) < F.col("max_candidates")).withColumn("need", F.col("max_candidates") * 2))
    heads, tails = (e.select("relation", F.col("id").alias(n)).join(open_.select("relation", "need", "allow_existing"), "relation") for e, n in zip(ends, ("head", "tail")))
    taken = triples.select("relation", "head", "tail").distinct().join(F.broadcast(open_.where("not allow_existing").select("relation")), "relation", "left_semi")
    busy = taken.join(tails.select("relation", "tail"), ["relation", "tail"], "left_semi").groupBy("relation", "head").agg(F.count("*").alias("busy"))
    own = tails.select("relation", F.col("tail").alias("head"), F.lit(1).alias("own"))
    n_tails = F.broadcast(tails.groupBy("relation").agg(F.count("*").alias("n_tails")))
    free = heads.join(busy, ["relation", "head"], "left").join(own, ["relation", "head"], "left").join(n_tails, "relation")
    free = free.where(F.col("n_tails") - F.coalesce("busy", F.lit(0)) - F.coalesce("own", F.lit(0)) > 0)
    by = Window.partitionBy("relation")
    first = free.withColumn("k", F.row_number().over(by.orderBy("head"))).where(F.col("k") <= F.col("need"))
    room = first.groupBy("relation").agg((F.max(F.coalesce("busy", F.lit(0))) + F.max("need") + 1).alias("room"))
    some = tails.select("relation", "tail").withColumn("k", F.row_number().over(by.orderBy("tail"))).join(F.broadcast(room), "relation").where(F.col("k") <= F.col("room")).select("relation", "tail")
    pairs = first.select("relation", "head").join(some, "relation").where("head != tail")
    return pairs.join(taken, ["relation", "head", "tail"], "left_anti").join(sparse.select("relation", "head", "tail"), ["relation", "head", "tail"], "left_anti")
