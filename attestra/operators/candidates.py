"""Candidate generation, ranking and windows."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from attestra.config import ROUTES, Task
from attestra.operators import dense, graph, routes
from attestra.operators.checks import links
from attestra.operators.routes import dec
from attestra.sources.shared import cut

KEY = ["relation", "head", "tail"]
#: Fixed value. Of so many times a relation's candidates the first are looked at before pairs are ruled out; results do not depend on it.
FIRST = 64
#: Debug fields of each route, in the routes' order.
DEBUG = {
    "schema_type": ["head_type", "tail_type"],
    "path_rule": ["shortest_path_len"],
    "common_neighbor": ["common_neighbor_count", "common_neighbors"],
    "evidence_cooccurrence": ["evidence_count", "evidence_ids"],
    "attribute_similarity": ["attribute_similarity", "shared_tokens"],
    "source_specific_rule": ["source_hits"],
}

DEBUG_TYPES = {"shortest_path_len": "int", "common_neighbor_count": "int", "common_neighbors": "array<string>", "evidence_count": "int", "evidence_ids": "array<string>", "attribute_similarity": "double", "shared_tokens": "array<string>", "source_hits": "array<string>"}


def multi_route(kg: dict[str, DataFrame], specs: DataFrame) -> DataFrame:
    """Ranked candidates of all relations: the best max_candidates of each, numbered through.

    candidate_id, ord, relation, head, tail, candidate_score, recall_sources, debug.
    """
    kg = kg | {"triples": cut(kg["triples"].select(*KEY), "triples")}  # several routes read them
    ends = tuple(routes.legal_ends(kg["entities"], specs, side) for side in ("head", "tail"))
    rows = specs.select("relation", "head_types", "tail_types", "recall_routes", "max_candidates", "allow_existing").collect()  # specs is configuration
    kinds = {frozenset(t): f"ids{i}" for i, t in enumerate({frozenset(t): t for r in rows for t in (r.head_types, r.tail_types)}.values())}
    sides = {name: cut(kg["entities"].where(F.col("type").isin(list(types))).select("id").distinct(), name) for types, name in kinds.items()}
    groups: dict[tuple[str, str], list] = {}
    for r in rows:
        groups.setdefault((kinds[frozenset(r.head_types)], kinds[frozenset(r.tail_types)]), []).append(r)
    asked = {side for pair, some in groups.items() for side in pair if any(_evident(r) for r in some)}
    evidence = cut(routes.named(kg["evidence"], {n: sides[n] for n in sides if n in asked}), "named") if asked else None
    parts = [part for pair, some in groups.items() for part in _best_of_group(kg, evidence, pair, sides, some)]
    return rank_routes(parts, kg, specs, ends, evidence, {r.relation: pair for pair, some in groups.items() for r in some})


def _evident(r: Row) -> bool:
    return "evidence_cooccurrence" in r.recall_routes or _ruled(r)


def _ruled(r: Row) -> bool:
    return "source_specific_rule" in r.recall_routes and r.relation in routes.SOURCE_RULES


def _shared(evidence: DataFrame, pair: tuple[str, str], relation: str) -> DataFrame:
    """(relation, head, tail, evidence_id, seq) for each evidence that names both ends."""
    heads = evidence.select("evidence_id", "seq", F.explode(pair[0]).alias("head"), F.col(pair[1]).alias("tails"))
    return heads.select(F.lit(relation).alias("relation"), "head", F.explode("tails").alias("tail"), "evidence_id", "seq").where("head != tail")


def _best_of_group(kg: dict[str, DataFrame], evidence: DataFrame | None, pair: tuple[str, str], sides: dict[str, DataFrame], some: list[Row]) -> list[DataFrame]:
    """For each relation of the same types its pairs that can be among the best, all of those that it has if they are fewer.

    relation, head, tail, score, hit, and what the two routes over neighbors say; pairs that exist are left out.
    """
    heads, tails = (sides[n] for n in pair)
    enabled = {route for r in some for route in r.recall_routes}
    hubs = bool({"path_rule", "common_neighbor"} & enabled)
    linked = dense.link(cut(dense.narrowed(kg["triples"], heads, tails), "edges"), heads, tails) if hubs else None
    said = []
    if "evidence_cooccurrence" in enabled:
        said.append(_say(evidence.select(F.explode(pair[0]).alias("head"), F.col(pair[1]).alias("tails")).where(F.size("tails") > 0), evidence_count=F.lit(1)))
    if "attribute_similarity" in enabled:
        found = routes.attribute_overlap(kg["entities"], heads, tails).select("head", F.array("tail").alias("tails"), routes.likeness(F.col("jaccard")).alias("score"))
        said.append(_say(cut(found, "alike"), attribute=F.col("score")))
    if linked is not None and "path_rule" in enabled:
        said.append(_say(linked.direct.select("head", F.array("tail").alias("tails")), edge=F.lit(1)))
    out = []
    common = None
    for r in some:
        classed = linked is not None and bool({"path_rule", "common_neighbor"} & set(r.recall_routes))
        taken = None if r.allow_existing else kg["triples"].where(F.col("relation") == r.relation)
        own = common
        if _ruled(r):  # what rules say is the relation's own
            ruled = routes.by_source(_shared(evidence, pair, r.relation), kg["evidence"]).select("head", F.array("tail").alias("tails"), "score")
            own = routes.grouped(reduce(DataFrame.unionByName, [*said, _say(cut(ruled, "ruled"), rule=F.col("score"))]))
            own = cut(own, "own") if classed else own
        elif own is None and said:
            own = routes.grouped(reduce(DataFrame.unionByName, said))
            if len(some) > 1 or classed:
                own = common = cut(own, "own")
        scored = None if own is None else _own_score(own, r)
        if classed:
            out += _best_with_classes(scored, r, taken, linked)
        elif scored is not None:
            out.append(_first_free(scored.drop("edge"), [F.desc(_total(F.col("score"), r)), "head", "tail"], taken, r))
    return out


def _say(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows of head and tails as routes.grouped takes them: what is not given is null."""
    kinds = {"evidence_count": "long", "attribute": "decimal(12,6)", "rule": "decimal(12,6)", "edge": "int"}
    return rows.select("head", "tails", *(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))


def _total(score: Column, r: Row) -> Column:
    """The candidate's score as it is ranked."""
    return F.bround(score + dec(F.lit("0.05" if "schema_type" in r.recall_routes else "0")), 4)


def _own_score(own: DataFrame, r: Row) -> DataFrame:
    """(relation, head, tail, score, hit, edge) of the pairs on which routes that r enables have something to say, those over neighbors but for direct edges left out."""
    scores = {"evidence_cooccurrence": routes.togetherness(F.col("evidence_count")), "attribute_similarity": F.col("attribute"), "source_specific_rule": F.col("rule")}
    scores = {k: v for k, v in scores.items() if k in r.recall_routes}
    edge = F.col("edge") if "path_rule" in r.recall_routes else F.lit(None).cast("int")
    score, hit = _summed({k: (v, None) for k, v in scores.items()}) if scores else (dec(0), F.array().cast("array<string>"))
    return own.select(F.lit(r.relation).alias("relation"), "head", "tail", score.cast("decimal(18,6)").alias("score"), hit.alias("hit"), edge.alias("edge")).where((F.size("hit") > 0) | (F.col("edge") == 1))


def _free(pairs: DataFrame, taken: DataFrame | None) -> DataFrame:
    if taken is None:
        return pairs
    return pairs.join(taken.join(pairs.select(*KEY), KEY, "left_semi").distinct(), KEY, "left_anti")  # the pairs are mostly the smaller side


def _first_free(scored: DataFrame, by: list, taken: DataFrame | None, r: Row) -> DataFrame:
    """The first of scored that do not exist: max_candidates at least, or all."""
    n = FIRST * r.max_candidates
    while True:
        some = cut(scored.orderBy(*by).limit(n), "first")
        free = _free(some, taken)
        if free.count() >= r.max_candidates or some.count() < n:
            return free
        n *= FIRST


def _best_with_classes(scored: DataFrame | None, r: Row, taken: DataFrame | None, linked: dense.Dense) -> list[DataFrame]:
    """Pairs that can be among the best of a relation for which neighbors speak, too.

    The first by what their routes say and their classes may add are scored whole; no pair that
    falls behind max_candidates of these, even with all that classes may add, can be among the best. Pairs that owe
    all to their classes have one score for two classes (see dense), so the first of them are made, and only where
    their score is enough.
    """
    on = {route: F.lit(route in r.recall_routes) for route in ("path_rule", "common_neighbor")}
    told = _class_said(on, F.col("hops"))
    score, hit = _summed(told)
    values = [score.cast("decimal(18,6)").alias("score"), hit.alias("hit"), *(d.alias(route) for route, (_, d) in told.items())]
    classes = linked.pairs.withColumn("relation", F.lit(r.relation)).where(F.size(hit) > 0)
    most = classes.agg(F.coalesce(F.max(score), dec(0)).alias("most")).first()["most"]
    caps = sum((Decimal(c) for route, c in (("path_rule", "0.45"), ("common_neighbor", "0.3")) if route in r.recall_routes), Decimal(0))
    may = _total(F.col("score") + F.when(F.col("edge") == 1, dec(F.lit(str(caps)))).otherwise(dec(F.lit(str(most)))), r)
    parts, least = [], None

    def whole(pairs: DataFrame) -> DataFrame:
        told = _class_said(on, F.when(F.col("edge") == 1, F.lit(1)).otherwise(F.col("hops")))
        more, near = _summed(told)
        return _free(dense.place(pairs, linked).select(*KEY, (F.col("score") + more).alias("score"), F.concat("hit", near).alias("hit"), *(d.alias(route) for route, (_, d) in told.items())), taken)

    if scored is not None:
        some = _first_free(scored, [F.desc(may), "head", "tail"], taken, r)
        totals = whole(some).select(_total(F.col("score"), r).alias("total")).orderBy(F.desc("total")).limit(r.max_candidates).collect()
        if len(totals) == r.max_candidates and totals:
            least = totals[-1].total
        parts.append(cut(whole(cut(scored if least is None else scored.where(may >= F.lit(least)), "able")), "scored"))
    if least is not None:
        classes = cut(classes.where(_total(score, r) >= F.lit(least)), "able-classes")
        if classes.isEmpty():
            return parts
    cells = classes.select("head_class", "tail_class").distinct()
    known = [x for x in (None if scored is None else scored.select(*KEY), None if taken is None else taken.select(*KEY)) if x is not None]
    known = reduce(DataFrame.unionByName, known) if known else None
    if known is not None:
        known = dense.place(known, linked).where("hops is not null").join(cells, ["head_class", "tail_class"], "left_semi").select(*KEY, *dense.CELL)
    parts.append(dense.expand(linked, values, ["relation"], classes, known, r.max_candidates))
    return parts


def _class_said(on: dict[str, Column], hops: Column) -> dict[str, tuple[Column, Column]]:
    """Score and debug struct of the two routes over neighbors, from a pair's hops and its classes' common; null where a route is silent."""
    n = F.size("common")
    path = on["path_rule"] & hops.isNotNull()
    near = on["common_neighbor"] & (n > 0)
    return {
        "path_rule": (F.when(path, F.when(hops <= 2, dec(F.lit("0.45"))).otherwise(dec(F.lit("0.25")))), F.when(path, F.struct(hops.cast("int").alias("shortest_path_len")))),
        "common_neighbor": (F.when(near, routes.capped(n, "0.3", "0.12", "0.04")), F.when(near, F.struct(n.alias("common_neighbor_count"), F.slice("common", 1, 8).alias("common_neighbors")))),
    }


def _summed(said: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Sum of the scores of the two routes, and the names of those that speak."""
    score = reduce(lambda a, b: a + b, (F.coalesce(s, dec(0)) for s, _ in said.values()))
    return score, F.filter(F.array(*(F.when(s.isNotNull(), F.lit(r)) for r, (s, _) in said.items())), lambda r: r.isNotNull())


def rank_routes(parts: list[DataFrame], kg: dict[str, DataFrame], specs: DataFrame, ends: tuple[DataFrame, DataFrame], evidence: DataFrame | None, pairs_of: dict[str, tuple[str, str]]) -> DataFrame:
    """The best of the pairs that routes hit and, where these are too few, of those that only the type route speaks for."""
    enabled = F.broadcast(specs.select("relation", "recall_routes", "allow_existing", "max_candidates", "ord"))
    none = kg["triples"].where("false").select(*KEY, dec(0).cast("decimal(18,6)").alias("score"), F.array().cast("array<string>").alias("hit"), F.lit(None).cast("struct<shortest_path_len:int>").alias("path_rule"), F.lit(None).cast("struct<common_neighbor_count:int,common_neighbors:array<string>>").alias("common_neighbor"))
    sparse = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, none), "hits")
    hits = {r.relation: r["count"] for r in sparse.groupBy("relation").count().collect()}
    lacking = [r.relation for r in specs.select("relation", "max_candidates", "recall_routes").collect() if "schema_type" in r.recall_routes and hits.get(r.relation, 0) < r.max_candidates]
    pairs = sparse
    if lacking:
        own = [e.where(F.col("relation").isin(lacking)) for e in ends]
        pairs = sparse.unionByName(routes.schema_fillers(tuple(own), specs.where(F.col("relation").isin(lacking)), kg["triples"], sparse), allowMissingColumns=True)
    pairs = pairs.join(enabled, "relation")
    typed = F.array_contains("recall_routes", F.lit("schema_type"))
    score = F.coalesce("score", dec(0)) + F.when(typed, dec(F.lit("0.05"))).otherwise(dec(0))
    total = F.bround(score, 4).cast("double")
    hit = F.coalesce("hit", F.array().cast("array<string>"))
    sources = F.filter(F.array(*map(F.lit, ROUTES)), lambda r: F.array_contains(hit, r) | ((r == "schema_type") & typed))
    best = Window.partitionBy("relation").orderBy(F.desc("candidate_score"), "head", "tail")
    top = pairs.withColumn("candidate_score", total).withColumn("recall_sources", sources).withColumn("k", F.row_number().over(best)).where(F.col("k") <= F.col("max_candidates"))
    top = cut(top, "best")  # max_candidates rows a relation at most
    kinds = kg["entities"].select("id", "type")
    for side in ("head", "tail"):
        ids = top.select(F.col(side).alias("id")).distinct()
        top = top.join(kinds.join(F.broadcast(ids), "id", "left_semi").select(F.col("id").alias(side), F.col("type").alias(f"{side}_type")), side, "left")
    for route, of in _details(top, kg, evidence, pairs_of).items():
        said = F.when(F.array_contains("recall_sources", F.lit(route)), F.col("said"))
        top = top.join(of.select(*KEY, F.struct(*DEBUG[route]).alias("said")), KEY, "left").withColumn(route, said).drop("said")
    said = [F.col(f"{r}.{c}").alias(c) if r in top.columns else F.lit(None).cast(DEBUG_TYPES.get(c, "string")).alias(c) for r in DEBUG if r != "schema_type" for c in DEBUG[r]]
    debug = F.struct(F.when(typed, F.col("head_type")).alias("head_type"), F.when(typed, F.col("tail_type")).alias("tail_type"), *said)
    through = Window.orderBy("ord", "k")  # max_candidates rows a relation at most
    return top.withColumn("seq", F.row_number().over(through)).select(F.format_string("cand_%06d", "seq").alias("candidate_id"), "seq", *KEY, "candidate_score", "recall_sources", debug.alias("debug"))


def _details(top: DataFrame, kg: dict[str, DataFrame], evidence: DataFrame | None, pairs_of: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """What routes over evidence and attributes have to say on the best pairs: relation, head, tail and the route's debug fields."""
    keys = top.select(*KEY, "recall_sources")
    spoke = {r: {x.relation for x in keys.where(F.array_contains("recall_sources", F.lit(r))).select("relation").distinct().collect()} for r in ("evidence_cooccurrence", "source_specific_rule", "attribute_similarity")}
    out = {}
    named = []
    for relation in sorted(spoke["evidence_cooccurrence"] | spoke["source_specific_rule"]):
        heads, tails = pairs_of[relation]
        mine = F.broadcast(keys.where(F.col("relation") == relation).select(*KEY))
        each = evidence.select("evidence_id", "seq", F.explode(heads).alias("head"), F.col(tails).alias("tails")).join(mine, "head")
        named.append(each.where(F.array_contains("tails", F.col("tail"))).select(*KEY, "evidence_id", "seq"))
    if named:
        shared = reduce(DataFrame.unionByName, named)
        out["evidence_cooccurrence"] = routes.by_cooccurrence(shared)
        if spoke["source_specific_rule"]:
            out["source_specific_rule"] = routes.by_source(shared, kg["evidence"])
    if spoke["attribute_similarity"]:
        mine = keys.where(F.array_contains("recall_sources", F.lit("attribute_similarity")))
        some = [mine.select(F.col(s).alias("id")).distinct() for s in ("head", "tail")]
        few = kg["entities"].join(F.broadcast(some[0].unionByName(some[1]).distinct()), "id", "left_semi")
        found = routes.attribute_overlap(few, *some)
        out["attribute_similarity"] = mine.select(*KEY).join(found, ["head", "tail"]).select(*KEY, F.bround("jaccard", 4).alias("attribute_similarity"), F.col("shared").alias("shared_tokens"))
    return out


def single_relation(kg: dict[str, DataFrame], task: Task) -> DataFrame:
    """Candidates of one relation by the task's rules, best first, with paths and common neighbors.

    Only pairs that a rule hits are ever built. seq is the rank.
    """
    rules = task.candidate_rules
    entities = kg["entities"]
    ends = [entities.where(F.col("type").isin(t)).select("id") for t in (task.allowed_head_types, task.allowed_tail_types)]
    edges = graph.ranked_edges(kg["triples"], entities)
    found = graph.first_paths(graph.simple_paths(edges, ends[0], ends[1], task.retrieval.max_hops), task.retrieval.max_paths)
    paths = found.groupBy("head", "tail").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("paths"), F.min("hops").alias("shortest"))
    common = graph.common_neighbors(graph.neighbors(kg["triples"]), ends[0], ends[1])
    mentions = links(kg["evidence"]).select("evidence_id", "entity_id")
    h = mentions.join(ends[0].withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").withColumnRenamed("entity_id", "head")
    t = mentions.join(ends[1].withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").withColumnRenamed("entity_id", "tail")
    overlap = h.join(t, "evidence_id").where("head != tail").select("head", "tail").distinct().withColumn("overlap", F.lit(1))
    pairs = paths.join(common, ["head", "tail"], "full").join(overlap, ["head", "tail"], "full").where("head != tail")
    pairs = graph.existing(pairs.withColumn("relation", F.lit(task.target_relation)), kg["triples"], keep=False)
    scores = {
        "two_hop_path": F.when(F.col("shortest") <= 2, dec(F.lit("0.4"))).when(F.col("shortest").isNotNull(), dec(F.lit("0.25"))),
        "common_neighbor": routes.capped(F.size("common"), "0.3", "0.15", "0.05"),
        "evidence_overlap": F.when(F.col("overlap") == 1, dec(F.lit("0.2"))),
    }
    known = {r: F.coalesce(scores[r], dec(0)) if r in scores else dec(0) for r in rules}
    scored = pairs.withColumn("rule_scores", F.create_map(*(x for r, s in known.items() for x in (F.lit(r), s.cast("double")))) if known else F.create_map().cast("map<string,double>"))
    total = reduce(lambda a, b: a + b, known.values(), dec(0))
    hit = F.filter(F.array(*map(F.lit, rules)).cast("array<string>"), lambda r: F.element_at("rule_scores", r) > 0)
    scored = scored.withColumn("candidate_score", F.bround(total, 3).cast("double")).withColumn("generation_rules", hit).where(F.size("generation_rules") > 0)
    loaded = entities.select("id", "type", "seq")
    for side, types in (("head", task.allowed_head_types), ("tail", task.allowed_tail_types)):
        place = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
        scored = scored.join(loaded.select(F.col("id").alias(side), F.struct(place.alias("t"), "seq").alias(f"{side}_at")), side)
    rank = Window.orderBy(F.desc("candidate_score"), "head_at", "tail_at")
    return scored.withColumn("seq", F.row_number().over(rank)).select(
        F.format_string("c_%03d", "seq").alias("candidate_id"), "seq", "head", "relation", "tail", "generation_rules", "rule_scores", "candidate_score",
        F.coalesce("paths", F.array().cast("array<array<string>>")).alias("paths"), F.coalesce("common", F.array().cast("array<string>")).alias("common_neighbors"),
    )


def single_relation_scores(kg: dict[str, DataFrame], ends: list[DataFrame], best: int | None = None) -> DataFrame:
    """(head, tail, candidate_score) by all three rules, for graphs too large to list paths.

    Pairs that an edge or evidence joins are scored one by one; all others owe their score to
    their classes (see dense) and are made as rows leave. best: at least the first so many, by score, head and tail.
    """
    edges = cut(dense.undirected(kg["triples"]), "edges")
    found = dense.link(edges, ends[0], ends[1])
    mentions = kg["evidence"].select(F.col("id").alias("evidence_id"), F.explode(F.array_distinct("related_entities")).alias("entity_id"))
    sides = [mentions.join(cut(e, n).withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").withColumnRenamed("entity_id", n) for e, n in zip(ends, ("head", "tail"))]
    overlap = sides[0].join(sides[1], "evidence_id").where("head != tail").select("head", "tail", F.lit(1).alias("named"), F.lit(0).alias("edge"))
    single = overlap.unionByName(found.direct.select("head", "tail", F.lit(0).alias("named"), F.lit(1).alias("edge"))).groupBy("head", "tail").agg(F.max("named").alias("named"), F.max("edge").alias("edge"))
    near = (F.col("edge") == 1) | (F.col("hops") == 2)
    common = F.coalesce(routes.capped(F.size("common"), "0.3", "0.15", "0.05"), dec(0))
    path = F.when(near, dec(F.lit("0.4"))).when(F.col("hops") == 3, dec(F.lit("0.25"))).otherwise(dec(0))
    score = F.bround(path + common + F.when(F.col("named") == 1, dec(F.lit("0.2"))).otherwise(dec(0)), 3).cast("double")
    scored = cut(dense.place(single, found).select("head", "tail", score.alias("candidate_score"), F.when(F.col("hops").isNotNull(), F.col("tail_class")).alias("tail_class"), "block"), "scored")
    far = F.when(F.col("hops") == 2, dec(F.lit("0.4"))).otherwise(dec(F.lit("0.25")))
    rest = dense.expand(found, [F.bround(far + common, 3).cast("double").alias("candidate_score")], without=scored.where("tail_class is not null"), best=best)
    return scored.select("head", "tail", "candidate_score").unionByName(rest)


def window(candidates: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Candidates after the first `offset`, `limit` of them."""
    if offset < 0:
        raise ValueError("offset is negative")
    some = candidates.where(F.col("seq") > offset)
    return some if limit is None else some.where(F.col("seq") <= offset + limit)
