"""Lookups and bounded traversal over triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import normal
from attestra.operators import dense
from attestra.sources.shared import cut


def by_id(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("id") == value)


def by_types(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities of some types, in the order of the list, then of loading."""
    wanted = F.array(*map(F.lit, types))
    return entities.where(F.col("type").isin(types)).orderBy(F.array_position(wanted, F.col("type")), "seq")


def search(entities: DataFrame, text: str) -> DataFrame:
    """Entities whose normal name or one of whose normal aliases is that of the text."""
    want = normal(F.lit(text))
    return entities.where((normal(F.col("name")) == want) | F.exists("aliases", lambda a: normal(a) == want)).orderBy("id")


def related(triples: DataFrame, entity: str) -> DataFrame:
    """Triples at an entity, once for each end."""
    return triples.where(F.col("head") == entity).unionByName(triples.where(F.col("tail") == entity))


def at_entities(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct triples with an end among the ids of entities, by id."""
    ids = entities.select(F.col("id").alias("end")).distinct()
    ends = triples.select("id", F.explode(F.array_distinct(F.array("head", "tail"))).alias("end")).join(ids, "end", "left_semi").select("id").distinct()
    return triples.join(ends, "id", "left_semi").orderBy("id")


def between(triples: DataFrame, head: str, tail: str, both: bool = False) -> DataFrame:
    """Triples from head to tail; both: of either direction, the forward ones first."""
    ahead = triples.where((F.col("head") == head) & (F.col("tail") == tail))
    return ahead.unionByName(triples.where((F.col("head") == tail) & (F.col("tail") == head))) if both else ahead


def existing(pairs: DataFrame, triples: DataFrame, keep: bool) -> DataFrame:
    """Pairs (head, relation, tail, ...) that are, or are not, among the triples."""
    return pairs.join(triples.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_semi" if keep else "left_anti")


def neighbors(triples: DataFrame, direction: str = "both", relation: str | None = None) -> DataFrame:
    """(entity, neighbor), distinct."""
    t = triples if relation is None else triples.where(F.col("relation") == relation)
    out = t.select(F.col("head").alias("entity"), F.col("tail").alias("neighbor"))
    into = t.select(F.col("tail").alias("entity"), F.col("head").alias("neighbor"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction: {direction}")
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def common_neighbors(edges: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """(head, tail, common) of all pairs of heads and tails, columns `id`, that share a neighbor.

    Both sides are cut to legal ends, and what hubs join meets by classes (see dense), so no pair is shuffled.
    """
    found = dense.link(edges.select(F.col("entity").alias("a"), F.col("neighbor").alias("b")), heads, tails, 2)
    return dense.expand(found, [F.col("common")])


def ranked_edges(triples: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(a, b, rank) of the undirected simple graph; rank orders a's neighbors as a depth-first walk meets them.

    A walk meets edges by where their source entity was loaded, then by where the edge was.
    """
    t = triples.where("head != tail")
    if entities is not None:
        t = t.join(entities.select(F.col("id").alias("head"), F.col("seq").alias("source_seq")), "head")
    else:
        t = t.withColumn("source_seq", F.lit(0))
    rank = F.struct("source_seq", "seq")
    both = t.select(F.col("head").alias("a"), F.col("tail").alias("b"), rank.alias("rank")).unionByName(t.select(F.col("tail").alias("a"), F.col("head").alias("b"), rank.alias("rank")))
    return both.groupBy("a", "b").agg(F.min("rank").alias("rank"))


def in_reach(edges: DataFrame, tails: DataFrame, hops: int) -> list[DataFrame]:
    """For 0 to hops: the nodes (id) from which a walk of so many edges ends at a tail. One table of nodes each, whatever the number of pairs."""
    pair = edges.select("a", "b")
    out = [tails.select("id").distinct()]
    for k in range(hops):
        out.append(cut(pair.join(out[-1].withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct(), f"reach-{k}"))
    return out


def _either(nodes: list[DataFrame]) -> DataFrame:
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out.distinct()


def simple_paths(edges: DataFrame, heads: DataFrame, tails: DataFrame, max_hops: int = 3) -> DataFrame:
    """(head, tail, hops, path, ranks) of all simple paths of 1 to max_hops edges from heads to tails.

    Each hop joins the walks so far with the edges; the last edge is taken from those into tails
    only, and earlier ones only to nodes from which the walk can still end at a tail.
    """
    edges = cut(edges, "edges")
    last = edges.join(tails.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "rank")
    near = in_reach(edges, tails, max_hops - 1)
    onward = [_either(near[1 : max_hops - hop + 1]) for hop in range(1, max_hops)]
    walks = heads.select(F.col("id").alias("head"), F.col("id").alias("at"), F.array("id").alias("path")).distinct()
    walks = walks.withColumn("ranks", F.array().cast(f"array<{edges.schema['rank'].dataType.simpleString()}>"))
    found: DataFrame | None = None

    def step(w: DataFrame, e: DataFrame) -> DataFrame:
        joined = w.join(e, F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        return joined.select("head", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"), F.concat("ranks", F.array("rank")).alias("ranks"))

    for hop in range(1, max_hops + 1):
        ended = step(walks, last).select("head", F.col("at").alias("tail"), F.lit(hop).alias("hops"), "path", "ranks")
        found = ended if found is None else found.unionByName(ended)
        if hop < max_hops:
            walks = step(walks, edges.join(onward[hop - 1].withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "rank"))
    assert found is not None
    return found


def first_paths(paths: DataFrame, max_paths: int) -> DataFrame:
    """The first paths of each pair, as a depth-first walk meets them."""
    w = Window.partitionBy("head", "tail").orderBy("ranks", "path")
    return paths.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_paths)


def shortest_paths(paths: DataFrame) -> DataFrame:
    """(head, tail, hops, path): the shortest path of each pair, the least by its nodes among equals."""
    return paths.groupBy("head", "tail").agg(F.min(F.struct("hops", "path")).alias("s")).select("head", "tail", "s.hops", "s.path")


def reachable(edges: DataFrame, heads: DataFrame, tails: DataFrame, max_hops: int = 3) -> DataFrame:
    """(head, tail, hops): least number of edges between legal ends, up to max_hops.

    Walks forget their nodes: after each hop only distinct pairs go on, and only to nodes from
    which a tail is still in reach, so nothing grows with pairs that no path joins.
    """
    pair = cut(edges.select("a", "b").distinct(), "edges")
    ends = pair.join(tails.select(F.col("id").alias("b")), "b", "left_semi")
    near = in_reach(pair, tails, max_hops - 1)
    front = heads.select(F.col("id").alias("head"), F.col("id").alias("at")).distinct()
    found: DataFrame | None = None
    for hop in range(1, max_hops + 1):
        hit = front.join(ends, F.col("at") == F.col("a")).select("head", F.col("b").alias("tail"), F.lit(hop).alias("hops")).where("head != tail").distinct()
        found = hit if found is None else found.unionByName(hit)
        if hop < max_hops:
            onward = pair.join(_either(near[1 : max_hops - hop + 1]).withColumnRenamed("id", "b"), "b", "left_semi")
            front = front.join(onward, F.col("at") == F.col("a")).select("head", F.col("b").alias("at")).distinct()
    assert found is not None
    return found.groupBy("head", "tail").agg(F.min("hops").alias("hops"))


def evidence_of_triples(triples: DataFrame, evidence: DataFrame) -> DataFrame:
    """(triple_id, evidence_id, place) of the evidence that triples cite and that exists."""
    cited = triples.select(F.col("id").alias("triple_id"), F.posexplode("evidence_ids").alias("place", "evidence_id"))
    return cited.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
