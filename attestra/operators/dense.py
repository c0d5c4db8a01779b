"""Pairs that hubs join, kept as pairs of classes: members of a class have the same neighbors.

All customers of a nation meet all its suppliers by one and the same path. What a pair owes to the
neighbors of its ends is worked out once for two classes; member pairs are made from that only
when rows leave, without going through a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.sources.shared import cut

#: Fixed values. About how many tails an array holds, and how many heads meet one such array in one place.
BLOCK, DEAL = 256, 16384
CELL = ["tail_class", "block"]


class Dense(NamedTuple):
    """heads: head, head_class. tails: tail, tail_class, block. pairs: head_class, tail_class, hops (2 or 3), common (sorted). direct: head, tail."""

    heads: DataFrame
    tails: DataFrame
    pairs: DataFrame
    direct: DataFrame


def undirected(triples: DataFrame) -> DataFrame:
    """(a, b), distinct, each edge both ways."""
    out = triples.select(F.col("head").alias("a"), F.col("tail").alias("b"))
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def narrowed(triples: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """Of undirected(triples) what link (of 3 hops) needs: the edges of all walks of at most three edges from heads to tails, columns `id`.

    Walks are followed from the side with fewer edges, so what the other side has beside them (a supplier's
    parts, where only nations lead to customers) is dropped before edges are told apart or turned.
    """
    ends = {s: cut(df.select("id").distinct(), f"{s}-ids") for s, df in (("head", heads), ("tail", tails))}

    def at(nodes: DataFrame, among: DataFrame | None = None) -> DataFrame:  # (a, b) with b among nodes
        some = nodes.select(F.col("id").alias("b"))
        out = triples.select(F.col("head").alias("a"), F.col("tail").alias("b"))
        both = [out, out.select(F.col("b").alias("a"), F.col("a").alias("b"))]
        if among is not None:
            both = [x.join(among.select(F.col("id").alias("a")), "a", "left_semi") for x in both]
        return both[0].join(some, "b", "left_semi").unionByName(both[1].join(some, "b", "left_semi"))

    near, far = sorted(ends, key=lambda s: at(ends[s]).count())
    first = cut(at(ends[near]).distinct(), "first-edges")
    around = cut(first.select(F.col("a").alias("id")).distinct(), "around")
    second = cut(at(around).distinct(), "second-edges")
    last = at(cut(second.select(F.col("a").alias("id")).distinct(), "beyond"), ends[far])
    every = first.unionByName(second).unionByName(last)
    return every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _classes(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """(side, side_class) and (side_class, node) of distinct (side, node). A class goes by its least member; sets are told apart by size and 128 bits of hashes."""
    sets = cut(rows.groupBy(side).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")), "sets")
    least = sets.groupBy("n", "x", "y").agg(F.min(side).alias(f"{side}_class"))
    members = cut(sets.join(least, ["n", "x", "y"]).select(side, f"{side}_class"), "members")
    first = members.where(F.col(side) == F.col(f"{side}_class")).select(side)
    return members, cut(rows.join(first, side, "left_semi").select(F.col(side).alias(f"{side}_class"), "node"), "nodes")


def link(edges: DataFrame, heads: DataFrame, tails: DataFrame, max_hops: int = 3) -> Dense:
    """What joins heads to tails, columns `id`, over at most max_hops (2 or 3) edges (a, b) that stand both ways.

    direct has the pairs of one edge, pairs those classes that two or three edges join; common is empty
    at three. A loop at a node counts as a neighbor of itself.
    """
    ids = heads.select("id", F.lit(1).alias("h"), F.lit(0).alias("t")).unionByName(tails.select("id", F.lit(0).alias("h"), F.lit(1).alias("t")))
    roles = cut(ids.groupBy(F.col("id").alias("a")).agg(F.max("h").alias("h"), F.max("t").alias("t")), "roles")
    at = cut(edges.select("a", "b").join(roles, "a"), "ends")
    sides = {s: at.where(f"{s[0]} = 1").select(F.col("a").alias(s), F.col("b").alias("node")) for s in ("head", "tail")}
    nodes = {s: cut(df.select("node").distinct(), f"{s}-nodes") for s, df in sides.items()}
    both = cut(nodes["head"].join(nodes["tail"], "node", "left_semi"), "both")
    hit = cut(nodes["head"].join(roles.where("t = 1").select(F.col("a").alias("node")), "node", "left_semi"), "hit")
    direct = cut(sides["head"].join(hit, "node", "left_semi").select("head", F.col("node").alias("tail")).where("head != tail"), "direct")
    middle = None
    if max_hops == 3:
        ends = {"head": "a", "tail": "b"}
        few = sorted(ends, key=lambda s: nodes[s].count())  # the smaller set of nodes rules out most edges
        middle = edges.select("a", "b")
        for s in few:
            middle = middle.join(nodes[s].withColumnRenamed("node", ends[s]), ends[s], "left_semi")
        middle = cut(middle.where("a != b"), "middle")
    used = {s: both if middle is None else cut(both.unionByName(middle.select(F.col(c).alias("node"))).distinct(), "used") for s, c in (("head", "a"), ("tail", "b"))}
    (members_h, rows_h), (members_t, rows_t) = (_classes(sides[s].join(used[s], "node", "left_semi"), s) for s in ("head", "tail"))
    pairs = rows_h.join(rows_t, "node").groupBy("head_class", "tail_class").agg(F.lit(2).alias("hops"), F.array_sort(F.collect_list("node")).alias("common"))
    if middle is not None:
        far = rows_h.join(middle.withColumnRenamed("a", "node"), "node").select("head_class", F.col("b").alias("node")).distinct().join(rows_t, "node").select("head_class", "tail_class", F.lit(3).alias("hops"), F.array().cast("array<string>").alias("common"))
        pairs = pairs.unionByName(far).groupBy("head_class", "tail_class").agg(F.min("hops").alias("hops"), F.max("common").alias("common"))
    size = members_t.groupBy("tail_class").agg(F.count("*").alias("n"))
    dealt = members_t.join(size, "tail_class").select("tail", "tail_class", F.expr(f"cast(pmod(xxhash64(tail), ceil(n / {BLOCK})) as int)").alias("block"))
    return Dense(members_h, cut(dealt, "tails"), cut(pairs, "classes"), direct)


def place(pairs: DataFrame, dense: Dense) -> DataFrame:
    """Pairs (head, tail, ...) with head_class, tail_class, block, and hops and common of their classes, null where these are not joined."""
    return pairs.join(dense.heads, "head", "left").join(dense.tails, "tail", "left").join(dense.pairs, ["head_class", "tail_class"], "left")


def expand(dense: Dense, values: list[Column], by: list[str] | None = None, pairs: DataFrame | None = None, without: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(head, tail, by, values) of all member pairs of two unlike ids, values being worked out from a class pair.

    pairs: the class pairs, dense.pairs if not given, with columns `by` (a relation) of their own.
    without: pairs (by, head, tail, tail_class, block) that are left out. best: only what can be
    among the first `best` by (head, tail) of a class pair: heads that follow so many with a tail left cannot.
    """
    by = by or []
    pairs = dense.pairs if pairs is None else pairs
    names = ["value"]
    pairs = pairs.select("head_class", "tail_class", *by, F.struct(*values).alias("value"))
    blocks = dense.tails.groupBy(*CELL).agg(F.sort_array(F.collect_list("tail")).alias("tails"))
    load = pairs.join(dense.heads.groupBy("head_class").agg(F.count("*").alias("n")), "head_class").groupBy("tail_class").agg(F.expr(f"cast(floor(sum(n) / {DEAL}) + 1 as int)").alias("parts"))
    shape = cut(dense.tails.groupBy(*CELL).agg(F.count("*").alias("size")).join(load, "tail_class"), "shape")
    cells = dense.heads.join(pairs.join(shape, "tail_class"), "head_class")
    if best is None:
        own = None
    else:  # a head among the tails is no tail of its own
        own = dense.heads.join(dense.tails, F.col("head") == F.col("tail")).select("head", "tail", *CELL)
        if by:
            own = own.crossJoin(F.broadcast(pairs.select(*by).distinct()))
    lost = [df.select(*by, "head", "tail", *CELL) for df in (without, own) if df is not None]
    if lost:
        gone = (lost[0] if len(lost) == 1 else lost[0].unionByName(lost[1])).groupBy(*by, "head", *CELL).agg(F.collect_set("tail").alias("gone"))
        cells = cells.join(gone, [*by, "head", *CELL], "left")
    else:
        cells = cells.withColumn("gone", F.lit(None).cast("array<string>"))
    if best is not None:
        first = Window.partitionBy(*by, "head_class", "tail_class").orderBy("head")
        cells = cells.where(F.col("size") > F.coalesce(F.size("gone"), F.lit(0))).withColumn("k", F.dense_rank().over(first)).where(F.col("k") <= best)
    cells = cells.select(*by, "head", *CELL, *names, "gone", F.expr("cast(pmod(xxhash64(head), parts) as int)").alias("part"))
    each = blocks.join(shape.select(*CELL, "parts"), CELL).select(*CELL, "tails", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = F.when(F.col("gone").isNull(), F.col("tails")).otherwise(F.array_except("tails", "gone"))
    if best is not None:
        left = F.slice(left, 1, best)
    return cells.join(each, [*CELL, "part"]).select("head", F.explode(left).alias("tail"), *by, "value.*").where("head != tail")
