"""Pairs by classes against brute force, and that no exchange deals out pairs."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from attestra.config import Relation, relation_table
from attestra.operators import candidates, dense, graph

PAIRS_DEALT = r"hashpartitioning\(head#\d+, tail#\d+"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hubs(seed, overlap):
    """Heads and tails around a few hubs, some stray edges, a loop; with overlap some ids are both."""
    rnd = random.Random(seed)
    heads, tails, mids = [f"h{i}" for i in range(30)], [f"t{i}" for i in range(25)], [f"m{i}" for i in range(4)]
    edges = {(x, rnd.choice(mids)) for x in heads + tails} | {(rnd.choice(heads), rnd.choice(tails)) for _ in range(5)} | {(rnd.choice(heads), rnd.choice(mids)) for _ in range(5)}
    edges |= {("m0", "m1"), ("m2", "x"), ("x", "m3"), ("m1", "m1"), ("h1", "h1")}
    return edges, heads + (tails[:5] if overlap else []), tails + (heads[:5] if overlap else [])


def frames(spark, edges, heads, tails):
    triples = spark.createDataFrame([(f"{a}{b}", a, "r", b, i) for i, (a, b) in enumerate(sorted(edges))], "id string, head string, relation string, tail string, seq long")
    return triples, *(spark.createDataFrame([(x,) for x in xs], "id string") for xs in (heads, tails))


def around(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


@pytest.mark.parametrize("overlap", [False, True])
def test_common_neighbors(spark, monkeypatch, overlap):
    monkeypatch.setattr(dense, "BLOCK", 3)
    monkeypatch.setattr(dense, "DEAL", 4)
    edges, heads, tails = hubs(1, overlap)
    triples, h, t = frames(spark, edges, heads, tails)
    got = graph.common_neighbors(graph.neighbors(triples), h, t)
    near = around(edges)
    want = {(a, b): sorted(near[a] & near[b]) for a, b in product(heads, tails) if a != b and near[a] & near[b]}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.head, r.tail): list(r.common) for r in rows} == want
    assert not re.search(PAIRS_DEALT, plan(got))


def scores(edges, named, heads, tails):
    near = around({e for e in edges if e[0] != e[1]})
    loops = around(edges)
    out = {}
    for a, b in product(heads, tails):
        if a == b:
            continue
        two = near[a] & near[b]
        hops = 1 if b in near[a] else 2 if two else 3 if any(y in near[x] for x in near[a] for y in near[b]) else 9
        n = len(loops[a] & loops[b])
        s = (400 if hops <= 2 else 250 if hops == 3 else 0) + (min(300, 150 + 50 * n) if n else 0) + (200 if any(a in e and b in e for e in named) else 0)
        if s:
            out[a, b] = s / 1000
    return out


@pytest.mark.parametrize("overlap", [False, True])
def test_single_relation_scores(spark, monkeypatch, overlap):
    monkeypatch.setattr(dense, "BLOCK", 3)
    monkeypatch.setattr(dense, "DEAL", 4)
    edges, heads, tails = hubs(2, overlap)
    triples, h, t = frames(spark, edges, heads, tails)
    rnd = random.Random(3)
    named = [rnd.sample(heads, 2) + rnd.sample(tails, 2) for _ in range(12)]
    evidence = spark.createDataFrame([(f"e{i}", x, i) for i, x in enumerate(named)], "id string, related_entities array<string>, seq long")
    kg = {"triples": triples, "evidence": evidence}
    want = scores(edges, named, heads, tails)
    got = candidates.single_relation_scores(kg, [h, t])
    rows = got.collect()
    assert len(rows) == len(want) and {(r.head, r.tail): r.candidate_score for r in rows} == want
    assert not re.search(PAIRS_DEALT + r", \d+", plan(got))  # by head, tail and nothing else
    first = [(r.head, r.tail) for r in candidates.single_relation_scores(kg, [h, t], 7).orderBy(F.desc("candidate_score"), "head", "tail").limit(7).collect()]
    assert first == sorted(want, key=lambda p: (-want[p], p))[:7]


def test_multi_route_by_classes(spark, monkeypatch):
    """The best of a relation whose pairs mostly owe all to hubs, with one taken, one direct edge and evidence of a few."""
    monkeypatch.setattr(dense, "BLOCK", 3)
    monkeypatch.setattr(dense, "DEAL", 4)
    edges, heads, tails = hubs(4, False)
    direct = next(iter(sorted(e for e in edges if e[0] in heads and e[1] in tails)))
    triples, _, _ = frames(spark, edges, heads, tails)
    triples = triples.unionByName(spark.createDataFrame([("known", direct[0], "r2", direct[1], 99)], triples.schema))
    entities = spark.createDataFrame([(x, "head" if x in heads else "tail", x, [], {}, i) for i, x in enumerate(heads + tails)], "id string, type string, name string, aliases array<string>, properties map<string,string>, seq long")
    evidence = spark.createDataFrame([("e1", "s", "t", ["h1", "t1", "t2"], 0.9, 1)], "id string, source string, text string, related_entities array<string>, reliability double, seq long")
    specs = relation_table(spark, [Relation("r2", "", ["head"], ["tail"], [], ["path_rule", "common_neighbor", "evidence_cooccurrence"], "", "", 40)])
    got = candidates.multi_route({"entities": entities, "triples": triples, "evidence": evidence}, specs).orderBy("seq").collect()
    near = around({e for e in edges if e[0] != e[1]})
    loops, want = around(edges), {}
    for a, b in product(heads, tails):
        hops = 1 if b in near[a] else 2 if near[a] & near[b] else 3 if any(y in near[x] for x in near[a] for y in near[b]) else None
        common = sorted(loops[a] & loops[b])
        score = (0 if hops is None else 45 if hops <= 2 else 25) + (min(30, 12 + 4 * len(common)) if common else 0) + (26 if a == "h1" and b in ("t1", "t2") else 0)
        if score and (a, b) != direct:
            want[a, b] = (score / 100, hops, common)
    best = sorted(want, key=lambda p: (-want[p][0], p))[:40]
    assert [(r.head, r.tail) for r in got] == best
    assert [(r.candidate_score, r.debug.shortest_path_len, r.debug.common_neighbors or []) for r in got] == [want[p] for p in best]


def test_best_of_classes_are_few(spark, monkeypatch):
    """Of 40 * 40 pairs at one hub only those are made that can be among the best two."""
    heads, tails = [f"h{i:02}" for i in range(40)], [f"t{i:02}" for i in range(40)]
    edges, h, t = frames(spark, {(x, "m") for x in heads + tails}, heads, tails)
    found = dense.link(dense.undirected(edges), h, t)
    assert dense.expand(found, [F.col("hops")]).count() == 1600
    assert [tuple(r) for r in dense.expand(found, [F.col("hops")], best=2).orderBy("head", "tail").limit(2).collect()] == [("h00", "t00", 2), ("h00", "t01", 2)]
    assert dense.expand(found, [F.col("hops")], best=2).count() <= 4


def graph_of(spark, edges, heads, tails, named, taken=()):
    triples, _, _ = frames(spark, edges, heads, tails)
    if taken:
        triples = triples.unionByName(spark.createDataFrame([(f"k{i}", a, r, b, i) for i, (a, r, b) in enumerate(taken)], triples.schema))
    entities = spark.createDataFrame([(x, "head" if x in heads else "tail", f"word{x[1:]}", [], {}, i) for i, x in enumerate(heads + tails)], "id string, type string, name string, aliases array<string>, properties map<string,string>, seq long")
    evidence = spark.createDataFrame([(f"e{i:03}", "ticket" if i % 2 else "mail", "t", x, 0.9, i) for i, x in enumerate(named)], "id string, source string, text string, related_entities array<string>, reliability double, seq long")
    return {"entities": entities, "triples": triples, "evidence": evidence}


@pytest.mark.parametrize("most", [3, 60, 2000])
def test_multi_route_against_brute_force(spark, monkeypatch, most):
    """Two relations of the same types, one by all routes and one by evidence and rules, whatever is ruled out early; loops over growing prefixes and split heads included."""
    monkeypatch.setattr(dense, "BLOCK", 3)
    monkeypatch.setattr(candidates, "FIRST", 2, raising=False)
    monkeypatch.setattr(candidates.routes, "SHARE", 40, raising=False)
    rnd = random.Random(most)
    edges, heads, tails = hubs(6, False)
    named = [rnd.sample(heads[:6], 2) + rnd.sample(tails[:8], 3) for _ in range(40)] + [["h1", "h1", "t1", "none"], ["h2"], []]
    shared = {(a, b): [i for i, e in enumerate(named) if a in e and b in e] for a, b in product(heads, tails)}
    often = sorted((p for p in shared if shared[p]), key=lambda p: (-len(shared[p]), p))
    taken = [(a, "owned_by", b) for a, b in often[:30]] + [(a, "all", b) for a, b in often[:3]]
    every = edges | {(a, b) for a, _, b in taken}
    names = ["schema_type", "path_rule", "common_neighbor", "evidence_cooccurrence", "attribute_similarity", "source_specific_rule"]
    specs = relation_table(spark, [Relation("all", "", ["head"], ["tail"], [], names, "", "", most), Relation("owned_by", "", ["head"], ["tail"], [], ["evidence_cooccurrence", "source_specific_rule"], "", "", most)])
    got = candidates.multi_route(graph_of(spark, edges, heads, tails, named, taken), specs).orderBy("seq").collect()
    near, loops, want = around({e for e in every if e[0] != e[1]}), around(every), []
    scored = {"all": {}, "owned_by": {}}
    for a, b in product(heads, tails):
        n, ticket = len(shared[a, b]), sum(i % 2 for i in shared[a, b])
        hops = 1 if b in near[a] else 2 if near[a] & near[b] else 3 if any(y in near[x] for x in near[a] for y in near[b]) else 9
        both = len(loops[a] & loops[b])
        alike = 100 + 1000 / 3 if a[1:] == b[1:] else 0  # of h1, word1, t1 one is shared
        one = min(500, 180 + 80 * n) if n else 0
        if (a, "all", b) not in taken:
            scored["all"][a, b] = round((50 + (450 if hops <= 2 else 250 if hops == 3 else 0) + (min(300, 120 + 40 * both) if both else 0) + one + min(350, alike)) / 1000, 4)
        if (a, "owned_by", b) not in taken and n:
            scored["owned_by"][a, b] = (one + (min(750, 450 + 100 * ticket) if ticket else 0)) / 1000
    for relation, pairs in scored.items():
        want += [(relation, *p, pairs[p]) for p in sorted(pairs, key=lambda p: (-pairs[p], p))[:most]]
    assert [(r.relation, r.head, r.tail, r.candidate_score) for r in got] == want
    for r in got:
        ids = [f"e{i:03}" for i in shared[r.head, r.tail]]
        assert (r.debug.evidence_count or 0, r.debug.evidence_ids or []) == (len(ids), ids[:8])
        assert (r.debug.source_hits == ["ticket"]) == (r.relation == "owned_by" and any(i % 2 for i in shared[r.head, r.tail]))
        assert (r.debug.shared_tokens is not None) == (r.relation == "all" and r.head[1:] == r.tail[1:])


def test_few_pairs_are_scored_whole(spark, monkeypatch):
    """Of 1600 pairs that evidence joins only those are placed among classes and kept that can be among the best two."""
    heads, tails = [f"h{i:02}" for i in range(40)], [f"t{i:02}" for i in range(40)]
    named = [["h00", "t00"], ["h00", "t00"], ["h01", "t01"], ["h01", "t01"], heads + tails]
    kg = graph_of(spark, {(x, "m") for x in heads + tails}, heads, tails, named)
    specs = relation_table(spark, [Relation("r2", "", ["head"], ["tail"], [], ["path_rule", "common_neighbor", "evidence_cooccurrence"], "", "", 2)])
    kept, placed = [], []
    keep, place = candidates.cut, dense.place
    monkeypatch.setattr(candidates, "FIRST", 2, raising=False)
    monkeypatch.setattr(candidates, "cut", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    monkeypatch.setattr(dense, "place", lambda pairs, found: placed.append(pairs.count()) or place(pairs, found))
    got = candidates.multi_route(kg, specs).orderBy("seq").collect()
    assert [(r.head, r.tail, r.candidate_score) for r in got] == [("h00", "t00", 1.03), ("h01", "t01", 1.03)]
    assert max(placed) <= 4
    assert all(df.count() <= 4 for df in kept if {"head", "tail", "hit"} <= set(df.columns))


@pytest.mark.parametrize("overlap", [False, True])
def test_edges_off_all_walks_are_dropped(spark, overlap):
    """50 other neighbors of a head or a tail lead to no end of the other side, unless one id is both; links stay the same."""
    edges, heads, tails = hubs(7, overlap)
    side = tails if overlap else heads
    triples, h, t = frames(spark, edges | {(side[0], f"x{i}") for i in range(50)}, heads, tails)
    every, few = dense.undirected(triples), dense.narrowed(triples, h, t)
    assert overlap or few.where("a rlike '^x[0-9]' or b rlike '^x[0-9]'").isEmpty()
    assert few.count() == few.distinct().count() and few.select("a", "b").exceptAll(every).isEmpty()
    links = [dense.link(e.select("a", "b"), h, t) for e in (every, few)]
    pairs = [sorted((r.head, r.tail, r.hops, *r.common) for r in dense.expand(x, [F.col("hops"), F.col("common")]).collect()) for x in links]
    assert pairs[0] == pairs[1]
    direct = [sorted(map(tuple, x.direct.select("head", "tail").collect())) for x in links]
    assert direct[0] == direct[1]
