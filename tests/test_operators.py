"""Single operators on hand-made rows."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.operators import documents, graph, metrics, reason, retrieval, verify, writeback
from attestra.sources import readers, writers
from attestra.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.entity_id("team", F.lit(" Team  Identity! "))) == "team_identity"
    assert one(spark, text.entity_id("service", F.lit("auth"))) == "svc_auth"
    assert sorted(one(spark, text.tokens(F.lit("Host a.b/c x")))) == sorted(["host", "a.b/c", "x", "a", "b", "c"])
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, text.error_class(F.lit("Request TIMEOUT"))) == "timeout"
    assert one(spark, text.error_class(F.lit("LLM request failed"), old=True)) == "provider_error"
    assert one(spark, text.error_class(F.lit(""))) == ""
    with pytest.raises(Exception):
        one(spark, text.strict_normal(F.lit("!!")))


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("c", "d", 2), ("a", "c", 3)], "head string, tail string, seq long")
    edges = graph.ranked_edges(e)
    a, d = (spark.createDataFrame([(x,)], "id string") for x in "ad")
    p = graph.simple_paths(edges, a, d, 3)
    assert sorted(r.path for r in p.collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    assert graph.first_paths(p, 1).first().path == ["a", "b", "c", "d"]
    assert graph.shortest_paths(p).first().path == ["a", "c", "d"]
    assert graph.reachable(edges, a, d, 3).first().hops == 2


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.read_jsonl(spark, str(p), "a int").orderBy("seq").collect()] == [1, 2]
    p.write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p), "a int").collect()
    c = tmp_path / "t.csv"
    c.write_text("a,b\n x ,\n")
    assert readers.read_csv_table(spark, str(c), ["a"]).select("a", "b").first() == ("x", "")
    with pytest.raises(ValueError):
        readers.read_csv_table(spark, str(c), ["z"])
    df = spark.createDataFrame([("b", None)], "b string, a string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"a": None, "b": "b"}


META = {"relation_id": "P17", "wikidata_label": "l", "wikidata_description": "d", "wikidata_aliases": ["a"], "relation_name": "country", "description": "x", "aliases": [], "source": "s", "needs_review": False}


@pytest.mark.parametrize("lines", [["", json.dumps(META)], ["{"], [json.dumps({k: v for k, v in META.items() if k != "source"})], [json.dumps(META | {"aliases": "x"})], [json.dumps(META)] * 2, [json.dumps(META | {"needs_review": True})]])
def test_bad_metadata(spark, tmp_path, lines):
    p = tmp_path / "m.jsonl"
    p.write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError):
        readers.read_relation_metadata(spark, str(p))


DOC = {"title": "T", "sents": [["Head", "relates", "to", "Tail", "."]], "vertexSet": [[{"name": "Head", "sent_id": 0, "pos": [0, 1], "type": "ORG"}], [{"name": "Tail", "sent_id": 0, "pos": [3, 4], "type": "LOC"}]], "labels": [{"h": 0, "t": 1, "r": "P17", "evidence": [0]}]}


def test_adapter(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps(META) + "\n")
    label = DOC["labels"][0]
    docs = [
        DOC, 5, DOC | {"title": ""}, DOC | {"sents": "x"}, DOC | {"sents": ["str"]}, DOC | {"vertexSet": 3}, DOC | {"labels": None}, DOC | {"vertexSet": [7]}, DOC | {"vertexSet": [[{"name": "", "sent_id": 0, "pos": [0, 1]}]]},
        DOC | {"labels": [label, {**label, "evidence": []}, {**label, "evidence": [9, 8]}, {**label, "h": True}, {**label, "r": "P99"}, {"t": 1, "r": "P17"}]},
    ]
    (tmp_path / "train.json").write_text(json.dumps(docs))
    files = {"train": str(tmp_path / "train.json")}
    stats = documents.process(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "out"), files, strict=False)["train"]
    assert (stats["document_count_written"], stats["document_count_skipped"]) == (2, 8)
    assert stats["error_counts"] == {"DOCUMENT_NOT_OBJECT": 1, "DOCUMENT_SENTS_INVALID": 1, "DOCUMENT_TITLE_INVALID": 1, "ENTITY_ENTRY_INVALID": 1, "ENTITY_NO_VALID_MENTION": 1, "EVIDENCE_INDEX_INVALID": 2, "LABELS_INVALID": 1, "LABEL_ENTITY_INDEX_INVALID": 1, "LABEL_REQUIRED_FIELD_MISSING": 1, "MENTION_NAME_INVALID": 1, "SENTENCE_INVALID": 1, "UNKNOWN_RELATION_ID": 1, "VERTEX_SET_INVALID": 1}
    gold = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/train/gold_triples.jsonl")).collect()]
    assert [g["evidence_annotation_status"] for g in gold] == ["present", "invalid"] and gold[1]["evidence_sent_ids"] == [0] and stats["duplicate_label_count"] == 2
    again = documents.process(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "out"), files, strict=False)
    assert "is not empty" in again["train"]["error"]
    with pytest.raises(documents.AdapterError) as e:
        documents.process(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "strict"), files, strict=True)
    assert e.value.code == "DOCUMENT_NOT_OBJECT"
    assert "evidence_ids" not in documents.inference_view(spark.createDataFrame([("g", ["e"])], "gold_id string, evidence_ids array<string>")).columns


def test_client_failures_are_uncertain(spark):
    item = "struct<id:string,text:string,related_entities:array<string>>"
    rows = [("c1", 1, "h", "owned_by", "t", 0.5, [], None, [("e1", "x", ["h"])], [], "q", "m"), ("c2", 2, "h", "owned_by", "t", 0.5, [], None, [], [], "q", "m")]
    c = spark.createDataFrame(rows, f"candidate_id string, seq int, head string, relation string, tail string, candidate_score double, recall_sources array<string>, debug string, support array<{item}>, conflict array<{item}>, packed_context string, retrieval_metadata string")
    good = {r.candidate_id: r for r in reason.predictions(c, reason.ask(c, lambda: reason.make_client({"provider": "mock"}))).collect()}
    assert (good["c1"].decision, good["c2"].decision) == ("accept", "uncertain")

    def broken():
        raise RuntimeError("provider is down: request timed out")

    bad = reason.predictions(c, reason.ask(c, broken)).collect()
    assert {(r.decision, r.confidence, r.error_type) for r in bad} == {("uncertain", 0.0, "timeout")}


def test_dense_retrieval(spark):
    e = spark.createDataFrame([("e1", "red fox", ["x"], "ticket", 0.9, "", 0), ("e2", "blue sea", ["y"], "dns", 0.5, "", 1)], "id string, text string, related_entities array<string>, source string, reliability double, timestamp string, seq int")
    ent = spark.createDataFrame([("x", "ip", "X", [], {}), ("y", "ip", "Y", [], {})], "id string, type string, name string, aliases array<string>, properties map<string,string>")
    asked = spark.createDataFrame([("c", "r", "", ["ticket"], "x", "z", "x", "z", "red fox")], "candidate_id string, relation string, relation_text string, preferred_sources array<string>, head string, tail string, head_text string, tail_text string, query string")
    words = ["red", "fox", "blue", "sea"]

    def encode(s):
        return s.map(lambda t: [float(t.count(w)) for w in words])

    def rerank(q, t):
        return pd.Series([len(set(a.split()) & set(b.split())) / 4 for a, b in zip(q, t)])

    got = {r.id: r for r in retrieval.hybrid_rank(asked, e, ent, encode, rerank, 5).collect()}
    assert got["e1"].retrieval_rank == 1 and got["e1"].dense_score == 1.0 and got["e1"].retrieval_reasons[-1] == "cross_encoder_rerank"
    assert got["e2"].dense_score == 0.0


def test_state_as_windows(spark):
    rows = [(1, "h", "r", "t", "accept", 0.9, True, True), (2, "h", "r", "t", "accept", 0.9, True, True), (3, "h", "r", "u", "accept", 0.1, True, True), (4, "h", "r", "v", "accept", 0.9, False, True)]
    from attestra.config import Verification

    p = spark.createDataFrame(rows, "seq int, head string, relation string, tail string, decision string, confidence double, schema_ok boolean, grounded boolean")
    v = {r.seq: (r.final_decision, r.verifier_status) for r in verify.single_relation(p, Verification()).collect()}
    assert v == {1: ("accept", "passed"), 2: ("reject", "failed"), 3: ("uncertain", "failed"), 4: ("reject", "failed")}
    t = spark.createDataFrame([("z", "r", "t")], "head string, relation string, tail string")
    d = writeback.edge_decisions(p.withColumn("verifier_status", F.lit("passed")), t)
    assert [r.outcome for r in d.orderBy("seq").collect()] == ["written", "skipped_duplicate", "skipped_conflict", "skipped_conflict"]
    e = metrics.prf(spark.createDataFrame([("h", "r", "t")], "head string, relation string, tail string"), spark.createDataFrame([("h", "r", "t"), ("h", "r", "u")], "head string, relation string, tail string")).first()
    assert (e.precision, e.recall, e.f1) == (1.0, 0.5, 0.6667)


def test_resume(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    calls = []

    def step(df):
        calls.append(df.count())
        return df

    for ids in (range(3), range(2, 5)):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(src)
        resume.run_incrementally(spark, src, spark.read.parquet(src).schema, step, sink, ck, ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4] and calls == [3, 2]
