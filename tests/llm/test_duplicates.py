"""Operators 4, 6, 7, 9 and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from attestra.llm import edit_embedding, level_packing, line_windows, universe_partition
from attestra.llm.components import components
from tests.llm.conftest import SCHEMA, by_id


def brute_lines(rows, width=3):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - width + 1):
            w = tuple(lines[k : k + width])
            if "".join(w).replace(" ", "").replace("\t", "").replace("\r", "") == "":
                continue
            if w in seen:
                gone.update(range(k, k + width))
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_lines(docs, rows, none, clash):
    want = brute_lines([(r[0], r[1]) for r in rows])
    for d in (docs, clash):
        got = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_windows.dedup_lines(d).collect()}
        assert got == want
    assert line_windows.dedup_lines(none).count() == 0
    assert sum(w[2] for w in want.values()) > 5


def test_lines_of_repeated_rows(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (None, "a\nb\nc")]
    got = [(r.row.doc_id, r.text) for r in line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\ny"), (None, "")]


def sets_of(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").encode().lower().decode()) if w]
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_components(rows):
    s = [(i, sets_of(t)) for i, t in rows]
    label = list(range(len(s)))
    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                la, lb = label[a], label[b]
                label = [min(la, lb) if v in (la, lb) else v for v in label]
    names = {}
    for (i, _), v in zip(s, label):
        if i is not None:
            names[v] = min(names.get(v, i), i)
    return {i: (len(x), names.get(v) if x else i) for (i, x), v in zip(s, label)}


def test_components_of_awkward_rows(docs, rows, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in universe_partition.jaccard_components(docs).collect()}
    assert got == brute_components([(r[0], r[1]) for r in rows])
    assert universe_partition.jaccard_components(none).count() == 0


def chains(seed):
    """Texts of many lengths, each with edited versions at all distances around the threshold."""
    rng = random.Random(seed)
    out = []
    for n in (5, 7, 8, 9, 10, 12, 14, 18, 25, 40, 70, 130, 260):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        out.append(" ".join(words))
        for _ in range(6):
            words = list(words)
            for _ in range(rng.randint(1, max(1, n // 40))):
                k = rng.randrange(len(words) + 1)
                if rng.random() < 0.5:
                    words.insert(k, f"v{rng.randrange(10**6)}")
                elif len(words) > 1:
                    words.pop(min(k, len(words) - 1))
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_lose_nothing(spark):
    rows = chains(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in universe_partition.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components_of_a_large_group(spark):
    """Near copies of one text, many of them unlike each other: partners are tried in turns before all pairs are."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(160), rng.choice((1, 2, 2, 3, 4, 5))):
            words[k] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in universe_partition.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 90


@pytest.mark.parametrize("seed", range(6))
def test_similar_sets_share_a_signature(seed):
    """For sets of all sizes, at the largest difference allowed, with and without frequent shingles."""
    rng = np.random.default_rng(seed)
    hot = np.zeros(1 << universe_partition.HOT_BITS, np.uint8)
    if seed % 2:
        hot[rng.integers(0, len(hot), len(hot) // 4)] = 9
    for size in [*range(4, 40), 63, 64, 65, 100, 127, 128, 160, 300, 513, 1000]:
        for _ in range(4):
            x = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
            drop = rng.integers(0, len(x) // 5 + 1)
            add = 0
            while 5 * (len(x) - drop) >= 4 * (len(x) + add + 1):
                add += 1
            add = rng.integers(0, add + 1)
            y = np.unique(np.concatenate((rng.permutation(x)[drop:], rng.integers(1, 2**63, add, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            if np.array_equal(x, y) or 100 * both < 80 * (len(x) + len(y) - both):
                continue
            assert np.intersect1d(universe_partition.signatures(x, hot), universe_partition.signatures(y, hot)).size


def test_words_as_in_bytes_split():
    t = ["a\x0bb\x0cc\rD\n", " x ", "", "É é\xa0z", "one"]
    words, ends = universe_partition.word_hashes(pa.array(t))
    assert np.diff(np.concatenate(([0], ends))).tolist() == [len(x.encode().split()) for x in t]


def test_star_components(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), str(tmp_path), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long"), str(tmp_path), "e").count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = level_packing.pack_documents(docs).collect()
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and sum(v < 1024 for v in fill.values()) <= docs.rdd.getNumPartitions()
    assert level_packing.pack_documents(none).count() == 0


def test_level_choice():
    a = level_packing.LevelArray(10, 0)
    rng = random.Random(1)
    for k in range(200):
        size = rng.randint(1, 9)
        n = a.count.copy()
        best = None
        for level in [0, *(h for h in range(1, 10) if n[h] and h + size <= 10)]:
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 10:
                m[level + size] += 1
            s = int((m[1:10] ** 2).sum())
            best = s if best is None else min(best, s)
        a.place(k, 0, b"\1\0\0\0" * size, size)
        assert int((a.count[1:10] ** 2).sum()) == best


def test_fingerprints(docs, rows, none):
    got = by_id(edit_embedding.fingerprint_documents(docs))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for (i, t, *_), (j, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        f, g, h = edit_embedding.fingerprints([t, e, u])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f.hex(), g.hex())
        assert r.near_edited == edit_embedding.likeness(f, g) and r.near_next == edit_embedding.likeness(f, h)
    assert edit_embedding.fingerprint_documents(none).count() == 0


def test_likeness_follows_edits(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(800)) for _ in range(12)]
    edit = [b[:400] + "#" + b[401:] for b in base]
    f, g = edit_embedding.fingerprints(base), edit_embedding.fingerprints(edit)
    same = np.mean([edit_embedding.likeness(a, b) for a, b in zip(f, g)])
    other = np.mean([edit_embedding.likeness(a, b) for a, b in zip(f, g[1:])])
    assert same > 0.5 and other < 0.2
    prints = spark.createDataFrame([(i, x.hex()) for i, x in enumerate([*f, f[0]])], "doc_id long, fingerprint string")
    assert (0, 12) in {(r.a, r.b) for r in edit_embedding.near_pairs(prints).collect()}


def test_pipeline(spark, tmp_path, rows):
    from tests.llm.test_models import clean, junk

    texts = [(i, clean(i) if i % 3 else junk(i), "en", "s", 0) for i in range(90)] + [(200, clean(1), None, None, None), (201, "p q r s t u\nv w x y z\na b c d e", "en", "s", 3), (202, "p q r s t u\nv w x y z\na b c d e\nmore of it here", "en", "s", 4)]
    spark.createDataFrame(texts, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, str(tmp_path)).cache()
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} >= {i for i in range(90) if i % 3}
    lines = stages["lines"](spark, good, str(tmp_path)).cache()
    want = brute_lines([(r.doc_id, r.text) for r in good.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == {i: w[0] for i, w in want.items()} and lines.columns == docs.columns
    one = stages["near_duplicates"](spark, lines, str(tmp_path)).cache()
    comp = brute_components([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in comp.items() if c == i} and one.columns == docs.columns
    assert {r.doc_id for r in stages["packing"](spark, one, str(tmp_path)).collect()} == {r.doc_id for r in one.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == one.count()


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """The same classes whether pairs come from joins or from blocks, of one or more of a group."""
    monkeypatch.setattr(universe_partition, "SMALL", 6)
    monkeypatch.setattr(universe_partition, "BLOCK", 16)
    test_components_of_a_large_group(spark)


@pytest.mark.parametrize("seed", range(3))
def test_bitmaps_rule_out_no_link(seed):
    rng = np.random.default_rng(seed)
    for size in (2, 5, 9, 30, 64, 100, 127, 129, 500, 3000):
        x = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
        for drop in range(0, len(x) // 3 + 1, max(1, len(x) // 40)):
            y = np.unique(np.concatenate((x[drop:], rng.integers(1, 2**63, drop // 2, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert universe_partition.may_link(len(x), len(y), universe_partition.bitmap(x), universe_partition.bitmap(y))
    x, y = (np.unique(rng.integers(1, 2**63, 300, dtype=np.uint64)) for _ in "ab")
    assert not universe_partition.may_link(300, 300, universe_partition.bitmap(x), universe_partition.bitmap(y))


def test_one_row_of_a_group_stays(spark):
    """By document and text, not by id: repeated ids, null ids and clashing columns included."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text, "a"), (5, text, "a"), (7, text + " x", "b"), (7, "a text of its own that stays with its id", "c"), (None, text, "d"), (None, None, "e"), (None, "", "f"), (2, "", "g"), (2, "", "g"), (None, "alone w", "h"), (None, "alone w", "h")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, code string, set_id long")
    got = universe_partition.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.code for r in got.collect()) == ["a", "c", "e", "f", "g", "g", "h"]
    assert universe_partition.keep_one(docs.limit(0)).count() == 0


def test_pieces_of_a_batch_are_the_same_rows():
    """Sets do not depend on how a batch is cut."""
    from attestra.llm.common import in_pieces

    t = [" ".join(f"w{k * i % 91}" for k in range(5 + i)) for i in range(60)] + ["", None, "a  b", "x" * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string())], ["doc_id", "text"])
    want = [s.tolist() for s in universe_partition.shingle_sets(batch.column("text").fill_null(""))]
    parts = list(in_pieces(iter([batch]), 500))
    assert len(parts) > 9 and [x for p in parts for x in p.column("doc_id").to_pylist()] == list(range(len(t)))
    assert [s.tolist() for p in parts for s in universe_partition.shingle_sets(p.column("text").fill_null(""))] == want
    assert [s.tolist() for s in universe_partition.shingle_sets(batch.slice(9, 30).column("text"))] == want[9:39]


def test_numbers_of_groups_are_small_and_their_own(spark, tmp_path):
    codes = spark.range(1000).selectExpr("xxhash64(id) as code").repartition(7, "code")
    got = [r.number for r in universe_partition._numbered(codes, str(tmp_path), "large").collect()]
    assert len({*got}) == 1000 and 0 <= min(got) and max(got) < 7 * 1000


def test_signatures_are_not_kept(spark, tmp_path, monkeypatch):
    """What the later steps read holds no signatures, and the table that had them is gone."""
    monkeypatch.setattr(universe_partition, "shared_dir", lambda _: str(tmp_path / "run"))
    rows = [(k, " ".join(f"w{i}" for i in range(40 + k % 2))) for k in range(20)]
    sets, _ = universe_partition._sets(spark.createDataFrame(rows, "doc_id long, text string"), universe_partition.shared_dir(spark))
    assert sets.columns == ["doc_id", "n_shingles", "set_id"] and sets.count() == 20
    kept = {f.name: {*spark.read.parquet(str(f)).columns} for f in (tmp_path / "run").iterdir() if f.name in ("signed", "sets")}
    assert kept == {"sets": {*sets.columns}}
