"""Operators 1, 2, 8 and 10 against plain computations."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attestra.llm import license_templates, media_sniffing, piece_agenda, token_scan
from tests.llm.conftest import by_id

lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_licenses(docs, rows, none, clash):
    got = by_id(license_templates.scan_licenses(docs))
    for i, t, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        places = [(k, label) for p, label in license_templates.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any("gpl-3.0-notice" in r.labels and "mit-notice" in r.labels for r in got.values())
    assert license_templates.scan_licenses(none).count() == 0 and license_templates.scan_licenses(clash).count() == len(rows)


def regions(template):
    """All wordings of a template, replaceable words as '*', by brute force."""
    out, rest = [], template
    if "[[" in rest:
        at = rest.index("[[")
        depth, k = 0, at
        while True:
            if rest.startswith("[[", k):
                depth, k = depth + 1, k + 2
            elif rest.startswith("]]", k):
                depth, k = depth - 1, k + 2
                if not depth:
                    break
            else:
                k += 1
        return regions(rest[:at] + rest[at + 2 : k - 2] + rest[k:]) + regions(rest[:at] + rest[k:])
    m = re.search(r"<<(\d+)>>", rest)
    if m:
        return [x for n in range(int(m[1]) + 1) for x in regions(rest[: m.start()] + "* " * n + rest[m.end() :])]
    return [*out, rest.split()]


def test_template_labels_by_brute_force(spark):
    """Every template, in its longest and shortest wording, with a mandatory word changed, and between other words."""
    templates = license_templates.TEMPLATES
    forms = {k: regions(v) for k, v in templates.items()}
    texts = []
    for f in forms.values():
        for words in (max(f, key=len), min(f, key=len)):
            said = [w if w != "*" else f"x{i}" for i, w in enumerate(words)]
            texts += [" ".join(said), "some " + ", ".join(said).upper() + " more", " ".join(w if i != len(said) - 1 else "other" for i, w in enumerate(said))]

    def accepts(words, form):
        return any(all(b in ("*", a) for a, b in zip(words[i:], form)) for i in range(len(words) - len(form) + 1))

    got = by_id(license_templates.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", t.lower())
        want = {k for k, f in forms.items() if any(accepts(words, x) for x in f)}
        assert {m.label for m in got[i].matches} == want, t


def test_a_long_text_of_one_phrase(spark):
    """Counting is linear: above a megabyte of nothing but places."""
    r = license_templates.scan_licenses(spark.createDataFrame([(1, "mit license " * 100_000)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (200_000, 100_000, 0, 199_998)


def test_template_regions():
    a = license_templates.TokenAutomaton("start [[may be]] of <<2>> end")
    ok = lambda s: a.match(s.encode().split(), 0) is not None
    assert ok("start of end") and ok("start may be of x y end") and ok("start of x end")
    assert not ok("start may of end") and not ok("start of x y z end") and not ok("start of")
    for bad in ("[[a", "<<3>>", "[[a]]"):
        with pytest.raises(ValueError):
            license_templates.TokenAutomaton(bad)


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows}
    path = str(tmp_path / "tokens")
    token_scan.write_token_files(docs, path)
    assert {r.doc_id: r.n_tokens for r in token_scan.count_tokens(spark, path).collect()} == want
    for block in (7, 64, 1000):  # documents over many blocks, headers over two
        scan = token_scan.scan_token_files(spark, path, block_tokens=block)
        assert {token_scan._from_header(bytes(r.first_ids)): r.n_ids - token_scan.HEADER for r in scan.collect()} == want
        assert scan.groupBy("path").agg((F.max("ordinal") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_unended_and_empty_files(spark, tmp_path):
    import numpy as np

    end = token_scan.END_ID
    (tmp_path / "a").write_bytes(np.array([1, 2, end, end, 3], "<u2").tobytes())
    (tmp_path / "b").write_bytes(b"")
    got = token_scan.scan_token_files(spark, str(tmp_path), keep=1, block_tokens=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_ids) for r in got] == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]


def test_pieces(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(piece_agenda.encode_pieces(docs, path))
    digest = by_id(piece_agenda.encode_pieces(docs, path, digests=True))
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        assert list(got[i].ids) == ids and got[i].decoded == sp.decode(ids)
        assert digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_agenda.encode_pieces(none, path).count() == 0


def test_both_agendas_agree():
    import public_tokenizers

    v = piece_agenda.PieceVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    parts = ["▁the", "▁aaaaaaa", "x", "▁▁▁x", "日本語", "abcabcabc▁", "é\n"]
    assert v.array_agenda(parts) == [v.heap_agenda(p) for p in parts]


def test_media(docs, rows, none):
    stored = media_sniffing.store_media(docs)
    got, media = by_id(media_sniffing.sniff_media(stored)), by_id(stored)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert bytes(got[i].samples) == payload and got[i].type == media_sniffing.STORED[zlib.crc32(payload) % 5]
        assert media_sniffing.sniff(bytes(media[i].media))[0][2] == len(media[i].media)
    assert media_sniffing.store_media(none).count() == 0


@pytest.mark.parametrize("kind", media_sniffing.STORED)
def test_carving_and_broken_media(kind):
    medium = media_sniffing.WRITERS[kind](b"ab " * 128)
    found = media_sniffing.sniff(b"BM RIFF junk P5 " + medium + b"rest" + medium)
    assert [(k, n) for k, _, n, _ in found] == [(kind, len(medium))] * 2 and found[0][3] == b"ab " * 128
    assert media_sniffing.sniff(medium[:-1]) == [] and media_sniffing.sniff(b"") == []


def test_media_query(spark, docs, rows, tmp_path):
    """All columns of the query, from its registered function, against plain computations."""
    from attestra.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.QUERIES["op10_media_sniffing"](spark, str(tmp_path)))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        kind = media_sniffing.STORED[zlib.crc32(payload) % 5]
        medium = media_sniffing.WRITERS[kind](payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(medium), hashlib.sha256(medium).hexdigest())
        assert r.feature.startswith(f"type={kind};declared=") and r.feature.endswith(f";mean={sum(payload) / len(payload):.4f}")
    assert media_sniffing.sniff_media(media_sniffing.store_media(docs.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op1_license_templates", "op2_token_scan", "op3_katz_backoff", "op4_line_windows", "op5_byte_cnn", "op7_level_packing", "op8_piece_agenda", "op9_edit_embedding"])
def test_registered_queries_take_awkward_tables(spark, clash, none, tmp_path, name):
    """Columns named as the operators' own, null and repeated ids, null and empty texts, a text above a megabyte; and no rows."""
    from attestra.llm import queries

    long = "word " * 5000 + "x" * 30_000 if name != "op8_piece_agenda" else "word " * 20_000
    more = spark.createDataFrame([(3, long * 10, "en", "s", 1, 1, "z", [1]), (3, "", None, None, 0, 1, "z", [1]), (3, "", None, None, 0, 1, "z", [1]), (None, None, None, None, None, 2, None, None)], clash.schema)
    table = clash.unionByName(more).selectExpr("*", "1 as score", "'c' as codes", "2L as chunk", "3 as part", "'t' as labels", "4 as ordinal", "5 as kind", "6 as path")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    for folder, rows in (("some", table), ("none", table.limit(0))):
        rows.write.parquet(str(tmp_path / folder / "documents.parquet"))
        labels.write.parquet(str(tmp_path / folder / "labels.parquet"))
    n = table.count()
    got = queries.QUERIES[name](spark, str(tmp_path / "some"))
    assert got.count() >= n if name == "op7_level_packing" else got.count() == n
    assert queries.QUERIES[name](spark, str(tmp_path / "none")).count() == 0
