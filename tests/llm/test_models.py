"""Operators 3 and 5 against brute force and held-out rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from attestra.llm import byte_cnn, katz_backoff
from attestra.llm.katz_backoff import discounts
from tests.llm.conftest import by_id


def brute(rows, order):
    """log10 probability of each text by a dictionary-based model."""
    toks = [["begin of text", *[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").encode().lower().decode()) if w], "end of text"] for _, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, *_ in rows]
    c = [Counter() for _ in range(order + 1)]
    for t, h in zip(toks, held):
        if not h:
            c[1].update(t[1:])
            for m in range(2, order + 1):
                c[m].update(tuple(t[j - m + 1 : j + 1]) for j in range(m - 1, len(t)))
    d = [None]
    for m in range(1, order + 1):
        n = Counter(c[m].values())
        d.append(discounts(np.array([n[r] for r in range(1, 7)])))
    cut = lambda m, k: d[m][k - 1] * k if k <= 5 else k
    n, v = sum(c[1].values()), len(c[1])
    left = n - sum(cut(1, k) for k in c[1].values())
    scale = n + (left <= 1e-12)
    follow = [defaultdict(dict) for _ in range(order + 1)]
    for m in range(2, order + 1):
        for g, k in c[m].items():
            follow[m][g[:-1]][g[-1]] = k

    def p(m, h, w):
        if m == 1:
            return cut(1, c[1][w]) / scale if c[1][w] else (left or 1) / scale
        seen = follow[m].get(h)
        if not seen:
            return p(m - 1, h[1:], w)
        total = sum(seen.values())
        rest = total - sum(cut(m, k) for k in seen.values())
        s = total + (rest <= 1e-12)
        if w in seen:
            return cut(m, seen[w]) / s
        return (rest if rest > 1e-12 else 1) / s / (1 - sum(p(m - 1, h[1:], x) for x in seen)) * p(m - 1, h[1:], w)

    out = []
    for t in toks:
        base = sum(math.log10((c[1][w] + 0.1) / (n + 0.1 * (v + 1))) for w in t[1:])
        out.append((len(t) - 1, sum(c[1][w] > 0 for w in t[1:]), n, base, sum(math.log10(p(min(order, j + 1), tuple(t[j - min(order, j + 1) + 1 : j]), t[j])) for j in range(1, len(t)))))
    if n:
        h = next(iter(follow[2]))
        assert abs(sum(p(2, h, w) for w in [*c[1], "<unknown>"]) - 1) < 1e-9
    return held, out


@pytest.mark.parametrize("order", [2, 3])
def test_katz(docs, rows, order):
    held, want = brute(rows, order)
    got = by_id(katz_backoff.score_documents(docs, order))
    assert len(got) == len(rows)
    for (i, *_), h, w in zip(rows, held, want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_katz_on_nothing(none):
    assert katz_backoff.score_documents(none).count() == 0


def junk(k):
    return " ".join(f"W{(k * 7 + j) % 97}!!" for j in range(30))


def clean(k):
    return " ".join(f"word{chr(97 + (k * 5 + j) % 26)}e" for j in range(30))


def test_quality(spark, none, docs, rows):
    texts = [(i, clean(i) if i % 2 else junk(i)) for i in range(120)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (500, None)], "doc_id long, quality int")
    got = by_id(byte_cnn.score_quality(d, labels))
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    kept = byte_cnn.keep_good(d, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.values() if r.predicted}
    assert byte_cnn.score_quality(docs, labels).count() == len(rows)
    assert byte_cnn.score_quality(none, labels).count() == 0
    assert {r.score for r in byte_cnn.score_quality(d, labels.limit(0)).collect()} == {0.5}


def test_chunks_cover_texts():
    for n in (0, 1, 255, 256, 257, 448, 449, 3000):
        c = byte_cnn.chunks_of(b"x" * n)
        assert (c.shape[0] - 1) * byte_cnn.HOP + byte_cnn.CHUNK >= n and c.shape[0] == 1 + max(0, -(-(n - 256) // 192))


def test_score_by_plain_loops():
    """One text's score, position by position."""
    rng = np.random.default_rng(4)
    net = byte_cnn.ByteCnn.fresh()
    net.bias = 0.1
    net.offset[:] = rng.normal(0, 0.1, len(net.offset))
    for text in (b"", b"ab ab ab ab ab ab ab", bytes(rng.integers(32, 127, 700, dtype=np.uint8))):
        pooled = []
        for at in range(0, max(1, len(text) - byte_cnn.CHUNK + byte_cnn.HOP), byte_cnn.HOP):
            chunk = text[at : at + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
            best = [-math.inf] * byte_cnn.FILTERS
            for p in range(byte_cnn.POSITIONS):
                a = p * byte_cnn.STRIDE
                share = 0
                for lag in byte_cnn.LAGS:
                    places = [a + byte_cnn.STRIDE * k for k in range(byte_cnn.LAG_SAMPLES)]
                    share = max(share, sum(x + lag < byte_cnn.CHUNK and chunk[x] != 0 and chunk[x] == chunk[x + lag] for x in places if x < byte_cnn.CHUNK) if places[-1] < byte_cnn.CHUNK else 0)
                seen = [v for b in chunk[a : a + byte_cnn.WIDTH] for v in net.embed[b]] + [share / byte_cnn.LAG_SAMPLES]
                for f in range(byte_cnn.FILTERS):
                    best[f] = max(best[f], float(np.dot(seen, net.filters[:, f])))
            pooled.append([max(0.0, b + float(o)) for b, o in zip(best, net.offset)])
        features = [sum(c) / len(c) for c in zip(*pooled)] + [max(c) for c in zip(*pooled)]
        z = sum(x * float(w) for x, w in zip(features, net.weights)) + net.bias
        assert net.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_gradient():
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCnn.fresh()
    for k in ("embed", "filters", "offset", "weights"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    parts = [rng.integers(1, 255, (2, byte_cnn.CHUNK)).astype(np.uint8) for _ in range(2)]
    rep = [byte_cnn._repeats(p) for p in parts]
    y = np.array([0.0, 1.0])
    g = byte_cnn._gradients(net, parts, rep, y)

    def loss():
        pooled = [np.maximum((net.windows(p, r).reshape(-1, net.filters.shape[0]) @ net.filters).reshape(len(p), byte_cnn.POSITIONS, -1).max(axis=1) + net.offset, 0) for p, r in zip(parts, rep)]
        z = net.logits(np.concatenate(pooled), np.array([0, 2]))
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for name, at in (("filters", (3, 4)), ("weights", (1,)), ("offset", (2,)), ("embed", (int(parts[0][0, 5]), 1))):
        a = getattr(net, name)
        keep, e = a[at], 1e-6
        a[at] = keep + e
        up = loss()
        a[at] = keep - e
        down = loss()
        a[at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-7)
