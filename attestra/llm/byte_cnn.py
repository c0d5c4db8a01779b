"""Operator 5: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole. Learned filters
run over each chunk (embedded bytes, and how strongly the bytes ahead repeat at some
distance), are max-pooled over its positions, and the chunks' pooled vectors are combined by their
mean and their maximum into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import crc_mod, crc_mod_column, id_and_text, map_arrow, read_table, text_bytes

CHUNK, HOP, WIDTH, STRIDE, EMBED, FILTERS = 256, 192, 12, 4, 6, 24
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
LAGS, LAG_SAMPLES = range(2, 25), 8
#: Bound of the fitting sample: labelled rows of each class. Their texts are used whole.
ROWS_PER_CLASS = 700
#: Rows of a step end where their chunks get so many (a longer text is a step of its own).
CHUNKS_PER_STEP = 1500
EPOCHS, BATCH_ROWS, RATE, SEED = 8, 28, 0.004, 11
THRESHOLD, FOLDS = 0.3, 5


def chunks_of(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes; the last chunk is filled up with zeros, the empty text is one chunk of zeros."""
    n = 1 + max(0, -(-(len(text) - CHUNK) // HOP))
    flat = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::HOP]


def _repeats(chunks: np.ndarray) -> np.ndarray:
    """(n, POSITIONS): the largest share of equal bytes, over the distances LAGS, among samples ahead of a position."""
    most = np.zeros((len(chunks), POSITIONS), np.float32)
    filled = chunks[:, ::STRIDE] != 0
    for lag in LAGS:
        ahead = chunks[:, lag::STRIDE]
        equal = np.zeros((len(chunks), CHUNK // STRIDE + 1), np.int16)
        m = ahead.shape[1]
        np.cumsum((chunks[:, ::STRIDE][:, :m] == ahead) & filled[:, :m], axis=1, dtype=np.int16, out=equal[:, 1 : m + 1])
        equal[:, m + 1 :] = equal[:, m : m + 1]
        share = equal[:, LAG_SAMPLES:] - equal[:, :-LAG_SAMPLES]
        np.maximum(most[:, : share.shape[1]], share[:, :POSITIONS], out=most[:, : share.shape[1]])
    return most / LAG_SAMPLES


@dataclass
class ByteCnn:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED + 1, FILTERS)
    offset: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): of the mean and of the maximum
    bias: float

    @staticmethod
    def fresh() -> ByteCnn:
        rng = np.random.default_rng(SEED)
        f = np.float32
        return ByteCnn(rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED + 1, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.2, 2 * FILTERS).astype(f), 0.0)

    def windows(self, chunks: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """(n, POSITIONS, WIDTH * EMBED + 1) inputs of the filters."""
        embedded = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.concatenate((seen, repeats[:, :, None]), axis=2)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(n, FILTERS): each filter's largest answer within each chunk."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), 256):
            some = np.ascontiguousarray(chunks[a : a + 256])
            x = self.windows(some, _repeats(some))
            y = x.reshape(-1, x.shape[2]) @ self.filters
            out[a : a + 256] = np.maximum(y.reshape(len(some), POSITIONS, FILTERS).max(axis=1) + self.offset, 0)
        return out

    def logits(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One per text whose chunks begin at starts."""
        counts = np.diff(np.append(starts, len(pooled)))[:, None]
        mean = np.add.reduceat(pooled, starts, axis=0) / counts
        return np.hstack((mean, np.maximum.reduceat(pooled, starts, axis=0))) @ self.weights + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        parts = [chunks_of(t) for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        pooled = np.concatenate([self.pooled(p) for p in _grouped(parts)])
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled, starts).astype(np.float64), -30, 30)))


def _grouped(parts: list[np.ndarray], most: int = 4096) -> Iterator[np.ndarray]:
    """Chunks of neighbouring texts together, so short texts do not run one by one."""
    held: list[np.ndarray] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def fit(rows: list[tuple[np.ndarray, int]]) -> ByteCnn:
    """Adam on the logistic loss, from rows of (chunks, label) and shortened good texts. Without both classes, the score is 0.5 for all."""
    net = ByteCnn.fresh()
    if len({y for _, y in rows}) < 2:
        net.weights[:] = 0
        return net
    rows = rows + [(_shortened(c, k), 1) for k, (c, y) in enumerate(rows) if y]
    repeats = [_repeats(c) for c, _ in rows]
    labels = np.array([y for _, y in rows], np.float32)
    rng = np.random.default_rng(SEED)
    params = {"embed": net.embed, "filters": net.filters, "offset": net.offset, "weights": net.weights, "bias": np.zeros(1, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for pick in _steps(order, [len(c) for c, _ in rows]):
            net.bias = float(params["bias"][0])
            grads = _gradients(net, [rows[i][0] for i in pick], [repeats[i] for i in pick], labels[pick])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.bias = float(params["bias"][0])
    return net


def _steps(order: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """The rows in order, BATCH_ROWS at a time or fewer with many chunks."""
    held: list[int] = []
    chunks = 0
    for i in order.tolist():
        if held and (len(held) == BATCH_ROWS or chunks + sizes[i] > CHUNKS_PER_STEP):
            yield np.array(held)
            held, chunks = [], 0
        held.append(i)
        chunks += sizes[i]
    if held:
        yield np.array(held)


def _shortened(chunks: np.ndarray, k: int) -> np.ndarray:
    """The first 8 to 160 bytes of a text: good texts may be short, and lack of evidence speaks for a text."""
    out = chunks[:1].copy()
    out[:, 8 + k * 37 % 153 :] = 0
    return out


def _gradients(net: ByteCnn, parts: list[np.ndarray], repeats: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss; only a filter's best position in a chunk, and a text's best chunk, pass any back."""
    chunks, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    counts = np.array([len(p) for p in parts])
    x = net.windows(chunks, np.concatenate(repeats))
    y = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(len(chunks), POSITIONS, FILTERS)
    best = y.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(y, best[:, None, :], 1)[:, 0] + net.offset, 0)
    mean = np.add.reduceat(pooled, starts, axis=0) / counts[:, None]
    top = np.maximum.reduceat(pooled, starts, axis=0)
    features = np.hstack((mean, top))
    error = (1 / (1 + np.exp(-np.clip(features @ net.weights + net.bias, -30, 30))) - labels) / len(labels)
    of = np.repeat(np.arange(len(parts)), counts)
    back = (error / counts)[of, None] * net.weights[:FILTERS]
    winner = pooled == top[of]
    back = (back + error[of, None] * net.weights[FILTERS:] * winner / np.maximum(np.add.reduceat(winner.astype(np.float32), starts, axis=0), 1)[of]) * (pooled > 0)
    seen = x[np.arange(len(chunks))[:, None], best]  # (n, FILTERS, inputs)
    embed = np.zeros_like(net.embed)
    into = (back[:, :, None] * net.filters.T[None])[:, :, : WIDTH * EMBED].reshape(len(chunks), FILTERS, WIDTH, EMBED)
    where = chunks[np.arange(len(chunks))[:, None, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
    for e in range(EMBED):
        embed[:, e] = np.bincount(where.ravel(), into[..., e].ravel(), 256)
    return {"embed": embed, "filters": np.einsum("nf,nfi->if", back, seen), "offset": back.sum(axis=0), "weights": features.T @ error, "bias": error.sum(keepdims=True)}


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, rows_per_class: int = ROWS_PER_CLASS) -> ByteCnn:
    """Fit on a bounded sample of the labelled rows outside fold 0: of each class the rows_per_class ids of least hash.

    Their whole texts take part; of rows that repeat an id, the least text.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod_column(folds) != 0)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    picks = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class).collect()]
    if not picks:
        return fit([])
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in picks], usable.schema)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = text.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect()  # 2 * rows_per_class at most
    return fit([(chunks_of(r.text.encode()), r.quality) for r in got])


def _scored(batches: Iterator[pa.RecordBatch], net: ByteCnn, folds: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = net.scores(text_bytes(batch))
        held = pa.array([crc_mod(i, folds) == 0 for i in batch.column("doc_id").to_pylist()], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its text alone.

    Null and empty texts are one chunk of zeros and get a score of their own; null ids stay null and
    count as the empty id for the fold; repeated rows get equal scores; without labels of
    both classes all scores are 0.5. Other columns stay behind.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    net = fit_quality(docs, labels)
    return map_arrow(id_and_text(docs), _scored, f"doc_id {kind}, held_out boolean, score double, predicted int", net=net, folds=FOLDS, threshold=THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least THRESHOLD."""
    net = fit_quality(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(net.scores(text_bytes(batch)) >= THRESHOLD))

    return map_arrow(docs, keep, docs.schema)


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
