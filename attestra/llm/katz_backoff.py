"""Operator 3: language-model scoring by Katz backoff.

Counts are discounted after Good and Turing; what a history's seen continuations leave goes to
the unseen ones in proportion to the next shorter model, by a backoff weight that makes the
probabilities sum to one exactly. The unigram model leaves the rest to one unknown word.

The corpus is cut into chunks, written once as word indices with a local dictionary. For each
order, every chunk sends its distinct n-grams, dealt into buckets by history, to tables of
counts; a bucket adds them up, keeps the statistics of its histories, and sends every chunk the
counts of its own n-grams. So no task holds more than a chunk or a bucket, frequent histories are
split over buckets, and no model is ever collected or broadcast. Scores then follow in each
chunk, for each token from the longest history down.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import crc_mod, id_and_text, map_arrow, read_table, release, remove, shared_dir

#: Order of the model, counts that are discounted, share of documents held out (1 of FOLDS), chunks for each bucket.
ORDER, DISCOUNTED, FOLDS, CHUNKS_PER_BUCKET = 3, 5, 10, 2
#: Keys of the end and of the beginning of a text; neither is a word.
END_WORD, BEGIN_WORD = b" ", b"  "
_ROWS = "kind string, level int, chunk long, bucket int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes; of integers only the planes that the largest one needs."""
    import zstandard

    planes = []
    for a in arrays:
        kind, words = a.dtype.str, np.ascontiguousarray(a).view(f"<u{a.itemsize}")
        width = a.itemsize
        if a.dtype.kind in "iu":
            width = (int(words.max(initial=0)).bit_length() + 7) // 8
            if kind == "<i8" and width < 4:
                kind = "<i4"
        planes.append((kind, len(a), b"".join((words >> 8 * i).astype(np.uint8).tobytes() for i in range(width))))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _planes(blob: bytes) -> list[tuple[str, int, bytes]]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _array(kind: str, n: int, planes: bytes) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for i in range(len(planes) // max(n, 1)):
        out[:, i] = np.frombuffer(planes, np.uint8, n, i * n)
    return out.reshape(-1).view(kind)


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [_array(*p) for p in _planes(blob)]


def _sorted(codes: np.ndarray, places: np.ndarray | None = None, kind: str | None = "stable") -> tuple[np.ndarray, np.ndarray]:
    """Codes, none negative, in order and the places (ascending; by default 0, 1, ...) where they stood; ties by place.

    Code and place share a word where they fit, since sorting words takes a fraction of an argsort;
    where they don't, kind None leaves ties any way.
    """
    if places is None:
        places = np.arange(len(codes))
    bits = int(places[-1]).bit_length() if len(places) else 0
    if len(codes) and int(codes.max()).bit_length() + bits < 64:
        both = codes << bits
        both |= places
        both.sort()
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(codes, kind=kind)
    return codes[order], places[order]


def _starts(codes: np.ndarray) -> np.ndarray:
    """Which of the codes, in order, differ from the one before."""
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return new


class _Chunk:
    """Word indices of some documents (each begins with the begin word, ends with the end word) and a dictionary of word keys."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, words: np.ndarray, keys: np.ndarray) -> None:
        self.lengths, self.held, self.words, self.keys = lengths, held, words, keys
        self.start = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        self.held_places = np.flatnonzero(np.repeat(held, lengths))
        self.place = np.arange(len(words)) - np.repeat(self.start, lengths)  # 0: the begin word
        self.grams: list[np.ndarray] = [words]  # of each level: local n-gram that ends here, -1 where none does
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []  # of each level above 1: history and word of each local n-gram
        self.first: list[np.ndarray] = []  # of each level above 1: a place where each local n-gram ends

    def extend(self) -> None:
        """The next level's local n-grams."""
        hist, n_words = self.grams[-1], len(self.keys)
        at = np.flatnonzero(self.place >= len(self.grams))
        code, at = _sorted(hist[at - 1] * n_words + self.words[at], at)
        new = _starts(code)
        gram = np.full(len(hist), -1, np.int64)
        gram[at] = np.cumsum(new) - 1
        found = code[new]
        before = found // n_words
        self.grams.append(gram)
        self.pairs.append((before, found - before * n_words))
        self.first.append(at[new])

    def _size(self, level: int) -> int:
        return len(self.keys) if level == 1 else len(self.first[level - 2])

    def train_counts(self, level: int) -> np.ndarray:
        g, n = self.grams[level - 1] + 1, self._size(level) + 1
        return (np.bincount(g, minlength=n) - np.bincount(g[self.held_places], minlength=n))[1:]

    def in_held(self, level: int) -> np.ndarray:
        """Which n-grams stand in a held-out text: only after those can an unseen word follow."""
        out = np.zeros(self._size(level) + 1, np.uint8)  # the last one for places where no n-gram ends
        out[self.grams[level - 1][self.held_places]] = 1
        return out[:-1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    special = [xxhash.xxh3_64_intdigest(w) for w in (BEGIN_WORD, END_WORD)]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")).cast(pa.large_string()))
        flat = lists.flatten()
        ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        filled = np.asarray(pc.binary_length(flat)) > 0
        coded = flat.dictionary_encode()
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()] + special, np.uint64)
        words = np.asarray(coded.indices)[filled].astype(np.int64)
        sizes = np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(filled)))[ends])))
        lengths = sizes + 2
        stream = np.full(int(lengths.sum()), len(keys) - 2, np.int64)
        stop = np.cumsum(lengths)
        stream[stop - 1] = len(keys) - 1
        inner = np.ones(len(stream), bool)
        inner[stop - 1] = inner[stop - lengths] = False
        stream[inner] = words
        seen = np.bincount(stream, minlength=len(keys))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = batch.column("doc_id")
        held = np.array([crc_mod(i, FOLDS) == 0 for i in ids.to_pylist()])
        used = int((seen > 0).sum())
        blob = _pack(lengths.astype(np.int32), held.astype(np.uint8), rank[stream].astype(np.int32), keys[order][:used])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([blob], pa.binary())], ["chunk", "ids", "blob"])
        number += 1


def _load(blob: bytes) -> _Chunk:
    lengths, held, words, keys = _unpack(blob)
    return _Chunk(lengths.astype(np.int64), held.astype(bool), words.astype(np.int64), keys)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d_1 .. d_k of Good and Turing from n_1 .. n_(k + 1); where they are out of order, half a count off each."""
    n, k = counts_of_counts.astype(np.float64), len(counts_of_counts) - 1
    r = np.arange(1, k + 1)
    with np.errstate(all="ignore"):
        common = (k + 1) * n[k] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    return d if np.all(np.isfinite(d)) and np.all((d > 0) & (d < 1)) else (r - 0.5) / r


class _Model:
    """What all tasks know: totals and discounts of the levels so far, and the number of buckets."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.tokens, self.types = buckets, 0, 0
        self.d: list[np.ndarray] = []
        self.rest = self.scale = 0.0

    def unigrams(self, total: np.ndarray) -> None:
        self.tokens, self.types = int(total[0]), int(total[1])
        n = total[2:]
        self.d.append(discounts(n))
        r = np.arange(1, DISCOUNTED + 1)
        left = float(((1 - self.d[0]) * r * n[:-1]).sum())
        self.scale = self.tokens + (left == 0)
        self.rest = (left or 1.0) / self.scale if self.tokens else 1.0

    def discounted(self, level: int, counts: np.ndarray) -> np.ndarray:
        d = np.concatenate(([0], self.d[level - 1] * np.arange(1, DISCOUNTED + 1)))
        return np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], counts)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their counts; all unknown words are one."""
        return np.where(counts > 0, self.discounted(1, counts) / max(self.scale, 1), self.rest)

    def seen(self, level: int, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Probability of seen n-grams by their counts and their histories' totals."""
        return self.unigram(counts) if level == 1 else self.discounted(level, counts) / np.maximum(totals, 1)

    def spread(self, total: np.ndarray) -> np.ndarray:
        """Over how many buckets the continuations of a history go."""
        return np.minimum(1 + total * 2 * self.buckets // max(self.tokens, 1), self.buckets)

    def bucket_of(self, ids: np.ndarray, totals: np.ndarray, hist: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of histories by their ids and totals, and pairs of a history and a word's id: home bucket of the history, or, for a frequent one, one of several by the word."""
        home, spread = ids % self.buckets, self.spread(totals)
        bucket = home[hist]
        wide = np.flatnonzero((spread > 1)[hist])
        bucket[wide] = (bucket[wide] + (word[wide] * 2_654_435_761 >> 7) % spread[hist[wide]]) % self.buckets
        return bucket


class _View:
    """A chunk with all that the buckets have sent it, level by level, and the tokens' probabilities if it is to be scored."""

    def __init__(self, model: _Model, blob: bytes, sent: dict[tuple[str, int], dict[int, list[tuple]]], levels: int, scored: bool = False) -> None:
        self.m, self.c, self.scored = model, _load(blob), scored
        self.sent = sent
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []  # of each level's n-grams as histories
        self.slots: list[tuple[np.ndarray, np.ndarray]] = []
        self.prob: np.ndarray | None = None  # at each token, by the levels so far
        for level in range(1, levels + 1):
            self._level(level, scored and level == levels)

    def slices(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the level's n-grams for sending, and where each bucket's slice begins."""
        if level == 1:
            bucket = (self.c.keys % np.uint64(self.m.buckets)).astype(np.int64)
            _, order = _sorted(bucket)
        else:
            hist, word = self.c.pairs[level - 2]
            ids = self.ids[level - 2]
            rank = np.empty(len(ids), np.int64)
            rank[_sorted(ids)[1]] = np.arange(len(ids))
            bucket = self.m.bucket_of(ids, self.counts[level - 2], hist, self.ids[0][word])
            _, order = _sorted(bucket * len(ids) + rank[hist])
        return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=self.m.buckets))))

    def _gather(self, kind: str, level: int, column: int, dtype: type) -> np.ndarray:
        order, cut = self.slots[level - 1]
        out = np.zeros(len(order), dtype)
        for bucket, columns in self.sent.get((kind, level), {}).items():
            out[order[cut[bucket] : cut[bucket + 1]]] = _array(*columns[column])
        return out

    def _gather_ids(self, level: int) -> np.ndarray:
        """Ids of the level's n-grams from their ranks in their buckets."""
        order, cut = self.slots[level - 1]
        bucket = np.empty(len(order), np.int64)
        bucket[order] = np.repeat(np.arange(self.m.buckets), np.diff(cut))
        return self._gather("counts", level, 0, np.int64) * self.m.buckets + bucket

    def _level(self, level: int, last: bool) -> None:
        if level > 1:
            self.c.extend()
        self.slots.append(self.slices(level))
        if not last:
            self.ids.append(self._gather_ids(level))
        self.counts.append(self._gather("counts", level, -1, np.int64))
        gram = self.c.grams[level - 1]
        if level == 1:
            if self.scored:
                self.prob = self.m.unigram(self.counts[0])[gram]
            return
        total = self._gather("alpha", level - 1, 0, np.float64)
        self.totals.append(total)
        if self.scored and ("alpha", level - 1) in self.sent:
            alpha = self._gather("alpha", level - 1, 1, np.float64)
            hist = self.c.pairs[level - 2][0]
            count = self.counts[level - 1]
            with np.errstate(all="ignore"):
                seen = self.m.discounted(level, count) / total[hist]
            # a probability or a weight for each n-gram; the last one, for places where none ends, leaves what is there
            known = np.append(np.where(count > 0, seen, 0.0), 0.0)
            weight = np.append(np.where(count > 0, 0.0, np.where(total > 0, alpha, 1.0)[hist]), 1.0)
            self.prob = known[gram] + weight[gram] * self.prob

    def lower(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram of a level: count of the n-gram without its first word, and, above level 2, that one's history's total."""
        below = self.c.grams[level - 2][self.c.first[level - 2]]
        totals = self.totals[level - 3][self.c.pairs[level - 3][0][below]].astype(np.int64) if level > 2 else np.zeros(len(below), np.int64)
        return self.counts[level - 2][below], totals


def _sent(kinds: list[str], levels: list[int], buckets: list[int], blobs: list[bytes]) -> dict:
    out: dict[tuple[str, int], dict[int, list[tuple]]] = {}
    for k, lv, b, blob in zip(kinds, levels, buckets, blobs):
        out.setdefault((k, lv), {})[b] = _planes(blob)
    return out


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 5
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "level", "chunk", "bucket", "blob"])


def _emit_words(batches: Iterator[pa.RecordBatch], model: _Model) -> Iterator[pa.RecordBatch]:
    """Chunks -> their words, a row a bucket."""
    nothing = pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["kind", "level", "bucket", "blob"])
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _emit(model, 1, False)(pa.Table.from_batches([batch.slice(k, 1)]), nothing).to_batches()


def _emit(model: _Model, level: int, last: bool):
    """Chunks and what was sent to them -> their n-grams of a level, a row a bucket."""

    def run(chunk: pa.Table, sent: pa.Table) -> pa.Table:
        rows = []
        got = _sent(*(sent.column(c).to_pylist() for c in ("kind", "level", "bucket", "blob")))
        for number, blob in zip(chunk.column("chunk").to_pylist(), chunk.column("blob").to_pylist()):
            view = _View(model, blob, got, level - 1)
            c = view.c
            if level > 1:
                c.extend()
            order, cut = view.slices(level)
            count = c.train_counts(level)[order]
            marks = np.zeros(len(order), np.uint8) if last else c.in_held(level)[order]
            if level == 1:
                columns = [c.keys[order], count, marks]
            else:
                hist, word = (x[order] for x in c.pairs[level - 2])
                # the lower model's probability counts for seen n-grams alone, and a chunk that has seen one sends what it follows from
                lower = (np.where(count > 0, x[order], 0) for x in view.lower(level))
                asked = (c.in_held(level - 1) | (model.spread(view.counts[level - 2]) > 1))[hist]  # a bucket sees a spread history in part
                columns = [view.ids[level - 2][hist], view.ids[0][word], count, *lower, marks + 2 * asked.astype(np.uint8)]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                mine = [x[cut[b] : cut[b + 1]] for x in columns]
                if level > 1:
                    mine[0] = np.diff(mine[0], prepend=0)
                rows.append(("grams", level, number, b, _pack(*mine)))
        return _table(rows)

    return run


def _count(model: _Model, level: int, last: bool):
    """All chunks' n-grams of a bucket -> ranks and held-out marks (below the last level) and counts for each chunk, the bucket's totals, statistics of its histories."""

    def run(grams: pa.Table) -> pa.Table:
        chunks, blobs = grams.column("chunk").to_pylist(), grams.column("blob").to_pylist()
        bucket = grams.column("bucket")[0].as_py()
        parts = [_unpack(b) for b in blobs]
        sizes = [len(p[0]) for p in parts]
        count = np.concatenate([p[1 if level == 1 else 2] for p in parts]).astype(np.int64)
        rows = []
        if level == 1:
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            size = len(keys)
        else:
            codes, at = _sorted(np.concatenate([np.cumsum(p[0]) for p in parts]))
            new = _starts(codes)
            hist = codes[new]
            of = np.empty(len(at), np.int64)  # n-grams' places among the histories
            of[at] = np.cumsum(new) - 1
            w = np.concatenate([p[1] for p in parts]).astype(np.int64)
            words = int(w.max()) + 1
            codes, at = _sorted(of * words + w, kind=None)
            new = _starts(codes)
            inverse = np.empty(len(at), np.int64)
            inverse[at] = np.cumsum(new) - 1
            mine = codes[new] // words  # distinct n-grams' places among the histories
            size = len(mine)
            asked = np.zeros(len(hist), bool)
            asked[of[np.concatenate([p[-1] for p in parts]) > 1]] = True
            told = np.flatnonzero(count)
            lower = [np.zeros(size, np.int64) for _ in range(2)]
            for to, k in zip(lower, (3, 4)):
                to[inverse[told]] = np.concatenate([p[k] for p in parts])[told]
            below = model.seen(level - 1, *lower)
        total = np.bincount(inverse, count, size).astype(np.int64)
        if not last:
            ranks = np.empty(size, np.int64)  # an n-gram's id is its rank times the buckets, and its bucket
            ranks[_sorted(int(total.max()) - total)[1]] = np.arange(size)
        start = 0
        for chunk, n, part in zip(chunks, sizes, parts):
            own = inverse[start : start + n]
            rows.append(("counts", level, chunk, bucket, _pack(*([] if last else [ranks[own], part[-1] & 1]), total[own])))
            start += n
        counted = total
        if level == 1:
            import xxhash

            counted = total[keys != np.uint64(xxhash.xxh3_64_intdigest(BEGIN_WORD))]
        n_r = np.bincount(np.minimum(counted, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        rows.append(("totals", level, -1, bucket, _pack(np.concatenate(([counted.sum(), (counted > 0).sum()], n_r)).astype(np.int64))))
        if level > 1:
            seen, few = np.flatnonzero(total), np.flatnonzero((total > 0) & (total <= DISCOUNTED))
            sums = np.bincount(mine[seen], total[seen], len(hist)).astype(np.int64)
            lows = np.bincount(mine[seen], below[seen], len(hist)) * asked  # the others' backoff weight is never asked for: their scale is enough
            m = np.bincount(mine[few] * DISCOUNTED + total[few] - 1, minlength=len(hist) * DISCOUNTED).reshape(-1, DISCOUNTED)
            kept = np.flatnonzero(sums)
            home, at = _sorted(hist[kept] % model.buckets)
            kept = kept[at]
            for some in np.split(np.arange(len(kept)), np.flatnonzero(_starts(home))[1:]) if len(kept) else []:
                x = kept[some]
                rows.append(("stats", level, -1, int(home[some[0]]), _pack(np.diff(hist[x], prepend=0), sums[x], lows[x], *m[x].T)))
        return _table(rows)

    return run


def _weigh(model: _Model, level: int):
    """Histories' statistics and the chunks' ids of a bucket -> each chunk's history totals, and backoff weights of those in held-out texts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds, chunks, blobs = (table.column(c).to_pylist() for c in ("kind", "chunk", "blob"))
        stats = [_unpack(b) for k, b in zip(kinds, blobs) if k == "stats"]
        asking = [(c, *(_array(*p) for p in _planes(b)[:2])) for k, c, b in zip(kinds, chunks, blobs) if k == "counts"]
        # the histories at home here stand by their ranks in this bucket
        at = np.concatenate([np.cumsum(s[0]) // model.buckets for s in stats] or [np.zeros(0, np.int64)])
        size = 1 + max([int(x.max(initial=0)) for x in (at, *(ranks for _, ranks, _ in asking))])
        total, below, *m = (np.bincount(at, np.concatenate([s[i] for s in stats] or [at]), size) for i in range(1, 3 + DISCOUNTED))
        left = sum((1 - model.d[level - 1][r - 1]) * r * m[r - 1] for r in range(1, DISCOUNTED + 1))
        none = left <= 0
        scale = total + none  # a history without discounted counts: as if one more had been seen
        alpha = (np.where(none, 1.0, left) / scale) / np.maximum(1 - below, 1e-300)
        hit = total > 0
        scale, alpha = np.where(hit, scale, 0).astype(np.int64), np.where(hit, alpha, 1.0)
        rows = []
        for chunk, ranks, held in asking:
            weights, asked = np.ones(len(ranks)), np.flatnonzero(held)
            weights[asked] = alpha[ranks[asked]]
            rows.append(("alpha", level - 1, chunk, bucket, _pack(scale[ranks], weights)))
        return _table(rows)

    return run


def _score(model: _Model, order: int, kind):
    def run(chunk: pa.Table, sent: pa.Table) -> pa.Table:
        got = _sent(*(sent.column(c).to_pylist() for c in ("kind", "level", "bucket", "blob")))
        out = []
        for ids, blob in zip(chunk.column("ids").to_pylist(), chunk.column("blob").to_pylist()):
            view = _View(model, blob, got, order, True)
            c = view.c
            counts = view.counts[0]
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[c.words]
            known = (counts > 0)[c.words]
            logs = np.log10(view.prob)
            for x in (base, logs, known):
                x[c.start] = 0
            sums = [np.add.reduceat(x, c.start) for x in (known.astype(np.int64), base, logs)]
            n = len(ids)
            out.append(pa.Table.from_arrays([pa.array(ids, kind), pa.array(c.held), pa.array(c.lengths - 1, pa.int64()), pa.array(sums[0], pa.int64()), pa.array([model.tokens] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def _totals(rows: DataFrame, level: int) -> np.ndarray:
    """Sum of the buckets' totals, a few numbers from each."""
    got = rows.where((F.col("kind") == "totals") & (F.col("level") == level)).select("blob").collect()
    return sum((_unpack(bytes(r.blob))[0] for r in got), np.zeros(DISCOUNTED + 3, np.int64))


def _write_kinds(rows: DataFrame, root: str, name: str) -> DataFrame:
    """materialise(), with a folder for each kind, so that one kind can be deleted when it is done with."""
    path = f"{root}/{name}"
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _by_chunk(rows: DataFrame, root: str, name: str) -> DataFrame:
    """Rows of chunks, written or added to a table bucketed by chunk: two such tables meet without a shuffle."""
    spark = rows.sparkSession
    table, buckets = f"attestra_{name}_{root.rsplit('-', 1)[-1]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "chunk").option("path", f"{root}/{name}").mode("append").saveAsTable(table)
    return spark.table(table)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every whole text.

    The model of the given order (2 or more) learns from the rows outside fold 0. Null and empty texts
    are the end alone; null ids stay null and count as the empty id for the fold; repeated rows count each;
    other columns stay behind. Without training rows every word is the unknown one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if order < 2:
        raise ValueError("order is 2 at least")
    spark = docs.sparkSession
    root = shared_dir(spark)
    id_type = docs.schema["doc_id"].dataType
    kind = id_type.simpleString()
    chunks = _by_chunk(map_arrow(id_and_text(docs), _chunks, f"chunk long, ids array<{kind}>, blob binary"), root, "chunks")
    model = _Model(max(4, -(-chunks.count() // CHUNKS_PER_BUCKET)))
    sent: DataFrame | None = None  # all that the buckets have sent the chunks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def send(rows: DataFrame) -> DataFrame:
        return _by_chunk(rows.repartition(parts, "chunk"), root, "sent")

    below = None
    for level in range(1, order + 1):
        if level == 1:
            grams = map_arrow(chunks.select("chunk", "blob"), _emit_words, _ROWS, model=model)
        else:
            grams = chunks.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_emit(model, level, level == order), _ROWS)
        counted = _write_kinds(grams.groupBy("bucket").applyInArrow(_count(model, level, level == order), _ROWS), root, f"counts-{level}")
        del grams
        release(spark)
        total = _totals(counted, level)
        release(spark)
        if level == 1:
            model.unigrams(total)
        else:
            model.d.append(discounts(total[2:]))
            ask = below.unionByName(counted.where("kind = 'stats'"))
            sent = send(ask.groupBy("bucket").applyInArrow(_weigh(model, level), _ROWS))
            del ask
            remove(spark, f"{root}/counts-{level}/kind=stats")
        sent = send(counted.where("kind = 'counts'"))
        remove(spark, f"{root}/counts-{level}")
        below = sent.where((F.col("kind") == "counts") & (F.col("level") == level))
        release(spark)
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_score(model, order, to_arrow_type(id_type)), result)


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
