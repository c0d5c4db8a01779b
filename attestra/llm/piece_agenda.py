"""Operator 8: SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut before every run of spaces (no piece of such a vocabulary holds a space
after another character, so no merge crosses a cut). Each distinct part is encoded by an
agenda of adjacent symbol pairs: the pair whose merged piece has the highest score goes
first, the leftmost at equal scores, until no pair is a piece; characters that are no
piece become bytes. Short parts run through one array-wide agenda per Arrow batch, long
ones through a heap. Every new part is checked against the sentencepiece library, batch by
batch; a difference is an error, never a result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import id_and_text, map_arrow, read_table

SPACE = "▁"
#: Parts kept per worker, and characters from which a part has a heap of its own.
CACHE_PARTS, LONG_PART = 600_000, 48
_NO_PAIR = np.int64(2**62)


class PieceVocabulary:
    """Pieces, scores and the table of mergeable pairs of a model file."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.size = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        self.bytes_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = ids = {pieces[i]: i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("a piece holds a space after another character; texts cannot be cut at spaces")
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        scores = {i: sp.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs = {k: (order[scores[i]], i) for k, i in pairs.items()}
        keys = np.array([a * n + b for a, b in self.pairs], np.int64)
        at = np.argsort(keys)
        self.pair_keys = np.append(keys[at], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([x[0] for x in self.pairs.values()], np.int64)[at], 0)
        self.pair_id = np.append(np.array([x[1] for x in self.pairs.values()], np.int64)[at], 0)

    def symbols(self, part: str) -> list[int]:
        """Ids of the characters; -1 - code point where a character is no piece."""
        return [self.ids.get(c, -1 - ord(c)) for c in part]

    def finish(self, symbols: list[int]) -> list[int]:
        """Unknown characters as bytes."""
        if min(symbols, default=0) >= 0:
            return symbols
        return [y for x in symbols for y in ([x] if x >= 0 else [self.bytes_id[b] for b in chr(-1 - x).encode()])]

    def heap_agenda(self, part: str) -> list[int]:
        """One part of any length: a heap of pairs over a linked list of symbols."""
        sym = self.symbols(part)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (hit := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(agenda, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, merged = heapq.heappop(agenda)
            j = right[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j] = merged, False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return self.finish([s for s, ok in zip(sym, alive) if ok])

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.searchsorted(self.pair_keys, keys)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_rank[at], _NO_PAIR >> 32), self.pair_id[at]

    def array_agenda(self, parts: list[str]) -> list[list[int]]:
        """Many short, non-empty parts at once: each round takes the best pair of every part."""
        out: list[list[int]] = [[]] * len(parts)
        size = np.array([len(p) for p in parts], np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kinds, kind = np.unique(chars, return_inverse=True)
        sym = np.array([self.ids.get(chr(c), -1 - int(c)) for c in kinds], np.int64)[kind]
        which = np.arange(len(parts))
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        rank = np.full(len(sym), _NO_PAIR >> 32, np.int64)
        merged = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], merged[:-1] = self._lookup(sym[:-1], sym[1:])
        rank[start + size - 1] = _NO_PAIR >> 32
        while len(which):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), start)
            go = (best >> 32) < (_NO_PAIR >> 32)
            done = np.flatnonzero(~go)
            if len(done):
                flat, ends = sym[np.repeat(~go, size)].tolist(), np.cumsum(size[done]).tolist()
                for k, a, b in zip(which[done].tolist(), [0, *ends], ends):
                    out[k] = self.finish(flat[a:b])
            at = (best & 0xFFFFFFFF)[go]
            sym[at] = merged[at]
            stay = np.repeat(go, size)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, rank, merged = sym[stay], rank[stay], merged[stay]
            which, size = which[go], size[go] - 1
            start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
            at = place[at]
            last = start + size - 1
            end = at == last
            rank[at[end]] = _NO_PAIR >> 32
            a = at[~end]
            rank[a], merged[a] = self._lookup(sym[a], sym[a + 1])
            a = at[at > start] - 1
            rank[a], merged[a] = self._lookup(sym[a], sym[a + 1])
        return out


class PieceCodec:
    """Encodes and decodes whole texts, keeping the parts it has met."""

    def __init__(self, model_path: str) -> None:
        self.v = PieceVocabulary(model_path)
        self.decimal = [str(i).encode() for i in range(self.v.size)]
        self.ids: dict[str, bytes] = {}  # of each part, without its first space: comma-joined ids
        self.odd: dict[str, bytes] = {}  # decoded form of those parts that do not decode to themselves

    def cut(self, text: str) -> list[str]:
        """The text's parts, each without the one space before it (at the start: the model's own)."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        return [x[1:].replace(" ", SPACE) for x in re.findall(r" +[^ ]*", " " + text)]

    def learn(self, parts: set[str]) -> None:
        """Encode new parts, decode what came out, and check the ids against the library."""
        todo = list(parts - self.ids.keys())
        if todo and len(self.ids) + len(todo) > CACHE_PARTS and self.ids:
            for kept in (self.ids, self.odd):
                kept.clear()
            todo = list(parts)
        for at in range(0, len(todo), 20_000):
            some = todo[at : at + 20_000]
            short = [SPACE + p for p in some if len(p) < LONG_PART]
            quick = iter(self.v.array_agenda(short) if short else [])
            found = [next(quick) if len(p) < LONG_PART else self.v.heap_agenda(SPACE + p) for p in some]
            checked = self.v.library.encode([p.replace(SPACE, " ") for p in some], num_threads=1)
            for p, ids, true in zip(some, found, checked):
                if ids != true and p:  # one space alone is no text for the library
                    raise ValueError(f"the agenda's ids {ids} of {p!r} are not the library's {true}")
                self.ids[p] = b",".join([self.decimal[i] for i in ids])
                back = b"".join([self.v.raw[i] for i in ids])
                if back != b" " + p.replace(SPACE, " ").encode():
                    self.odd[p] = back

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Comma-joined ids and decoded text."""
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*cut))
        for text, parts in zip(texts, cut):
            if self.odd:
                back = b"".join([self.odd.get(p) or b" " + p.replace(SPACE, " ").encode() for p in parts])[1:]
            else:  # every part decodes to itself, and so does the text
                back = text.replace(SPACE, " ").encode()
            yield b",".join(map(self.ids.__getitem__, parts)), back


def _encode(batches: Iterator[pa.RecordBatch], model_path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    codec = PieceCodec(model_path)
    for batch in batches:
        ids = batch.column("doc_id")
        got = list(codec.encode_batch(batch.column("text").to_pylist()))
        counts = pa.array([x.count(b",") + 1 if x else 0 for x, _ in got], pa.int64())
        if digests:
            shas = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in got], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids, counts, *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            lists = pa.array([np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x, _ in got], pa.list_(pa.int32()))
            texts = pa.array([x[1].decode("utf-8", "replace") for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([ids, counts, lists, texts], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_pieces(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text, or their SHA-256 digests.

    One row per input row: doc_id, n_tokens, then ids and decoded (or ids_sha256 and
    decoded_sha256). Null and empty texts have no ids and decode to the empty
    text; null ids stay null; repeated rows give repeated results; other columns stay behind.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_arrow(id_and_text(docs), _encode, f"doc_id {kind}, n_tokens long, {rest}", model_path=model_path, digests=digests)


def op8_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return encode_pieces(read_table(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"), digests=True)
