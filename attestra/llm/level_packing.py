"""Operator 7: sum-of-squares online packing.

Texts become ids, each text's followed by an end id. Whole windows are cut off long
documents; what is left is placed, in order of arrival, into the partially filled window
whose fill level makes the sum of the squared counts of levels least, or into a new one.
Only a level array with the counts and the windows at each level is kept. When a partition
ends, the windows still open are joined and cut anew, so all but one of them fill up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestra.llm.bpe import added_tokens, default_vocabulary, load
from attestra.llm.common import id_and_text, map_arrow, read_table

WINDOW, END_ID = 1024, 0
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class LevelArray:
    """Open windows by fill level; pieces leave as soon as their window is full."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        """Pieces (doc_id, start, ids, doc_tokens) of one window get their place."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that makes the sum of squares least; the fullest at equal sums."""
        n, top = self.count, self.window - size
        gain = 2 * (n[size + 1 : self.window + 1] - n[1 : top + 1]) + 2
        if len(gain):
            gain[-1] = 1 - 2 * n[top]  # a full window leaves the counts
            gain = np.where(n[1 : top + 1] > 0, gain, np.iinfo(np.int64).max)
            best = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[best] <= 2 * n[size] + 1:
                return best + 1
        return 0

    def place(self, doc_id: object, start: int, ids: bytes, total: int) -> None:
        size = len(ids) // 4
        if size == self.window:
            self._close([(doc_id, start, ids, total)])
            return
        level = self.level_for(size)
        pieces = self.at[level].pop() if level else []
        pieces.append((doc_id, start, ids, total))
        self.count[level] -= level > 0
        if level + size == self.window:
            self._close(pieces)
            return
        self.at[level + size].append(pieces)
        self.count[level + size] += 1

    def finish(self) -> None:
        """Join the open windows' pieces and cut them at window boundaries."""
        pieces: list[tuple] = []
        room = self.window
        for level in self.at:
            for doc_id, start, ids, total in (p for some in level for p in some):
                while ids:
                    cut = ids[: 4 * room]
                    pieces.append((doc_id, start, cut, total))
                    start, ids, room = start + len(cut) // 4, ids[4 * room :], room - len(cut) // 4
                    if not room:
                        self._close(pieces)
                        pieces, room = [], self.window
            level.clear()
        if pieces:
            self._close(pieces)
        self.count[:] = 0


def _pack(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, window: int, end_id: int, added: dict[str, int]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bpe = load(ranks_path, pattern)
    levels = LevelArray(window, TaskContext.get().partitionId() << 40)
    end = end_id.to_bytes(4, "little")
    kind = pa.int64()

    def out() -> pa.RecordBatch:
        cols = list(zip(*levels.done)) if levels.done else [()] * 7
        levels.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(cols)], _NAMES)

    for batch in batches:
        kind = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = bpe.ids_with_added(text, added) + end
            total = len(ids) // 4
            for start in range(0, total, window):
                levels.place(doc_id, start, ids[4 * start : 4 * (start + window)], total)
        yield out()
    levels.finish()
    yield out()


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: dict[str, str] | None = None) -> DataFrame:
    """Pieces of all whole texts in sequences of `window` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null and empty texts are one end id. At most one sequence a partition stays short of
    its window. A task holds the ids of its open windows, at most those of its partition. Null ids stay null,
    repeated rows are packed each; other columns stay behind; an empty table gives no piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in _NAMES[1:])
    return map_arrow(id_and_text(docs), _pack, schema, window=window, end_id=end_id, added=added_tokens() if vocabulary is None else {}, **(vocabulary or default_vocabulary()))


def op7_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
