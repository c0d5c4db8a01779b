"""Operator 2: token counts by a separator scan over flat, unindexed token files.

A token file is nothing but 16-bit little-endian ids, a document's followed by the
end-of-document id. Its blocks are searched on their own, each by one vectorised
comparison; a prefix scan over the blocks of a file then carries the open document from
block to block, so documents of any length come out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.bpe import default_vocabulary, load
from attestra.llm.common import id_and_text, map_arrow, read_table, shared_dir, text_bytes

#: End-of-document id of byte_bpe_50k, and tokens of a block.
END_ID, BLOCK_TOKENS = 50_256, 1 << 19
#: Ids before each document's own that hold its doc_id: 15 bits each, so none is an end id.
HEADER = 5


def _header(doc_id: int | None) -> bytes:
    value = (doc_id & (1 << 64) - 1) if doc_id is not None else 1 << 64
    return b"".join((value >> 15 * k & 0x7FFF).to_bytes(2, "little") for k in range(HEADER))


def _from_header(ids: bytes) -> int | None:
    value = sum(int.from_bytes(ids[2 * k : 2 * k + 2], "little") << 15 * k for k in range(HEADER))
    return None if value >> 64 else value - (1 << 64) * (value >> 63)


def _tokens(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(ranks_path, pattern)
    for batch in batches:
        out = [_header(i) + np.frombuffer(bpe.ids(t), "<u4").astype("<u2").tobytes() for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_token_files(docs: DataFrame, path: str, vocabulary: dict[str, str] | None = None) -> None:
    """Write the documents as flat token files, one a partition: header ids, the text's ids, the end id.

    The end id is the writer's line separator, so the files hold ids and nothing else.
    doc_id must be integer or null; null texts are empty documents.
    """
    rows = map_arrow(id_and_text(docs), _tokens, "value binary", **(vocabulary or default_vocabulary()))
    separator = END_ID.to_bytes(2, "little").decode("latin-1")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


def _scan_block(batches: Iterator[pa.RecordBatch], end_id: int, keep: int) -> Iterator[pa.RecordBatch]:
    """A row a block: its size, separators, the ids before the first and after the last, and the documents between."""
    for batch in batches:
        rows = []
        for data in text_bytes(batch, "data"):
            ids = np.frombuffer(data, "<u2")
            ends = np.flatnonzero(ids == end_id)
            n = len(ends)
            starts = ends[:-1] + 1
            first = [ids[a : min(b, a + keep)].tobytes() for a, b in zip(starts, ends[1:])]
            head, tail = (int(ends[0]), len(ids) - int(ends[-1]) - 1) if n else (len(ids), 0)
            rows.append((len(ids), n, head, tail, ids[: min(head, keep)].tobytes(), ids[len(ids) - tail :][:keep].tobytes(), [{"at": int(a), "size": int(b - a), "first": f} for a, b, f in zip(starts, ends[1:], first)]))
        cols = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("first", pa.binary())]))]
        names = ["size", "ends", "head", "tail", "head_ids", "tail_ids", "inner"]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), *(pa.array(c, t) for c, t in zip(cols, types))], ["path", "block", *names])


def scan_token_files(spark: SparkSession, path: str, end_id: int = END_ID, keep: int = HEADER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat token files: path, ordinal (in its file), start, n_ids, first_ids (`keep` ids as bytes).

    n_ids leaves out the end id. Ids after a file's last end id are a last document; empty
    files have none. A file is read as one value, so it has to be under 2 GB; its blocks are
    scanned in parallel. keep may not exceed block_tokens.
    """
    if keep > block_tokens:
        raise ValueError("keep exceeds block_tokens")
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    size = 2 * block_tokens
    blocks = files.select("path", F.posexplode(F.expr(f"transform(sequence(0L, (length - 1) div {size}), i -> substring(content, cast(i * {size} + 1 as int), {size}))")).alias("block", "data"))
    found = map_arrow(blocks, _scan_block, "path string, block int, size long, ends long, head long, tail long, head_ids binary, tail_ids binary, inner array<struct<at:long,size:long,first:binary>>", end_id=end_id, keep=keep)
    by = Window.partitionBy("path").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("ends") > 0, F.struct((F.col("offset") + F.col("size") - F.col("tail")).alias("start"), F.concat("tail_ids", F.coalesce("next_ids", F.lit(b""))).alias("ids")))
    scan = (
        found.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("next_ids", F.lead("head_ids").over(by))
        .withColumn("top_ids", F.first("head_ids").over(by))
        .withColumn("final", F.lead("block").over(by).isNull())
        .withColumn("open", F.last(opened, ignorenulls=True).over(before))
        .withColumn("left", opened)
        .withColumn("open_start", F.coalesce("open.start", F.lit(0)))
        .withColumn("open_ids", F.coalesce("open.ids", "top_ids"))
    )

    def document(ordinal, start, size, ids):
        return F.struct(ordinal.alias("ordinal"), start.alias("start"), size.alias("n_ids"), F.expr(f"substring({ids}, 1, {2 * keep})").alias("first_ids"))

    closed = F.when(F.col("ends") > 0, document(F.col("ordinal"), F.col("open_start"), F.col("offset") + F.col("head") - F.col("open_start"), "open_ids"))
    inner = F.transform("inner", lambda x, i: F.struct((F.col("ordinal") + 1 + i).alias("ordinal"), (F.col("offset") + x["at"]).alias("start"), x["size"].alias("n_ids"), x["first"].alias("first_ids")))
    last_start = F.coalesce("left.start", "open_start")
    rest = F.when(F.col("final") & (F.col("offset") + F.col("size") > last_start), document(F.col("ordinal") + F.col("ends"), last_start, F.col("offset") + F.col("size") - last_start, "coalesce(left.ids, open_ids)"))
    every = F.concat(inner, F.filter(F.array(closed, rest), lambda x: x.isNotNull()))
    return scan.select("path", F.inline(every))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.array([_from_header(x) for x in batch.column("first_ids").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, batch.column("n_tokens")], ["doc_id", "n_tokens"])


def count_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens of every document in files by write_token_files (headers and end ids left out)."""
    docs = scan_token_files(spark, path).select("first_ids", (F.col("n_ids") - HEADER).alias("n_tokens"))
    return map_arrow(docs, _named, "doc_id long, n_tokens long")


def op2_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    return count_tokens(spark, path)
