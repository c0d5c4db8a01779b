"""What the operators of this subpackage share: shared-folder tables, Arrow mapping, tokenising."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of Arrow data that a Python worker gets at a time; bounds its memory whatever the texts' length.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound what the JVM sends a Python worker at a time to BATCH_BYTES for this session, if it is more; never raised again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, None) or "")
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `most` bytes or one row."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows < 2:
            yield batch
        else:
            half = batch.num_rows // 2
            for some in (range(half), range(half, batch.num_rows)):  # copies: casts of sliced strings go wrong
                yield from in_pieces(iter([batch.take(pa.array(some, pa.int64()))]), most)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that gives freed memory back to the system, where there is one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder for one operator run, in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local master (tests) gets a folder under
    /tmp and a cluster an error, since its machines would each write to their own disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/attestra-{uuid.uuid4().hex}"


def materialise(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have been written out and are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text (null: empty); other columns, clashing names included, stay behind."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[..., Iterator[pa.RecordBatch]], schema: StructType | str, batch_bytes: int = BATCH_BYTES, **params) -> DataFrame:
    """mapInArrow with keyword parameters for fn(batches, **params), in batches of some bytes."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()(0)  # what an earlier task of this worker has left
        for out in fn(in_pieces(batches, batch_bytes), **params):
            yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8, without decoding (null: empty)."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def crc_mod(doc_id: object, n: int) -> int:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def crc_mod_column(n: int, column: str = "doc_id"):
    """crc_mod as a column."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
