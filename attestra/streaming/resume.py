"""Checkpoint and resume: what an earlier run has finished is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def remaining(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of work whose key is not among those done."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def run_incrementally(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Process new files of a source once each: every batch drops keys that the sink has, and appends what is left.

    A restart goes on from the checkpoint; a batch that was cut off is done again, and its finished keys are skipped.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(key)
        path = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)
        step(remaining(fresh, batch.sparkSession.read.parquet(sink), key) if there else fresh).write.mode("append").parquet(sink)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
