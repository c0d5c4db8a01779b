"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several consumers read, and read it again: computed once, and lineage ends there.

    The folder is spark.checkpoint.dir's. Where that is unset, a local master (tests) gets one
    under /tmp and a cluster an error, since its machines would each write to their own disk.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(root or '/tmp/checkpoints').rstrip('/')}/attestra-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
