"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this process that have not been removed.
_LIVE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one gets a folder of its own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/checkpoints/tideline"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tideline/{label}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders; frames read from them can no longer be evaluated."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _LIVE:
            _LIVE.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Remove on leaving what was written to scratch inside. What must stay is appended to the list that this gives."""
    before, kept = set(_LIVE), []
    try:
        yield kept
    finally:
        remove(spark, [p for p in _LIVE if p not in before and p not in kept])
