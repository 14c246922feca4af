"""Structured Streaming forms of the event-time operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(path)


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream over one Parquet table, a file or a folder of files. The path goes in as a pattern, since a plain one must be a folder."""
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under path whose writing was completed."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    return [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote, in this run and earlier ones.

    Each batch overwrites a folder of its own beside the checkpoint, so a repeated batch leaves
    no double rows and nothing is gathered on the driver. In complete mode the last batch is the
    result, in append mode all are together.
    """
    spark, out = stream.sparkSession, f"{checkpoint}-out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch}")

    q = stream.writeStream.queryName(name).outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    epochs = sorted(map(int, _folders(spark, out)))
    kept = epochs[-1:] if mode == "complete" else epochs
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{out}/{e}" for e in kept])


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def latest_state(stream: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """The row of the highest sequence number per key (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_s"), F.max(seq).alias(seq)).select(key, seq, "_s.*")


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, time: str, width: str, slide: str, keys: list[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums of overlapping windows of `width`, one each `slide`."""
    w = F.window(time, width, slide)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def monotonic(stream: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """Rows whose sequence number exceeds all of their key in earlier batches, each number once; others are repeats and go.

    A batch has no order of its own, and a key's rows come in several frames, so no frame of a
    batch is measured by another: all are by the batches before, and repeats by the numbers seen.
    """
    names = [key, seq, *cols]
    schema = stream.select(*names).schema

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = last = state.get[0] if state.exists else -1
        seen: set = set()
        for f in frames:
            f = f[names].sort_values(seq, kind="stable").drop_duplicates(seq)
            f = f[(f[seq] > before) & ~f[seq].isin(seen)]
            if len(f):
                seen.update(f[seq].tolist())
                last = max(last, int(f[seq].max()))
                yield f
        state.update((last,))

    return stream.select(*names).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def live_probability(state: DataFrame, coefficients: dict[str, dict[str, float]]) -> DataFrame:
    """probability from gold difference, objectives and clock, with coefficients by phase.

    Phases: early (< 12 min), middle (< 20), late. Null where an input is missing or the minute
    is outside 1 to 60.
    """
    minute = F.col("clock") / 60
    z = lambda c: sum((F.col(k) * v for k, v in c.items() if k != "intercept"), F.lit(c.get("intercept", 0.0)))
    score = F.when(minute < 12, z(coefficients["early"])).when(minute < 20, z(coefficients["middle"])).otherwise(z(coefficients["late"]))
    needed = {k for c in coefficients.values() for k in c if k != "intercept"}
    ok = minute.between(1, 60)
    for k in sorted(needed):
        ok = ok & F.col(k).isNotNull()
    return state.withColumn("probability", F.when(ok, 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), score))))))


def receipt(stream: DataFrame, raw: str) -> DataFrame:
    """Envelopes with their hash and time of receipt."""
    return stream.withColumn("raw_sha256", F.sha2(raw, 256)).withColumn("received_at", F.current_timestamp())


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version that was completed; null without any."""
    return max((int(n[1:]) for n in _folders(spark, path) if n.startswith("v")), default=None)


def upsert_latest(path: str, key: str, seq: str, kept: int = 3):
    """A foreachBatch sink that keeps the newest row per key: each batch writes the next version.

    The newest completed version is the table, so a crash at any point leaves the old one or the
    new one. The last `kept` versions stay.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = latest_version(spark, path)
        if last is not None and last >= epoch:
            return
        rows = batch if last is None else spark.read.parquet(f"{path}/v{last}").unionByName(batch)
        cols = [c for c in batch.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(key, "_r.*").select(*batch.columns)
        newest.write.mode("overwrite").parquet(f"{path}/v{epoch}")
        jvm = spark.sparkContext._jvm
        for old in sorted(int(n[1:]) for n in _folders(spark, path) if n.startswith("v"))[:-kept]:
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return write
