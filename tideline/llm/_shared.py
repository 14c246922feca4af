"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, remove, scratch, scratch_path  # noqa: F401

#: The white space that separates words, as a Java and RE2 pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def bucket_of(*keys: str, buckets: int) -> Column:
    """Hash bucket of a row's keys; nulls hash like values, equal rows share a bucket."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def running_offsets(df: DataFrame, group: str, bucket: str, order: list[Column], size: Column, out: str) -> DataFrame:
    """Add the sum of size over all rows before this one in its group.

    The order is by hash bucket and then by `order`, so a group of any size is numbered in
    pieces of one bucket each; only the bucket totals of a group meet in one task. Group must
    not be null.
    """
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(group, bucket)
        .agg(F.sum(size).alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
        .select(group, bucket, "_start")
    )
    local = df.withColumn("_local", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return local.join(starts, [group, bucket]).withColumn(out, F.col("_start") + F.col("_local")).drop("_start", "_local")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what is made of a batch of texts stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The texts of a string column as bytes."""
    return column.cast(pa.binary()).to_pylist()
