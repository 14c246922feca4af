"""Change detection, versions, releases and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import row_digest


class IntegrityError(ValueError):
    """An asserted set or digest does not hold."""


def change_status(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, status): new, corrected, unchanged or stale, by row digests; only digests are shuffled."""
    o = old.select(key, row_digest(*cols).alias("_old"))
    n = new.select(key, row_digest(*cols).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "stale").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("corrected")
    return o.join(n, key, "full").select(key, status.alias("status"))


def apply_changes(old: DataFrame, new: DataFrame, key: str, cols: list[str], drop_stale: bool = True) -> DataFrame:
    """The table after the change: new and corrected rows come from new; stale rows go unless kept."""
    status = change_status(old, new, key, cols)
    changed = status.where("status in ('new', 'corrected')")
    gone = ["corrected"] + (["stale"] if drop_stale else [])
    kept = old.join(status.where(F.col("status").isin(*gone)), key, "left_anti")
    return kept.unionByName(new.join(changed, key, "left_semi"))


def dataset_digest(df: DataFrame, key: str, cols: list[str], buckets: int = 1) -> DataFrame:
    """One row: row_count, byte_count, digest of the sorted key:digest lines. Order-independent.

    With several buckets, lines are digested per hash bucket and then over buckets, so no task
    holds all lines of a large table.
    """
    line = F.concat_ws(":", F.col(key).cast("string"), row_digest(*cols))
    rows = df.select(line.alias("line"), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b"))
    size = F.sum(F.octet_length("line").cast("long"))
    per = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    if buckets == 1:
        return per.select(F.col("n").alias("row_count"), F.col("bytes").alias("byte_count"), F.col("d").alias("digest"))
    return per.agg(F.sum("n").alias("row_count"), F.sum("bytes").alias("byte_count"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def current_versions(history: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest version per key of an append-only history."""
    return history.groupBy(key).agg(F.max_by(F.struct(*[c for c in history.columns if c != key]), F.struct(at, tie)).alias("_v")).select(key, "_v.*")


def collapse_identical(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key; keys with rows that differ raise."""
    per = df.groupBy(key).agg(F.count_distinct(row_digest(*cols)).alias("_d"), *[F.min(c).alias(c) for c in cols])
    bad = per.where("_d > 1").limit(5).collect()
    if bad:
        raise IntegrityError(f"keys with conflicting rows: {[r[key] for r in bad]}")
    return per.drop("_d")


def assert_same_keys(expected: DataFrame, found: DataFrame, key: str) -> None:
    missing = expected.select(key).join(found, key, "left_anti").limit(5).collect()
    extra = found.select(key).join(expected, key, "left_anti").limit(5).collect()
    if missing or extra:
        raise IntegrityError(f"missing {[r[0] for r in missing]}, not expected {[r[0] for r in extra]}")


def retention(releases: DataFrame, keep: int, batch: int = 1) -> DataFrame:
    """Superseded releases to delete now: beyond the `keep` newest, oldest first, at most batch."""
    w = Window.orderBy(F.col("activated_at").desc_nulls_last(), F.col("release_id").desc())
    old = releases.where("status = 'superseded'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep)
    return old.orderBy(F.desc("_n")).limit(batch).drop("_n")
