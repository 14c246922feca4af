"""Ordered operators: a row sees only rows strictly before it, and rows of equal time are one block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior_rows(by: list[str], order: list[str], n: int | None = None):
    """The n rows before this one (all, if n is None)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def prior_times(by: list[str], time: str):
    """All rows of strictly smaller time; time is a number."""
    return Window.partitionBy(*by).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)


def daily_history_z(df: DataFrame, by: list[str], day: str, value: str, least: int) -> DataFrame:
    """z of value against all earlier days of its group; null under `least` values or with sd <= 1e-9.

    Days are summed first, so the window runs over one row per group and day.
    """
    v = F.col(value).cast("double")
    daily = df.where(v.isNotNull()).groupBy(*by, day).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    past = daily.select(*by, day, *[F.sum(c).over(w).alias(c) for c in ("_n", "_s", "_q")])
    mean = F.col("_s") / F.col("_n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean))
    ok = (F.col("_n") >= least) & (sd > 1e-9)
    return df.join(past, [*by, day], "left").withColumn("z", F.when(ok, (v - mean) / sd)).withColumn("prior_n", F.coalesce("_n", F.lit(0))).drop("_n", "_s", "_q")


def group_z(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 1e-9, (F.col(value) - F.avg(value).over(w)) / sd)


def trailing_mean(value: str, by: list[str], order: list[str], n: int, default: float | None = None) -> Column:
    """Mean of the non-null values in the n rows before; the default without any."""
    m = F.avg(value).over(prior_rows(by, order, n))
    return m if default is None else F.coalesce(m, F.lit(default))


def changed(value: str, by: list[str], order: list[str]) -> Column:
    """Differs from the last non-null value before; false where there is none."""
    last = F.last(value, ignorenulls=True).over(prior_rows(by, order))
    return F.coalesce(F.col(value) != last, F.lit(False))


def gap_sessions(df: DataFrame, by: list[str], ts: str, id_col: str, gap: float, same: list[Column] = ()) -> DataFrame:
    """session: numbered from 1 per key; a row continues while 0 < gap <= `gap` seconds and all `same` hold (each true if it goes on)."""
    w = Window.partitionBy(*by).orderBy(ts, id_col)
    step = F.col(ts) - F.lag(ts).over(w)
    goes_on = (step > 0) & (step <= gap)
    for s in same:
        goes_on = goes_on & s
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def sequence_gaps(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """(by, gap_start, gap_end): runs of missing numbers between present ones."""
    w = Window.partitionBy(*by).orderBy(seq)
    nxt = df.select(*by, seq).distinct().withColumn("_next", F.lead(seq).over(w))
    return nxt.where(F.col("_next") - F.col(seq) > 1).select(*by, (F.col(seq) + 1).alias("gap_start"), (F.col("_next") - 1).alias("gap_end"))


def lower_tail_mean(df: DataFrame, by: list[str], value: str, weight: str, share: float) -> DataFrame:
    """Weighted mean of the lowest `share` of the weight; ties by value share evenly by order."""
    w = Window.partitionBy(*by).orderBy(value, weight)
    total = F.sum(weight).over(Window.partitionBy(*by))
    before = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    used = F.least(F.col(weight), F.greatest(F.lit(0.0), total * share - before))
    return df.withColumn("_u", used).groupBy(*by).agg((F.sum(F.col("_u") * F.col(value)) / F.sum("_u")).alias("tail_mean"))


def global_positions(df: DataFrame, order: list[str], n_parts: int = 64) -> DataFrame:
    """df with `position` from 0 in a global order, without one task that sorts everything.

    Rows are range-partitioned, counted by partition and numbered inside each; only the counts
    meet. `order` must be total.
    """
    from ..storage import materialise

    ranged = materialise(df.repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_k", inner).join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_k")).drop("_part", "_k", "_start")


def sum_before(df: DataFrame, order: list[Column], value: str, out: str, n_parts: int = 64) -> DataFrame:
    """df with the sum of value over all rows before in a global order, 0 for the first; no task sorts everything.

    Rows are range-partitioned and summed by partition; only those sums meet. `order` must be total.
    """
    from ..storage import materialise

    ranged = materialise(df.repartitionByRange(n_parts, *order).withColumn("_part", F.spark_partition_id()), "sums")
    starts = ranged.groupBy("_part").agg(F.sum(value).alias("_total")).withColumn("_start", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inner", inner).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_inner")).drop("_part", "_inner", "_start")


def time_split(df: DataFrame, order: list[str], cuts: list[tuple[str, float]]) -> DataFrame:
    """split: name of the first cut whose cumulative share lies beyond the row's position."""
    placed = global_positions(df, order)
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    share = F.col("position") / F.col("_total")
    out = F.lit(None).cast("string")
    for name, upto in reversed(cuts):
        out = F.when(share < upto, name).otherwise(out)
    return placed.crossJoin(F.broadcast(n)).withColumn("split", out).drop("_total")


def standing(rating: str, by: list[str]) -> Column:
    """1 + number of strictly greater ratings in the group; null ratings have none."""
    r = F.rank().over(Window.partitionBy(*by).orderBy(F.col(rating).desc_nulls_last()))
    return F.when(F.col(rating).isNotNull(), r)


def expanding_robust_z(df: DataFrame, by: list[str], time: str, value: str, least: int, keep: list[str] = ()) -> DataFrame:
    """z of value against the median and MAD of strictly earlier rows of its group.

    The prior values are kept sorted in a grouped pandas pass, since no window aggregate gives
    expanding medians in less than quadratic space. Rows of equal time see the same past.
    """
    import bisect

    import numpy as np
    import pandas as pd

    schema = df.select(*by, time, value, *keep).withColumn("z", F.lit(None).cast("double")).schema

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[[*by, time, value, *keep]].sort_values(time, kind="stable").reset_index(drop=True)
        past: list[float] = []
        z = np.full(len(rows), np.nan)
        for _, block in rows.groupby(time, sort=True):
            if len(past) >= least:
                a = np.array(past)
                center = np.median(a)
                scale = np.median(np.abs(a - center)) * 1.4826
                if not scale:
                    scale = (np.quantile(a, 0.75) - np.quantile(a, 0.25)) / 1.349
                if scale:
                    z[block.index] = (block[value].to_numpy(float) - center) / scale
            for v in block[value].dropna().tolist():
                bisect.insort(past, v)
        rows["z"] = pd.Series(z).where(~np.isnan(z), None).astype("float64")
        return rows

    return df.groupBy(*by).applyInPandas(scan, schema).withColumn("z", F.nanvl("z", F.lit(None).cast("double")))
