"""Joins: as-of, interval, validity, validated, resolving, windowed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A validated join met a repeated key."""


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def sides_wide(df: DataFrame, key: str, side: str, left: str, right: str) -> DataFrame:
    """One row per key from its two side rows, as one aggregation instead of a self-join; keys without both sides go."""
    cols = [c for c in df.columns if c not in (key, side)]
    pick = [F.first(F.when(F.col(side) == v, F.col(c)), ignorenulls=True).alias(f"{v.lower()}_{c}") for v in (left, right) for c in cols]
    both = [F.max((F.col(side) == v).cast("int")).alias(f"_{k}") for k, v in enumerate((left, right))]
    return df.where(F.col(side).isin(left, right)).groupBy(key).agg(*pick, *both).where("_0 = 1 and _1 = 1").drop("_0", "_1")


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, tolerance: float, take: list[str], order: list[str]) -> DataFrame:
    """Left rows with the columns `take` of the right row of the same key that is nearest in time.

    Times are numbers. Right rows of one key and time are deduplicated (largest `order` stays).
    Of two at the same distance the earlier one wins; beyond tolerance the columns are null.
    Rows meet in slices of one tolerance, so a hot key is spread over its time span and nothing
    is compared pairwise.
    """
    right = right.where(F.col(right_ts).isNotNull())
    once = right.groupBy(*by, right_ts).agg(F.max_by(F.struct(*take), F.struct(*order)).alias("_take"))
    slot = lambda c: F.floor(F.col(c) / F.lit(float(tolerance))).cast("long")
    r = once.select(*by, F.col(right_ts).alias("_t"), "_take", F.explode(F.array(*[slot(right_ts) + k for k in (-1, 0, 1)])).alias("_slot"))
    l = left.select(F.struct("*").alias("_row"), *by, F.col(left_ts).alias("_t"), slot(left_ts).alias("_slot"))  # noqa: E741
    both = l.withColumn("_take", F.lit(None).cast(r.schema["_take"].dataType)).unionByName(r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)))
    found = F.when(F.col("_row").isNull(), F.struct("_t", "_take"))
    w = Window.partitionBy(*by, "_slot").orderBy("_t", F.col("_row").isNotNull())
    back = F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(found, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", back).withColumn("_a", ahead).where("_row is not null")
    db, da = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    pick = F.when((db <= tolerance) & (F.col("_a").isNull() | (db <= da)), F.col("_b")).when(da <= tolerance, F.col("_a"))
    return near.withColumn("_p", pick).select("_row.*", *[F.col(f"_p._take.{c}").alias(c) for c in take], F.col("_p._t").alias("matched_ts"))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], ts: str, take: list[str]) -> DataFrame:
    """Left rows with the latest right values at or before their time."""
    r = right.select(*by, ts, F.struct(*take).alias("_take"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    l = left.select(*by, ts, F.lit(None).cast(r.schema["_take"].dataType).alias("_take"), F.struct("*").alias("_row"))  # noqa: E741
    w = Window.partitionBy(*by).orderBy(ts, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = l.unionByName(r).withColumn("_last", F.last("_take", ignorenulls=True).over(w)).where("_row is not null")
    return held.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def interval_lookup(points: DataFrame, intervals: DataFrame, by: list[str], point: str, start: str, end: str, take: list[str], key: list[str], width: float) -> DataFrame:
    """Points with the one interval of their key that contains them, both ends included.

    Adds `take` and match_count; where none or several intervals match, `take` is null. Both
    sides meet by slices of `width`, so that no key is compared in full. `key` names a point.
    """
    slot = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    iv = intervals.select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*take).alias("_take")).withColumn("_slot", F.explode(F.sequence(slot("_s"), slot("_e"))))
    p = points.withColumn("_slot", slot(point))
    hit = p.select(*key, *by, F.col(point).alias("_p"), "_slot").join(iv, [*by, "_slot"]).where("_p between _s and _e")
    one = hit.groupBy(*key).agg(F.count(F.lit(1)).alias("match_count"), F.first("_take").alias("_take"))
    out = points.join(one, key, "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return out.select(*points.columns, "match_count", *[F.when(F.col("match_count") == 1, F.col(f"_take.{c}")).alias(c) for c in take])


def valid_as_of(df: DataFrame, as_of: Column, start: str, end: str) -> DataFrame:
    """Rows whose validity holds at as_of; a null end is open."""
    return df.where((F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) >= as_of)))


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str, validate: str) -> DataFrame:
    """Join with pandas-like validation ("one_to_one", "many_to_one") and a _merge column."""
    sides = [("right", right)] + ([("left", left)] if validate == "one_to_one" else [])
    for name, side in sides:
        if side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise DuplicateKeys(f"{validate} join: the {name} side repeats a key of {on}")
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), on, how)
    flag = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return joined.withColumn("_merge", flag).drop("_l", "_r")


def precedence_merge(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, of the first frame that has it; ties inside a frame go by `order`."""
    tagged = [f.withColumn("_rank", F.lit(k)) for k, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_rank", *order)
    return union.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def full_outer(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """All keys of all frames; each frame's other columns keep their names."""
    out = None
    for f in frames.values():
        out = f if out is None else out.join(f, [key], "full")
    return out


def resolve_names(requests: DataFrame, name: str, exact: DataFrame, alias: DataFrame, keyed: DataFrame) -> DataFrame:
    """requests with resolved_id: by exact name, else alias, else search key. Each lookup is (lookup, id), unique by lookup."""
    step = lambda df, k: df.select(F.col("lookup").alias(f"_l{k}"), F.col("id").alias(f"_i{k}"))
    out = requests.join(step(exact, 0), F.col(name) == F.col("_l0"), "left")
    out = out.join(step(alias, 1), F.lower(F.trim(F.col(name))) == F.col("_l1"), "left")
    out = out.join(step(keyed, 2), F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", "") == F.col("_l2"), "left")
    return out.withColumn("resolved_id", F.coalesce("_i0", "_i1", "_i2")).drop("_l0", "_l1", "_l2", "_i0", "_i1", "_i2")


def near_event_flag(df: DataFrame, other: DataFrame, by: list[str], ts: str, key: list[str], within: float, distance: Column | None = None) -> DataFrame:
    """df with `contested`: some row of other with the same key lies within so many seconds (and `distance`, over other's columns prefixed o_)."""
    slot = F.floor(F.col(ts) / F.lit(float(within))).cast("long")
    o = other.select(*by, *[F.col(c).alias(f"o_{c}") for c in other.columns if c not in by], F.explode(F.array(*[slot + k for k in (-1, 0, 1)])).alias("_slot"))
    near = F.abs(F.col(ts) - F.col(f"o_{ts}")) <= within
    hit = df.withColumn("_slot", slot).join(o, [*by, "_slot"]).where(near if distance is None else near & distance)
    flagged = hit.select(*key).distinct().withColumn("contested", F.lit(True))
    return df.join(flagged, key, "left").withColumn("contested", F.coalesce("contested", F.lit(False)))


def opponents(df: DataFrame, game: str, side: str, team: str) -> DataFrame:
    """(game, side, opponent): the other side's team where it is unique."""
    one = df.groupBy(game, side).agg(F.when(F.count_distinct(team) == 1, F.min(team)).alias("_team"))
    teams = one.groupBy(game).agg(F.collect_list(F.struct(side, "_team")).alias("_all"))
    mine = one.join(teams, [game])
    other = F.filter("_all", lambda x: x[side] != F.col(side))
    return mine.select(game, side, F.when(F.size(other) == 1, F.try_element_at(other, F.lit(1))["_team"]).alias("opponent"))


def crosswalk(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, status): distinct pairs; status is conflict where either id has several partners."""
    p = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return p.withColumn("status", F.when((n(left) == 1) & (n(right) == 1), "unique").otherwise("conflict"))


def signature_match(left: DataFrame, right: DataFrame, signature: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): rows of equal signature where it is unique on both sides; a right id stays null elsewhere."""
    one = lambda df, i: df.groupBy(*signature).agg(F.count(F.lit(1)).alias("_n"), F.first(i).alias(i)).where("_n = 1").drop("_n")
    pairs = one(left, left_id).join(one(right, right_id), signature).select(left_id, right_id)
    return left.select(left_id).join(pairs, left_id, "left")


def checkpoint_states(checks: DataFrame, states: DataFrame, by: list[str], ts: str, seq: str, take: list[str], max_age: float) -> DataFrame:
    """Checkpoints with the latest state at or before them; null where it is older than max_age or its sequence number skips one."""
    w = Window.partitionBy(*by).orderBy(ts, seq)
    marked = states.withColumn("_gap", F.coalesce(F.col(seq) - F.lag(seq).over(w) > 1, F.lit(False))).withColumn("state_ts", F.col(ts))
    once = marked.groupBy(*by, ts).agg(F.max_by(F.struct(*take, "_gap", "state_ts"), seq).alias("_s")).select(*by, ts, "_s.*")
    got = asof_backward(checks, once, by, ts, [*take, "_gap", "state_ts"])
    ok = (F.col(ts) - F.col("state_ts") <= max_age) & ~F.col("_gap")
    return got.select(*checks.columns, *[F.when(ok, F.col(c)).alias(c) for c in take])


#: Rows and set values of either side that meet in one group of set_similarities.
GROUP_ROWS, GROUP_VALUES = 1024, 1 << 20


def _jaccard_block(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Jaccard similarities of all rows of left with all of right; 0 for two empty sets. Nulls are no values."""
    rows = [pc.list_parent_indices(side).to_numpy(zero_copy_only=False) for side in (left, right)]
    codes = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode().indices
    known, codes = pc.is_valid(codes).to_numpy(zero_copy_only=False), codes.fill_null(0).to_numpy(zero_copy_only=False)
    cut, width = len(rows[0]), int(codes.max(initial=0)) + 1
    sides = []
    for row, of in ((rows[0], slice(None, cut)), (rows[1], slice(cut, None))):
        cell = np.unique(row[known[of]].astype(np.int64) * width + codes[of][known[of]])
        sides.append((cell // width, cell % width))
    (lr, lc), (rr, rc) = sides
    shared = np.intersect1d(lc, rc)
    both = np.zeros((len(left), len(right)))
    for lo in range(0, len(shared), 4096):
        some = shared[lo : lo + 4096]
        a, b = np.zeros((len(left), len(some))), np.zeros((len(right), len(some)))
        for m, r, c in ((a, lr, lc), (b, rr, rc)):
            at = np.isin(c, some)
            m[r[at], np.searchsorted(some, c[at])] = 1
        both += a @ b.T
    union = np.bincount(lr, minlength=len(left))[:, None] + np.bincount(rr, minlength=len(right))[None, :] - both
    return both / np.maximum(union, 1)


def set_similarities(left: DataFrame, right: DataFrame, id_col: str, set_col: str, near: float | None = None) -> DataFrame:
    """(left_id, right_id, score): Jaccard similarity of every query row of `left` with all rows of `right`.

    Sets are arrays; rows without one have no pairs. Both sides are dealt into groups, and each two
    groups meet in one task as matrices of their values, so every task has the same share of the
    result however often a set occurs. With near, a pair is left out if the same group has another
    one of its right row that is better by more: the best of a right row stays, ties and all.
    """
    from ..storage import materialise

    def sides(df: DataFrame, label: str) -> tuple[DataFrame, int]:
        kept = materialise(df.select(F.col(id_col).alias("id"), F.col(set_col).alias("s")).where("s is not null"), label)
        n, values = kept.agg(F.count(F.lit(1)), F.sum(F.size("s"))).first()
        return kept, max(1, -(-n // GROUP_ROWS), -(-(values or 0) // GROUP_VALUES))

    a, blocks = sides(left, "left_sets")
    b, chunks = sides(right, "right_sets")
    cores = left.sparkSession.sparkContext.defaultParallelism
    chunks = max(chunks, -(-4 * cores // blocks))
    tasks = min(blocks * chunks, max(4 * cores, 2000))

    def score(ls: pa.Table, rs: pa.Table) -> pa.Table:
        lid, rid = ls["id"].combine_chunks(), rs["id"].combine_chunks()
        if len(lid) and len(rid):
            got = _jaccard_block(ls["s"].combine_chunks(), rs["s"].combine_chunks())
            keep = np.ones(got.shape, bool) if near is None else got >= got.max(axis=0) - near
            i, j = np.nonzero(keep)
            scores = got[i, j]
        else:
            i = j = np.zeros(0, np.int64)
            scores = np.zeros(0)
        return pa.table({"left_id": lid.take(pa.array(i)), "right_id": rid.take(pa.array(j)), "score": pa.array(scores, pa.float64())})

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        group = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        return df.select("id", "s", group.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).repartition(tasks, "_block", "_chunk").select("_block", "_chunk", "id", "s")

    kinds = [df.schema[0].dataType.simpleString() for df in (a, b)]
    pairs = dealt(a, "_block", blocks, "_chunk", chunks).groupBy("_block", "_chunk").cogroup(dealt(b, "_chunk", chunks, "_block", blocks).groupBy("_block", "_chunk"))
    return pairs.applyInArrow(score, f"left_id {kinds[0]}, right_id {kinds[1]}, score double")


def nearest_frame(left: DataFrame, frames: DataFrame, by: list[str], ts: str, frame_ts: str, take: list[str]) -> DataFrame:
    """Rows of left with the columns of the nearest frame of their key, at any distance, and that distance.

    Of frames at equal distance the earlier wins, then the least. One sort by key and time gives
    each row the frame before and the frame after; keys without frames get nulls.
    """
    frame = F.struct(F.col(frame_ts).alias("at"), *take)
    f = frames.where(F.col(frame_ts).isNotNull()).groupBy(*by, frame_ts).agg(F.min(frame).alias("_f"))
    marked = left.select(*by, F.col(ts).alias("_t"), F.struct("*").alias("_row"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"))
    both = marked.unionByName(f.select(*by, F.col(frame_ts).alias("_t"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), "_f"))
    w = Window.partitionBy(*by).orderBy("_t", F.col("_row").isNotNull())
    before = F.last("_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_f", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumn("_a", before).withColumn("_b", after).where("_row is not null")
    d = lambda c: F.abs(F.col("_t") - F.col(f"{c}.at"))
    earlier = F.col("_b").isNull() | (F.col("_a").isNotNull() & (d("_a") <= d("_b")))
    chosen = got.withColumn("_c", F.when(earlier, F.col("_a")).otherwise(F.col("_b")))
    return chosen.select("_row.*", *[F.col(f"_c.{c}").alias(c) for c in take], d("_c").alias("distance"))


def time_axis(observed: str, available: str, as_of: str, start: str, most_age: float) -> Column:
    """What a forecast input breaks first of observed <= available <= as_of < start and its age in seconds; ok, or null for a null time."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    known = F.col(observed).isNotNull() & F.col(available).isNotNull() & F.col(as_of).isNotNull() & F.col(start).isNotNull()
    verdict = (
        F.when(F.col(as_of) >= F.col(start), "as_of_not_before_start")
        .when(F.col(observed) > F.col(available), "available_before_observed")
        .when(F.col(available) > F.col(as_of), "not_available_yet")
        .when(seconds(as_of) - seconds(observed) > most_age, "stale")
        .otherwise("ok")
    )
    return F.when(known, verdict)


def viable_candidates(edges: DataFrame, picked: DataFrame, ref: str, candidate: str, score: str, least: float) -> DataFrame:
    """(candidate, ref, score): the best reference of each candidate that is not picked itself, at `least` or more."""
    open_ = edges.join(picked.select(F.col("id").alias(candidate)), candidate, "left_anti").join(picked.select(F.col("id").alias(ref)), ref, "left_semi")
    best = open_.groupBy(candidate).agg(F.max_by(F.struct(ref, score), F.struct(F.col(score), -F.col(ref))).alias("_b"))
    return best.select(candidate, f"_b.{ref}", f"_b.{score}").where(F.col(score) >= least)
