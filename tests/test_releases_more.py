from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import aggs, joins, metrics, sequential
from tideline.operators.cdc import IntegrityError
from tideline.plans.releases import ReleaseError, Releases, RunLedger, cached_fit


def test_release_states(spark, tmp_path):
    r = Releases(spark, str(tmp_path))
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    for name in ("a", "b", "c"):
        r.stage(name, {"t": (df.withColumn("release", F.lit(name)), "id")})
    with pytest.raises(ReleaseError):
        r.table("t")
    with pytest.raises(ReleaseError):
        r.stage("a", {})
    r.activate("a")
    r.activate("b")
    assert r.status() == {"a": "superseded", "b": "active", "c": "staging"} and r.table("t").first()["release"] == "b"
    r.restore("a")
    assert r.table("t").first()["release"] == "a"
    with pytest.raises(ReleaseError):
        r.restore("c")
    r.discard("c")
    assert r.prune(1) == {"deleted_count": 0, "has_more": False, "paths": []}
    assert r.prune(0)["paths"] == ["b"] and r.status()["b"] == "deleted"
    again = Releases(spark, str(tmp_path))
    assert again.status() == r.status() and len(again._versions()) <= 5
    again.stage("e", {})
    with pytest.raises(ReleaseError):
        r._write({})  # another writer was first
    r.status()
    r.stage("d", {"t": (df, "id")})
    spark.range(3).withColumn("v", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{tmp_path}/data/d/t")
    with pytest.raises(IntegrityError):
        r.activate("d")


def test_ledger_and_cached_fit(spark, tmp_path):
    ledger = RunLedger(["read", "fit"])
    ledger.run("read", lambda: spark.range(3))
    with pytest.raises(ReleaseError):
        ledger.run("read", lambda: None)
    assert ledger.rows[0]["rows"] == 3 and ledger.rows[0]["status"] == "finished"
    slow = F.pandas_udf(lambda s: __import__("time").sleep(0.5) or s, "long")
    assert RunLedger(["x"]).run("x", lambda: spark.range(1).coalesce(1).where(slow("id") >= 0)) is not None
    timed = RunLedger(["x"])
    timed.run("x", lambda: spark.range(1).coalesce(1).where(slow("id") >= 0))
    assert timed.rows[0]["wall_s"] > 0.4
    calls = []

    def fit(df):
        calls.append(1)
        return df.agg(F.sum("id").alias("s"))

    for frame in (spark.range(4), spark.range(4), spark.range(5)):
        out = cached_fit(spark, str(tmp_path), frame, "id", fit)
    assert len(calls) == 2 and out.first()["s"] == 10


def test_shapley_sums_to_the_total(spark):
    df = spark.createDataFrame([("k", m, float(m.bit_count() ** 2)) for m in range(8)], "k string, mask int, v double")
    got = [r["contribution"] for r in aggs.shapley(df, "k", "mask", "v", 3).collect()]
    assert all(math.isclose(x, 3.0) for x in got)


def test_signature_and_checkpoints(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, s string")
    b = spark.createDataFrame([(10, "x"), (11, "y")], "other long, s string")
    assert sorted(map(tuple, joins.signature_match(a, b, ["s"], "id", "other").collect())) == [(1, 10), (2, None), (3, None)]
    states = spark.createDataFrame([("g", 10.0, 1, "a"), ("g", 20.0, 3, "b"), ("g", 40.0, 4, "c")], "g string, t double, seq int, v string")
    checks = spark.createDataFrame([("g", 15.0), ("g", 21.0), ("g", 40.0), ("g", 90.0), ("g", 1.0)], "g string, t double")
    got = {r["t"]: r["v"] for r in joins.checkpoint_states(checks, states, ["g"], "t", "seq", ["v"], 30.0).collect()}
    assert got == {15.0: "a", 21.0: None, 40.0: "c", 90.0: None, 1.0: None}


def test_series_enter_after_their_end(spark):
    data = [(1, "s", 1.0, "L", 10.0), (2, "s", 3.0, "L", 30.0), (3, "t", 2.0, "L", 99.0), (4, "u", 4.0, "L", None)]
    df = spark.createDataFrame(data, "id long, series string, fin double, league string, v double")
    got = {r["id"]: r["prior_league"] for r in sequential.expanding_scope_medians(df, "series", "fin", ["league"], "v", 0.0).collect()}
    assert got == {3: 0.0, 1: 99.0, 2: 99.0, 4: 30.0}


def test_calibrations(spark):
    data = [(1 if (k * 7919) % 100 < 20 + k % 60 else 0, (k % 60 + 20) / 100) for k in range(3000)]
    df = spark.createDataFrame(data, "y int, p double")
    got = metrics.affine_logit_calibration(df, "y", "p")
    assert got["status"] == "fitted" and abs(got["slope"] - 1) < 0.2 and abs(got["intercept"]) < 0.2
    assert metrics.affine_logit_calibration(df.limit(5), "y", "p")["status"] == "thin"
    steps = [r["value"] for r in metrics.isotonic_calibration(df, "y", "p").orderBy("low").collect()]
    assert steps == sorted(steps)


def test_best_sets(spark):
    df = spark.createDataFrame([("k", [("a", 1.0), ("b", 5.0), ("c", 3.0)])], "k string, items array<struct<name:string,score:double>>")
    assert [tuple(r) for r in aggs.best_sets(df, "k", "items", 2, "score", 2).collect()] == [("k", 1, "b|c", 8.0), ("k", 2, "a|b", 6.0)]


def test_best_sets_with_ties_and_short_arrays(spark):
    from itertools import combinations

    items = [(str(k), float(k % 4)) for k in range(13)]
    df = spark.createDataFrame([("k", items), ("s", items[:2])], "k string, items array<struct<name:string,score:double>>")
    want = sorted((-sum(x[1] for x in c), "|".join(sorted(x[0] for x in c))) for c in combinations(items, 3))[:4]
    assert [(r["chosen"], r["total"]) for r in aggs.best_sets(df, "k", "items", 3, "score", 4).collect()] == [(n, -t) for t, n in want]


def test_isotonic_pools_exactly(spark):
    data = [(0, 0.5000), (1, 0.5001), (0, 0.5002), (1, 0.5003), (1, 0.9), (None, 0.1), (1, None)]
    got = [tuple(r) for r in metrics.isotonic_calibration(spark.createDataFrame(data, "y int, p double"), "y", "p").orderBy("low").collect()]
    assert got == [(0.5, 0.5, 0.0), (0.5001, 0.5002, 0.5), (0.5003, 0.9, 1.0)]
    assert metrics.isotonic_calibration(spark.createDataFrame([], "y int, p double"), "y", "p").count() == 0


def test_bradley_terry_paths_agree(spark):
    data = [("a", "b", 1.0), ("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 0.0), ("c", "a", 1.0), ("a", None, 1.0), ("d", "a", None)]
    df = spark.createDataFrame(data, "a string, b string, s double")
    x, y = ({r["entity"]: r["rating"] for r in metrics.bradley_terry(df, "a", "b", "s", anchor={"c": 0.5}, rounds=8, local_pairs=n).collect()} for n in (100, 0))
    assert x.keys() == {"a", "b", "c"} and all(math.isclose(x[k], y[k], abs_tol=1e-9) for k in x)
    z = {r["entity"]: r["rating"] for r in metrics.bradley_terry(df, "a", "b", "s").collect()}
    assert z["a"] > z["b"]


def test_race_and_exact_interval(spark):
    got = spark.range(1).select(metrics.poisson_race(F.lit(1.0), F.lit(1.0), 3).alias("e"), metrics.poisson_race(F.lit(3.0), F.lit(1.0), 1).alias("o"), metrics.poisson_race(F.lit(0.0), F.lit(0.0), 2).alias("n")).first()
    assert math.isclose(got["e"], 0.5) and math.isclose(got["o"], 0.75) and got["n"] is None
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (81, 263), (None, 3), (0, 0)], "k long, n long")
    got = [tuple(r["c"]) for r in df.select(metrics.clopper_pearson(F.col("k"), F.col("n")).alias("c")).collect()]
    want = [(0.0, 0.3085), (0.6915, 1.0), (0.1871, 0.8129), (0.2527, 0.3676)]  # published values
    assert all(math.isclose(x, y, abs_tol=6e-5) for g, w in zip(got, want) for x, y in zip(g, w)) and got[4:] == [(None, None)] * 2


def test_ratings_with_unknown_sides(spark):
    data = [(1, 1.0, "a", "b", 1.0), (2, 2.0, "a", None, 1.0), (3, 3.0, None, None, 1.0), (4, 4.0, "b", "a", None), (5, 5.0, None, "z", 0.0)]
    df = spark.createDataFrame(data, "id long, t double, a string, b string, s double")
    got = {r["id"]: (r["a_before"], r["b_before"]) for r in sequential.elo_before(df, "t", "id", "a", "b", "s").collect()}
    assert got == {1: (1500.0, 1500.0), 2: (1512.0, 1500.0), 3: (1500.0, 1500.0), 4: (1488.0, 1512.0), 5: (1500.0, 1500.0)}
    sides = spark.createDataFrame([(1, 1.0, ["p", "q"], ["r"], 1.0), (2, 2.0, [], ["p"], 1.0), (3, 3.0, None, [], 1.0), (4, 4.0, ["p", None], ["r"], 0.0)], "id long, t double, a array<string>, b array<string>, s double")
    got = {r["id"]: (r["a_before"], r["b_before"]) for r in sequential.lineup_elo(sides, "t", "id", "a", "b", "s").collect()}
    assert got == {1: (1500.0, 1500.0), 2: (1500.0, 1510.0), 3: (1500.0, 1500.0), 4: (1510.0, 1490.0)}


def test_event_state_effects_and_limit(spark):
    rows = [("k", k, k, e, "g", x) for k, (e, x) in enumerate([("add", 5.0), ("floor", 20.0), ("drain", 3.0), ("spend", 100.0), ("spend", 2.0), ("scale", 2.0), ("cap", 25.0), ("add", None)])]
    df = spark.createDataFrame([*rows, ("k", 0, 9, "add", "g", 7.0), ("z", 1, 1, "clear", "g", 0.0)], "key string, event_id long, t long, type string, target string, amount double")
    effects = {e: e for e in ("add", "floor", "drain", "spend", "scale", "cap", "clear")}
    got = {r["key"]: (r["applied"], r["skipped"], r["limit_reached"], r["g"]) for r in sequential.event_state(df, "key", ["t"], effects, {"g": 1.0}).collect()}
    assert got == {"k": (8, 0, False, 25.0), "z": (1, 0, False, 1.0)}
    assert {r["key"]: r["limit_reached"] for r in sequential.event_state(df, "key", ["t"], effects, {"g": 1.0}, most=3).collect()} == {"k": True, "z": False}
