"""Edge cases of the operators on small frames."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import jsons, scalars, text
from tideline.operators import aggs, cdc, graph, joins, metrics, sequential, windows


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_asof_ties_tolerance_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 100.0), (3, "b", 5.0), (4, "a", 20.0), (5, "a", 58.0)], "id long, k string, t double")
    right = spark.createDataFrame([("a", 8.0, 1), ("a", 12.0, 2), ("a", 12.0, 3), ("a", 38.0, 4), ("c", 5.0, 9)], "k string, rt double, v long")
    got = joins.asof_nearest(left, right, ["k"], "t", "rt", 20.0, ["v"], ["v"])
    assert rows(got, "id", "v") == [(1, 1), (2, None), (3, None), (4, 3), (5, 4)]


def test_interval_bounds_and_ambiguity(spark):
    p = spark.createDataFrame([(1, "a", 0.0), (2, "a", 10.0), (3, "a", 15.0), (4, "a", 40.0), (5, "b", 1.0)], "id long, k string, p double")
    iv = spark.createDataFrame([("a", 0.0, 10.0, "x"), ("a", 10.0, 20.0, "y")], "k string, s double, e double, v string")
    got = joins.interval_lookup(p, iv, ["k"], "p", "s", "e", ["v"], ["id"], 3.0)
    assert rows(got, "id", "match_count", "v") == [(1, 1, "x"), (2, 2, None), (3, 1, "y"), (4, 0, None), (5, 0, None)]


def test_validated_join_raises_on_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    b = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(joins.DuplicateKeys):
        joins.validated_join(b, a, ["k"], "left", "many_to_one")
    assert rows(joins.validated_join(a, b, ["k"], "full", "many_to_one"), "k", "_merge") == [(1, "both"), (1, "both"), (2, "right_only")]


def test_precedence_and_components(spark):
    a = spark.createDataFrame([(1, "p")], "k long, v string")
    b = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "k long, v string, w long")
    assert rows(joins.precedence_merge([a, b], ["k"], ["v"]), "k", "v", "w") == [(1, "p", None), (2, "s", 2)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (300, 300)], "a long, b long")
    for limit in (50_000, 0):
        got = {r["node"]: r["label"] for r in graph.components(chain, local_edges=limit).collect()}
        assert got == {**{k: 0 for k in range(41)}, 7: 0, 100: 100, 101: 100, 300: 300}


def test_mode_ties_and_right_closed_bins(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("z", "q")], "k string, v string")
    assert rows(aggs.most_common(df, ["k"], "v"), "k", "v", "n") == [("k", "a", 1), ("z", "q", 1)]
    v = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 5.5, 9, -1)], "x double")
    assert [r[0] for r in v.select(aggs.right_closed_bin("x", [0, 1, 5, 9])).collect()] == [0, 0, 1, 2, 2, None]
    assert aggs.quantile_edges(spark.createDataFrame([(1.0,)] * 5, "x double"), "x", 4) == [1.0]


def test_mad_falls_back_and_guards(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 9.0)] + [("b", 1.0)] + [("c", 2.0)] * 5, "k string, v double")
    got = {r["k"]: r["scale"] for r in aggs.median_mad(df, ["k"], "v", 3).collect()}
    assert got["b"] is None and got["c"] is None and math.isclose(got["a"], 1.5 / 1.349)


def test_daily_history_excludes_the_same_day(spark):
    df = spark.createDataFrame([(k, "g", d, v) for k, (d, v) in enumerate([(1, 1.0), (1, 3.0), (2, 5.0), (2, None), (3, 4.0)])], "id long, g string, day int, v double")
    got = {r["id"]: (r["prior_n"], r["z"]) for r in windows.daily_history_z(df, ["g"], "day", "v", 2).collect()}
    assert got[0] == (0, None) and got[1] == (0, None) and got[2] == (2, 3.0) and got[3] == (2, None) and got[4][0] == 3


def test_expanding_robust_z_blocks(spark):
    data = [(k, "g", t, float(v)) for k, (t, v) in enumerate([(1, 1), (1, 9), (2, 5), (2, 7), (3, 6)])]
    df = spark.createDataFrame(data, "id long, g string, t long, v double")
    got = {r["id"]: r["z"] for r in windows.expanding_robust_z(df, ["g"], "t", "v", 2, ["id"]).collect()}
    assert got[0] is None and got[1] is None and got[2] == 0 and got[3] is not None


def test_elo_against_a_plain_loop(spark):
    data = [(1, 1, "a", "b", 1.0), (2, 1, "b", "c", 0.0), (3, 2, "a", "c", None), (4, 3, "c", "a", 1.0), (5, 1, "x", "y", 1.0)]
    df = spark.createDataFrame(data, "id long, t long, a string, b string, s double")
    for blocks in (False, True):
        state, pend, last, want = {}, [], None, {}
        for i, t, a, b, s in sorted(data, key=lambda r: (r[1], r[0])):
            if not blocks or t != last:
                for e, d in pend:
                    state[e] = state.get(e, 1500.0) + d
                pend, last = [], t
            ra, rb = state.get(a, 1500.0), state.get(b, 1500.0)
            want[i] = (ra, rb)
            if s is not None:
                d = 24 * (s - 1 / (1 + 10 ** ((rb - ra) / 400)))
                pend += [(a, d), (b, -d)]
        got = {r["id"]: (r["a_before"], r["b_before"]) for r in sequential.elo_before(df, "t", "id", "a", "b", "s", blocks=blocks).collect()}
        assert got.keys() == want.keys() and all(math.isclose(x, y) for i in want for x, y in zip(got[i], want[i]))


def test_availability_is_exclusive(spark):
    f = spark.createDataFrame([(1, "k", 10.0), (2, "k", 20.0), (3, "n", 5.0)], "id long, k string, t double")
    u = spark.createDataFrame([("k", 10.0, 4.0), ("k", 9.0, 2.0)], "k string, av double, v double")
    got = {r["id"]: (r["level"], r["n"]) for r in sequential.availability_fold(f, u, "k", "t", "av", "v").collect()}
    assert got[1] == (2.0, 1) and got[2][1] == 2 and got[3] == (None, 0)


def test_event_state_drops_repeats(spark):
    ev = spark.createDataFrame([("g", 1, 0, "add", "gold", 5.0), ("g", 1, 0, "add", "gold", 5.0), ("g", 2, 1, "x", "gold", 1.0), ("g", 3, 2, "cap", "gold", 3.0)], "k string, event_id long, t long, type string, target string, amount double")
    r = sequential.event_state(ev, "k", ["t", "event_id"], {"add": "add", "cap": "cap"}, {"gold": 0.0}).first()
    assert (r["applied"], r["skipped"], r["gold"]) == (2, 1, 3.0)


def test_changes_apply_and_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, None)], "k long, v string")
    assert rows(cdc.change_status(old, new, "k", ["v"]), "k", "status") == [(1, "unchanged"), (2, "corrected"), (3, "stale"), (4, "new")]
    once = cdc.apply_changes(old, new, "k", ["v"])
    assert rows(once, "k", "v") == rows(new, "k", "v") == rows(cdc.apply_changes(once, new, "k", ["v"]), "k", "v")
    with pytest.raises(cdc.IntegrityError):
        cdc.collapse_identical(spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string"), "k", ["v"])
    with pytest.raises(cdc.IntegrityError):
        cdc.assert_same_keys(old, new, "k")
    shuffled = old.orderBy(F.desc("k")).repartition(3)
    assert cdc.dataset_digest(old, "k", ["v"], 4).first() == cdc.dataset_digest(shuffled, "k", ["v"], 4).first()


def test_gaps_and_sessions(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 2, 5, 9)], "k string, n long")
    assert rows(windows.sequence_gaps(df, ["k"], "n"), "gap_start", "gap_end") == [(3, 4), (6, 8)]
    ev = spark.createDataFrame([(1, "u", 0.0), (2, "u", 10.0), (3, "u", 10.0), (4, "u", 30.0)], "id long, k string, t double")
    assert rows(windows.gap_sessions(ev, ["k"], "t", "id", 15.0), "id", "session") == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_global_positions_are_gapless(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("id"))
    got = windows.global_positions(df, ["id"], 7).collect()
    assert all(r["id"] == r["position"] for r in got) and len(got) == 1000


def test_scalar_edges(spark):
    df = spark.createDataFrame([(" NaN ",), (None,), ("16.10",), ("x",)], "s string")
    got = df.select(scalars.clean_token("s").alias("c"), scalars.version_parts("s").alias("v"), scalars.safe_number("s").alias("n"), scalars.natural_key("s").alias("k")).collect()
    assert [r["c"] for r in got] == [None, None, "16.10", "x"] and got[2]["v"].minor == 10 and got[3]["n"] is None and got[2]["k"].startswith("00000216.00000210")
    ids = ["x9", "x10", "x" + "9" * 25, "x1" + "0" * 25, "x010", "", "7a", "12"]
    keys = {r["s"]: r["k"] for r in spark.createDataFrame([(i,) for i in ids], "s string").select("s", scalars.natural_key("s").alias("k")).collect()}
    assert len(set(keys.values())) == len(ids) and sorted(ids, key=keys.get) == ["", "7a", "12", "x9", "x010", "x10", "x" + "9" * 25, "x1" + "0" * 25]
    one = spark.range(1).select(scalars.json_number(F.lit(2.5), 0).alias("h"), scalars.json_number(F.lit(float("nan")), 2).alias("n"), scalars.wilson_lower(F.lit(0), F.lit(0)).alias("w"), scalars.poisson_cdf(F.lit(2.0), 0).alias("p"), scalars.unicode_key(F.lit("É  Ñandú")).alias("u"), scalars.grade(F.lit(None).cast("double")).alias("g")).first()
    assert (one["h"], one["n"], one["w"], one["u"], one["g"]) == (2.0, None, None, "e nandu", None) and math.isclose(one["p"], math.exp(-2))


def test_json_walkers(spark):
    df = spark.createDataFrame([('{"a":[{"draft":1,"b":2}]}',), ("[1]",), (None,)], "j string")
    got = df.select(jsons.has_key(F.col("j"), ["draft"]).alias("h"), jsons.strip_keys(F.col("j"), ["draft"]).alias("s")).collect()
    assert [r["h"] for r in got] == [True, False, None] and [r["s"] for r in got] == ['{"a":[{"b":2}]}', "[1]", None]


def test_sections_and_markup(spark):
    df = spark.createDataFrame([(1, "lead\n== One ==\nbody\nmore\n=== Two ===\n")], "id long, t string")
    assert rows(text.split_sections(df, "id", "t"), "ordinal", "level", "heading", "start_line", "end_line", "body") == [(0, 1, "", 1, 1, "lead"), (1, 2, "One", 2, 4, "body\nmore"), (2, 3, "Two", 5, 6, "")]
    assert spark.range(1).select(text.clean_markup(F.lit("<!-- x --><script>a<b</script>A <b>c</b> [[l|shown]] {{t}} ''i''"))).first()[0] == "A c shown i"


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, None)], "y int, p double")
    assert metrics.auc(df, "y", "p").first()[0] == 0.75
    r = metrics.probability_scores(df, "y", "p").first()
    assert r["n"] == 3 and math.isclose(r["brier"], (0.01 + 0.81 + 0.01) / 3)
    b = metrics.cluster_bootstrap(spark.createDataFrame([(k % 20, float(k * k % 7)) for k in range(300)], "c long, v double"), "c", "v", draws=400).first()
    assert b["clusters"] == 20 and b["low"] < b["estimate"] < b["high"]
    fit = metrics.ridge_normal_equations(spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(10)], "x double, y double"), ["x"], "y", 0.0)
    assert math.isclose(fit["x"], 2.0, rel_tol=1e-9) and math.isclose(fit["intercept"], 1.0, rel_tol=1e-6)
    bt = {r["entity"]: r["rating"] for r in metrics.bradley_terry(spark.createDataFrame([("a", "b", 1.0)] * 6 + [("b", "a", 0.0)] * 5 + [("b", "c", 1.0)] * 4, "a string, b string, s double"), "a", "b", "s").collect()}
    assert bt["a"] > bt["b"] > bt["c"]


def test_structural_overlap_of_many_segments(spark):
    from types import SimpleNamespace

    from tideline.plans.queries_joins import structural_overlap

    df = spark.createDataFrame([(1, f"s{k}") for k in range(150)], "c_nationkey long, c_mktsegment string")
    assert [tuple(r) for r in structural_overlap(SimpleNamespace(customer=df)).collect()] == [(1, 1.0)]


def test_row_digests_do_not_collide(spark):
    df = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\0", "x"), ("", "x"), ("1:a", ""), ("", "1:a"), ("-", None), (None, "-")], "a string, b string")
    assert df.select(jsons.row_digest("a", "b").alias("d")).distinct().count() == 9
    old = spark.createDataFrame([(1, None), (2, "a\x1fb")], "k long, v string").withColumn("w", F.lit("c"))
    new = spark.createDataFrame([(1, "\0", "c"), (2, "a", "b\x1fc")], "k long, v string, w string")
    assert rows(cdc.change_status(old, new, "k", ["v", "w"]), "k", "status") == [(1, "corrected"), (2, "corrected")]


def test_malformed_json_is_null(spark):
    df = spark.createDataFrame([("{bad",), ("",), ("[" * 100000,), ('{"a":1}',)], "j string")
    got = df.select(jsons.has_key(F.col("j"), ["a"]).alias("h"), jsons.strip_keys(F.col("j"), ["a"]).alias("s")).collect()
    assert [(r["h"], r["s"]) for r in got] == [(None, None)] * 3 + [(True, "{}")]


def test_nearest_frame_ties_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "a", 15.0), (2, "a", 0.0), (3, "a", 99.0), (4, "b", 1.0), (5, "a", 10.0)], "id long, k string, t double")
    frames = spark.createDataFrame([("a", 10.0, 7), ("a", 20.0, 8), ("a", 20.0, 6), ("a", None, 1)], "k string, ft double, v long")
    assert rows(joins.nearest_frame(left, frames, ["k"], "t", "ft", ["v"]), "id", "v", "distance") == [(1, 7, 5.0), (2, 7, 10.0), (3, 6, 79.0), (4, None, None), (5, 7, 0.0)]


def test_set_similarities_cover_all_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"]), (4, ["a", "b"])], "id long, s array<string>")
    got = {(r["left_id"], r["right_id"]): round(r["score"], 4) for r in joins.set_similarities(df.where("id in (1, 3)"), df, "id", "s").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.3333, (1, 3): 0.0, (1, 4): 1.0, (3, 1): 0.0, (3, 2): 0.0, (3, 3): 1.0, (3, 4): 0.0}


def test_sums_before_in_ranges(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("id"), F.lit(2).alias("n"))
    got = windows.sum_before(df, [F.desc("id")], "n", "s", 5).collect()
    assert len(got) == 100 and all(r["s"] == 2 * (99 - r["id"]) for r in got)
    assert windows.sum_before(df.limit(0), [F.col("id")], "n", "s").count() == 0


def test_tier_options_and_filters(spark):
    from tideline.plans import api

    df = spark.createDataFrame([("L", "top", 3.0, "x", 9), ("L", "top", 1.0, "y", 1), ("M", "mid", None, "z", 4), ("L", "top", 3.0, "a", 5)], "league string, role string, v double, name string, games long")
    index = api.tier_rows(df, ["league", "role"], "v", "name")
    assert rows(index, "name", "place", "bucket") == [("a", 1, "A"), ("x", 2, "B"), ("y", 3, "C"), ("z", 1, "A")]
    assert api.tier_options(index, ["league", "role"]) == {"league": ["L", "M"], "role": ["mid", "top"]}
    assert rows(api.tier_filter(index, {"league": ["L"], "role": None}, "games", 5), "name") == [("a",), ("x",)]
    with pytest.raises(ValueError):
        api.tier_filter(index, {"patch": ["1"]}, "games")
