from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.formulas import Formulas, UnsupportedFormula
from tideline.operators import calibration, sequential
from tideline.plans.state_query import answer_states, describe


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    z = np.round(rng.normal(0, 2, 600), 2)
    y = (rng.random(600) < 1 / (1 + np.exp(-0.4 * z))).astype(int)
    frame = pd.DataFrame({"z": z, "y": y, "g": [f"s{i // 6:03d}" for i in range(600)], "at": range(600)})
    return frame, spark.createDataFrame(frame)


def _nll(p, y):
    return -(y * np.log(p) + (1 - y) * np.log1p(-p)).sum()


def test_families_against_a_search(spark, scored):
    frame, df = scored
    z, y = frame["z"].to_numpy(), frame["y"].to_numpy()
    slopes = np.linspace(0.05, 2, 4000)
    best = slopes[np.argmin([_nll(1 / (1 + np.exp(-a * z)), y) for a in slopes])]
    for local in (10**6, 0):
        fitted = calibration.fit_family(df, "symmetric_temperature", local_cells=local)
        assert math.exp(fitted.parameters[0]) == pytest.approx(best, abs=1e-3)
    for family in ("symmetrized_platt", "symmetrized_beta"):
        other = calibration.fit_family(df, family)
        assert _nll(other.values(z), y) <= _nll(fitted.values(z), y) + 1e-6
        assert np.allclose(other.values(z) + other.values(-z), 1)
    iso = calibration.fit_family(df, calibration.ISOTONIC)
    cells = frame.groupby("z")["y"].agg(["sum", "count"])
    means = [max(min(cells["sum"].iloc[i : j + 1].sum() / cells["count"].iloc[i : j + 1].sum() for j in range(k, len(cells))) for i in range(k + 1)) for k in range(0, len(cells), 40)]
    assert np.allclose(np.interp(cells.index[::40], iso.knots, iso.levels), np.clip(means, 1e-9, 1 - 1e-9))


def test_selection(spark, scored):
    frame, df = scored
    got = calibration.select_calibration(df, "z", "y", "g", "at")
    late = frame[frame["g"] >= "s067"]
    assert got.status == "ok" and list(got.losses) == list(calibration.FAMILIES)
    assert got.losses["identity"] == pytest.approx(_nll(1 / (1 + np.exp(-late["z"])), late["y"]) / len(late), rel=1e-9)
    v = np.array(list(got.losses.values()))
    limit = v.min() + 1.96 * v.std(ddof=1) / math.sqrt(5)
    assert got.chosen.family == next(f for f, x in got.losses.items() if x <= limit)
    for c in (got.chosen, calibration.fit_family(df, calibration.ISOTONIC), calibration.fit_family(df, "symmetrized_beta")):
        rows = df.select("z", c.column(F.col("z")).alias("p")).toPandas()
        assert np.allclose(rows["p"], c.values(rows["z"].to_numpy()))
        assert spark.sql("select cast(null as double) as z").select(c.column(F.col("z")).alias("p")).first()["p"] is None
    few = df.where("false")
    assert calibration.select_calibration(few, "z", "y", "g", "at").status == "insufficient_nested_series_support"
    assert calibration.select_calibration(df.where("at in (0, 6, 12)"), "z", "y", "g", "at").status == "insufficient_nested_support"


def test_formula_trees(spark):
    df = spark.createDataFrame([(1, 1, 50.0), (2, 18, None), (9, 5, 1.0), (None, 5, 1.0), (0, 19, 2.0)], "r int, l int, s double")
    f = Formulas(F.col("r"), F.col("l"), {6: F.col("s")}, {"v": [0, 10, 20]}, {"a": {"__type": "GameCalculationModified", "mModifiedGameCalculation": "a"}})
    number = {"__type": "NumberCalculationPart", "mNumber": 3}

    def values(tree):
        return [r[0] for r in df.select(f.part(tree)).collect()]

    assert values({"__type": "NamedDataValueCalculationPart", "mDataValue": "v"}) == [10.0, 20.0, None, None, None]
    assert values({"__type": "StatByCoefficientCalculationPart", "mCoefficient": 2}) == [100.0, None, 2.0, 2.0, 4.0]
    assert values({"__type": "ByCharLevelInterpolationCalculationPart", "mStartValue": 1, "mEndValue": 18}) == [1.0, 18.0, 5.0, 5.0, None]
    assert values({"__type": "ProductOfSubPartsCalculationPart", "mSubparts": [number, number]}) == [9.0] * 5
    assert df.select(f.calculation({})).first()[0] == 0.0
    bad = [{"__type": "X"}, {"__type": "NumberCalculationPart", "mNumber": True}, {"__type": "NumberCalculationPart", "mNumber": math.inf}, {"__type": "NamedDataValueCalculationPart", "mDataValue": "w"}, {"__type": "StatByCoefficientCalculationPart", "mStat": 1, "mCoefficient": 1}, {"__type": "SumOfSubPartsCalculationPart", "mPart1": number}]
    for tree in bad:
        with pytest.raises(UnsupportedFormula):
            f.part(tree)
    for tree in ({"__type": "GameCalculationModified", "mModifiedGameCalculation": "b"}, f.calculations["a"], {"mFormulaParts": number}, {"__type": "Y"}):
        with pytest.raises(UnsupportedFormula):
            f.calculation(tree)


def test_states(spark):
    names = spark.createDataFrame([("Ann", 1), ("Bo", 2), ("bo", 3), ("Cy", 4), (None, 5)], "name string, key int")
    facts = spark.createDataFrame([(1, 3, 100.0, None), (4, 1, 1.0, 2.0)], "key int, level int, hp double, ap double")
    items = spark.createDataFrame([("tome", "ap", 20.0, True), ("tome", "hp", 5.0, True), ("orb", "ap", 9.0, False), ("boot", "speed", 1.0, True)], "item string, stat string, amount double, flat boolean")
    ask = [
        (1, None, None, " ANN ", 3, ["tome", "tome"], None), (2, "v2", "SR", "ann", 3, ["orb", "x", "boot"], ["slow", None]), (3, "1", None, "ann", 3, None, None), (4, None, "aram", "ann", 3, None, None), (5, None, None, " ", 3, None, None),
        (6, None, None, "bo", 3, None, None), (7, None, None, "ann", None, None, None), (8, None, None, "ann", 19, None, None), (9, None, None, "ann", 4, None, None), (10, None, None, None, 3, [], []),
    ]
    states = spark.createDataFrame(ask, "state_id int, patch string, mode string, name string, level int, items array<string>, effects array<string>")
    got = {r["state_id"]: r for r in answer_states(states, names, facts, items, ["hp", "ap"], "2").collect()}
    assert (got[1]["status"], got[1]["hp"], got[1]["ap"], got[1]["components"], got[1]["blockers"]) == ("answered", 110.0, 40.0, 2, [])
    assert got[2]["status"] == "partial" and got[2]["ap"] == 0.0 and got[2]["blockers"] == ["effect:slow", "item:x", "rule:boot:speed", "rule:orb:ap"]
    assert [(got[i]["status"], got[i]["reason"]) for i in range(3, 11)] == [("invalid_scenario", "patch"), ("unsupported", "mode"), ("needs_input", "name"), ("invalid_scenario", "name"), ("needs_input", "level"), ("invalid_scenario", "level"), ("unsupported", "no fact"), ("needs_input", "name")]
    assert all(got[i]["hp"] is None and got[i]["blockers"] is None for i in range(3, 11))
    assert answer_states(states.where("false"), names, facts, items, ["hp"], "2").count() == 0
    assert describe({"b": facts, "a": names})[0] == {"table": "a", "column": "name", "type": "string", "nullable": True}


def test_dual_rating(spark):
    day = 86400.0
    rows = [(1, 0.0, "a", "b", 1.0, None, False, "x", "p"), (2, 61 * day, "a", "b", 0.0, 200.0, True, "y", None), (3, None, "a", None, 1.0, 0.0, False, "z", None), (4, 61 * day, "a", "b", None, 0.0, False, "y", "q"), (5, 61 * day, "b", "a", 1.0, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "id int, t double, a string, b string, s double, m double, w boolean, la string, lb string")
    got = {r["id"]: r for r in sequential.dual_rating(df.where("id <> 3"), "t", "id", "a", "b", "s", "m", "w", "la", "lb", sequential.DualElo(momentum_games=1, momentum_scale=10.0)).collect()}
    assert (got[1]["a_mu"], got[1]["a_sigma"], got[1]["p"]) == (1500.0, 80.0, 0.5)
    assert (got[2]["a_base"], got[2]["a_mu"], got[2]["b_mu"]) == (1510.0, 1515.0, 1485.0)
    assert got[2]["a_sigma"] == pytest.approx(80 * 0.98 + 0.8 * 61 / 30 + 15) and got[2]["b_sigma"] == pytest.approx(80 * 0.98 + 0.8 * 61 / 30)
    p, q = 1 / (1 + 10 ** (-30 / 400)), 1 / (1 + 10 ** (-20 / 400))
    assert got[4]["a_base"] == pytest.approx(1510 - 12 * (1 + math.tanh(1)) * p) and got[4]["a_mu"] == pytest.approx(got[4]["a_base"] - 10 * q)
    assert got[4]["b_sigma"] == pytest.approx(got[2]["b_sigma"] * 0.98 + 15)
    assert got[5]["b_sigma"] == pytest.approx(got[4]["a_sigma"]) and got[5]["a_sigma"] == pytest.approx(got[4]["b_sigma"])
    alone = sequential.dual_rating(df.where("id = 3"), "t", "id", "a", "b", "s", "m", "w").first()
    assert alone["a_mu"] == 1500.0 and alone["b_sigma"] == 80.0
