"""Choice among calibration families on later series: fits on the earlier ones, the simplest that is not clearly worse."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .metrics import isotonic_calibration
from .windows import global_positions

#: The families from the simplest on, with their number of parameters.
FAMILIES = {"identity": 0, "symmetric_temperature": 1, "symmetrized_platt": 2, "symmetrized_beta": 3, "symmetrized_bounded_isotonic": 0}
ISOTONIC = "symmetrized_bounded_isotonic"
EARLIER = 0.67

_ARRAYS = SimpleNamespace(exp=lambda x: np.exp(np.clip(x, -700, 700)), log=np.log, clip=np.clip)
_COLUMNS = SimpleNamespace(exp=F.exp, log=F.log, clip=lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x)))


@dataclass(frozen=True)
class Calibration:
    """A fitted family: its parameters (intercept, then logarithms of slopes) or, if isotonic, knots and levels."""

    family: str
    parameters: tuple[float, ...] = ()
    knots: tuple[float, ...] = ()
    levels: tuple[float, ...] = ()
    eps: float = 1e-9

    def _closed(self, z, m: SimpleNamespace):
        """The transform of a family with parameters, for arrays or columns alike; g(-z) = 1 - g(z)."""
        q = self.parameters

        def logistic(x):
            return 1.0 / (1.0 + m.exp(-x))

        def base(x):
            if self.family == "symmetrized_platt":
                return logistic(q[0] + math.exp(q[1]) * x)
            p = m.clip(logistic(x), self.eps, 1 - self.eps)
            return logistic(q[0] + math.exp(q[1]) * m.log(p) - math.exp(q[2]) * m.log(1.0 - p))

        if self.family == "identity":
            value = logistic(z)
        elif self.family == "symmetric_temperature":
            value = logistic(math.exp(q[0]) * z)
        else:
            value = (base(z) + 1.0 - base(-z)) / 2.0
        return m.clip(value, self.eps, 1 - self.eps)

    def values(self, z: np.ndarray) -> np.ndarray:
        if self.family != ISOTONIC:
            return self._closed(z, _ARRAYS)
        knots, levels = np.array(self.knots), np.array(self.levels)
        return np.clip((np.interp(z, knots, levels) + 1.0 - np.interp(-z, knots, levels)) / 2.0, self.eps, 1 - self.eps)

    def column(self, logit: Column) -> Column:
        """The calibrated chance of a logit; null stays null. Only the isotonic family leaves the JVM, by batches."""
        z = logit.cast("double")
        if self.family != ISOTONIC:
            return F.when(z.isNotNull(), self._closed(z, _COLUMNS))
        apply = F.pandas_udf(lambda s: pd.Series(np.where(s.isna(), np.nan, self.values(s.fillna(0.0).to_numpy(float)))), "double")
        return F.nanvl(apply(z), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Selection:
    status: str
    chosen: Calibration | None = None
    losses: dict[str, float] = field(default_factory=dict)


class _Cells:
    """Counts and positives per distinct logit, written once; summed on the driver while they are few (counted), else where they are."""

    def __init__(self, rows: DataFrame, local: int):
        self.cells = materialise(rows.groupBy("z").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s")), "calibration")
        self.held = self.cells.orderBy("z").toPandas() if self.cells.count() <= local else None

    def sums(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def of(frame: pd.DataFrame) -> np.ndarray:
            return f(*(frame[c].to_numpy(float) for c in ("z", "n", "s")))

        if self.held is not None:
            return of(self.held)

        def part(frames):
            total = sum(map(of, (x for x in frames if len(x))))
            if not np.isscalar(total):
                yield pd.DataFrame({"k": range(len(total)), "v": total})

        return np.array([r["v"] for r in self.cells.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()])


def _loss(p: np.ndarray, n: np.ndarray, s: np.ndarray) -> float:
    return float(-(s * np.log(p) + (n - s) * np.log1p(-p)).sum())


def fit_family(rows: DataFrame, family: str, eps: float = 1e-9, rounds: int = 60, local_cells: int = 200_000) -> Calibration:
    """The family's fit by likelihood on rows (z logit, y 0 or 1).

    Fisher scoring with halved steps: a round is two sums of a few numbers over distinct logits.
    Directions in which the symmetric start is level (the intercept, unequal slopes) are left.
    Parameters stay within 20, so separable data end there. The isotonic fit pools by ranges.
    """
    if family == ISOTONIC:
        steps = [(r["low"], r["high"], min(1 - eps, max(eps, r["value"]))) for r in isotonic_calibration(rows, "y", "z").orderBy("low").toLocalIterator()]
        knots = [(x, v) for low, high, v in steps for x in dict.fromkeys((low, high))]
        return Calibration(family, (), tuple(k for k, _ in knots), tuple(v for _, v in knots), eps)
    return _fit(_Cells(rows, local_cells), family, eps, rounds)


def _fit(cells: _Cells, family: str, eps: float, rounds: int) -> Calibration:
    size, tries, h = FAMILIES[family], 0.5 ** np.arange(10), 1e-5
    q = np.zeros(size)

    def at(x: np.ndarray) -> Calibration:
        return Calibration(family, tuple(x.tolist()), eps=eps)

    for _ in range(rounds if size else 0):
        now = q.copy()

        def local(z, n, s):
            p = at(now).values(z)
            j = np.stack([(at(now + h * e).values(z) - at(now - h * e).values(z)) / (2 * h) for e in np.eye(size)])
            w = 1.0 / (p * (1.0 - p))
            return np.concatenate([j @ ((n * p - s) * w), ((j * (n * w)) @ j.T).ravel(), [_loss(p, n, s)]])

        got = cells.sums(local)
        hessian = got[size:-1].reshape(size, size)
        step = -np.linalg.pinv(hessian, rcond=1e-8, hermitian=True) @ got[:size]
        ways = np.clip(now + tries[:, None] * step, -20, 20)
        losses = cells.sums(lambda z, n, s: np.array([_loss(at(x).values(z), n, s) for x in ways]))
        best = int(np.argmin(losses))
        if not losses[best] < got[-1] - 1e-12 * max(1.0, abs(got[-1])):
            break
        q = ways[best]
    return at(q)


def select_calibration(df: DataFrame, logit: str, label: str, series: str, order: str, eps: float = 1e-9, local_cells: int = 200_000) -> Selection:
    """The first family whose loss on the later third of series is within 1.96 standard errors of the best, refitted on all rows.

    Series are ordered by their first `order`, then by id; whole series are earlier or later. The
    standard error is that of the families' losses. Rows with a null label, logit, series or order
    do not count. Fewer than 3 series, 4 earlier or 2 later rows give a status and no family.
    """
    rows = df.select(F.col(logit).cast("double").alias("z"), F.col(label).cast("double").alias("y"), F.col(series).alias("g"), F.col(order).alias("at")).dropna()
    placed = global_positions(rows.groupBy("g").agg(F.min("at").alias("first")), ["first", "g"])
    total = placed.count()
    if total < 3:
        return Selection("insufficient_nested_series_support")
    parts = materialise(rows.join(placed.select("g", (F.col("position") < max(1, int(total * EARLIER))).alias("early")), "g").select("z", "y", "early"), "nested")
    sizes = {r["early"]: r["n"] for r in parts.groupBy("early").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sizes.get(True, 0) < 4 or sizes.get(False, 0) < 2:
        return Selection("insufficient_nested_support")
    early, late = parts.where("early"), _Cells(parts.where("not early"), local_cells)
    cells = _Cells(early, local_cells)
    losses = {}
    for family in FAMILIES:
        fitted = fit_family(early, family, eps) if family == ISOTONIC else _fit(cells, family, eps, 60)
        losses[family] = float(late.sums(lambda z, n, s: np.array([_loss(fitted.values(z), n, s)]))[0]) / sizes[False]
    found = np.array(list(losses.values()))
    most = found.min() + 1.96 * found.std(ddof=1) / math.sqrt(len(found))
    return Selection("ok", fit_family(parts, next(f for f, v in losses.items() if v <= most), eps, local_cells=local_cells), losses)
