"""Formula trees of game records as column expressions: the tree is read once, rows bring rank, level and stats."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels of a character.
LEVELS = (1, 18)


class UnsupportedFormula(ValueError):
    """The tree has a part that is not known, or lacks a value that it needs."""


@dataclass(frozen=True)
class Formulas:
    """What a tree refers to. rank, level and stats are columns; data_values hold a number per rank, from index 0.

    A rank without a value and a level outside 1 to 18 give null, as do null stats; whatever is
    wrong with the tree itself raises UnsupportedFormula before any row is read.
    """

    rank: Column
    level: Column
    stats: Mapping[int, Column]
    data_values: Mapping[str, Sequence[float]] = field(default_factory=dict)
    calculations: Mapping[str, Mapping] = field(default_factory=dict)
    default_stat: int | None = 6
    seen: frozenset = frozenset()

    def calculation(self, tree: Mapping) -> Column:
        """The value of a calculation: the sum of its parts, or another calculation, times its multiplier."""
        kind = tree.get("__type", "GameCalculation")
        if kind == "GameCalculationModified":
            name = tree.get("mModifiedGameCalculation")
            if name in self.seen or not isinstance(self.calculations.get(name), Mapping):
                raise UnsupportedFormula(f"no calculation to modify: {name}")
            value = replace(self, seen=self.seen | {name}).calculation(self.calculations[name])
        elif kind == "GameCalculation":
            parts = tree.get("mFormulaParts", [])
            if not isinstance(parts, list):
                raise UnsupportedFormula("mFormulaParts is not a list")
            value = self._sum([p for p in parts if isinstance(p, Mapping)])
        else:
            raise UnsupportedFormula(f"calculation {kind}")
        factor = tree.get("mMultiplier")
        if isinstance(factor, Mapping):
            return value * self.part(factor)
        return value if factor is None else value * _number(factor)

    def part(self, tree: Mapping) -> Column:
        """The value of one part."""
        make = _PARTS.get(tree.get("__type"))
        if make is None:
            raise UnsupportedFormula(f"part {tree.get('__type')}")
        return make(self, tree)

    def _sum(self, parts: list[Mapping]) -> Column:
        return reduce(lambda a, b: a + b, map(self.part, parts), F.lit(0.0))

    def _product(self, parts: list[Mapping]) -> Column:
        return reduce(lambda a, b: a * b, map(self.part, parts), F.lit(1.0))

    def _stat(self, tree: Mapping) -> Column:
        code = tree.get("mStat", self.default_stat)
        if code not in self.stats:
            raise UnsupportedFormula(f"stat {code}")
        return self.stats[code].cast("double")

    def _by_rank(self, tree: Mapping) -> Column:
        name = tree.get("mDataValue")
        if name not in self.data_values:
            raise UnsupportedFormula(f"data value {name}")
        values = F.array(*[F.lit(None if v is None else _number(v)).cast("double") for v in self.data_values[name]]).cast("array<double>")
        return F.when(self.rank >= 1, F.get(values, self.rank.cast("int")))

    def _between(self, tree: Mapping) -> Column:
        low, high = LEVELS
        start, end = _number(tree.get("mStartValue")), _number(tree.get("mEndValue"))
        return F.when(self.level.between(low, high), F.lit(start) + F.lit(end - start) * ((self.level - low) / F.lit(float(high - low))))

    def _steps(self, tree: Mapping) -> Column:
        value = F.lit(_number(tree.get("mLevel1Value")))
        for at in tree.get("mBreakpoints", []):
            if not isinstance(at, Mapping) or "mLevel" not in at:
                raise UnsupportedFormula("a breakpoint is not an object with a level")
            value = value + F.when(self.level >= int(at["mLevel"]), _number(at.get("mAdditionalBonusAtThisLevel"))).otherwise(0.0)
        return F.when(self.level.isNotNull(), value)


def _number(v: object) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
        raise UnsupportedFormula(f"not a finite number: {v!r}")
    return float(v)


def _children(tree: Mapping) -> list[Mapping]:
    """mSubparts, or the two named parts of newer records."""
    parts = tree["mSubparts"] if isinstance(tree.get("mSubparts"), list) else [tree.get("mPart1"), tree.get("mPart2")]
    if not all(isinstance(p, Mapping) for p in parts):
        raise UnsupportedFormula("a subpart is missing or not an object")
    return parts


def _named_stat(f: Formulas, tree: Mapping) -> Column:
    if "mStatFormula" in tree:
        raise UnsupportedFormula("mStatFormula")
    return f._stat(tree) * f._by_rank(tree)


#: The names of parts in the records.
_PARTS = {
    "NumberCalculationPart": lambda f, t: F.lit(_number(t.get("mNumber"))),
    "NamedDataValueCalculationPart": Formulas._by_rank,
    "StatByCoefficientCalculationPart": lambda f, t: f._stat(t) * _number(t.get("mCoefficient")),
    "StatByNamedDataValueCalculationPart": _named_stat,
    "ByCharLevelInterpolationCalculationPart": Formulas._between,
    "ByCharLevelBreakpointsCalculationPart": Formulas._steps,
    "SumOfSubPartsCalculationPart": lambda f, t: f._sum(_children(t)),
    "ProductOfSubPartsCalculationPart": lambda f, t: f._product(_children(t)),
}
