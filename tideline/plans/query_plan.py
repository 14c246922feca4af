"""Structured query plans: validated, compiled to one DataFrame plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import entity_key

OPS = ("eq", "in", "gte", "lte")


class InvalidPlan(ValueError):
    """A plan names a field, operator or bound that is not allowed."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Dataset:
    """Fields that plans may use; text fields compare by normalised key, except exact ones."""

    text: tuple[str, ...]
    number: tuple[str, ...]
    exact: tuple[str, ...] = ("name",)
    tie: str = "name"


@dataclass(frozen=True)
class QueryPlan:
    dataset: str
    filters: tuple[Filter, ...] = ()
    select: tuple[str, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    limit: int = 20
    offset: int = 0
    distance_from: str | None = None  # "median" or "mean"
    distance_field: str | None = None
    search: str | None = None
    search_field: str = "name"
    extra: dict = field(default_factory=dict)


def _condition(ds: Dataset, f: Filter) -> Column:
    if f.op not in OPS:
        raise InvalidPlan(f"operator {f.op!r}")
    if f.field not in ds.text + ds.number:
        raise InvalidPlan(f"field {f.field!r}")
    c = F.col(f.field)
    if f.field in ds.number:
        values = f.value if isinstance(f.value, (list, tuple)) else [f.value]
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            raise InvalidPlan(f"{f.field} takes numbers")
        return {"eq": lambda: c == f.value, "in": lambda: c.isin(*values), "gte": lambda: c >= f.value, "lte": lambda: c <= f.value}[f.op]()
    if f.op in ("gte", "lte"):
        return c >= f.value if f.op == "gte" else c <= f.value
    values = list(f.value) if f.op == "in" else [f.value]
    if f.field in ds.exact:
        return c.isin(*values)
    return entity_key(c).isin(*[re.sub("[^a-z0-9]+", " ", re.sub("['‘’`\"]", "", str(v).lower())).strip() for v in values])


def compile_plan(plan: QueryPlan, datasets: dict[str, Dataset], tables: dict[str, DataFrame]) -> DataFrame:
    """The plan's page. Null never matches a filter; sorts put nulls last and end with the tie field."""
    if plan.dataset not in datasets:
        raise InvalidPlan(f"dataset {plan.dataset!r}")
    ds, df = datasets[plan.dataset], tables[plan.dataset]
    for f in plan.filters:
        df = df.where(_condition(ds, f))
    if plan.search:
        df = df.where(F.lower(F.col(plan.search_field)).contains(plan.search.strip().lower()))
    derived: tuple[str, ...] = ()
    if plan.distance_from:
        if plan.distance_from not in ("median", "mean") or plan.distance_field not in ds.number:
            raise InvalidPlan("distance is from the median or mean of a number field")
        center = (F.median if plan.distance_from == "median" else F.avg)(plan.distance_field)
        df = df.crossJoin(F.broadcast(df.agg(center.alias("_center")))).withColumn("distance", F.abs(F.col(plan.distance_field) - F.col("_center"))).drop("_center")
        derived = ("distance",)
    order = []
    for name, way in plan.sort:
        if name not in ds.text + ds.number + derived or way not in ("asc", "desc"):
            raise InvalidPlan(f"sort by {name!r} {way!r}")
        order.append(F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last())
    for name in plan.select:
        if name not in ds.text + ds.number + derived:
            raise InvalidPlan(f"select of {name!r}")
    page = df.orderBy(*order, F.col(ds.tie).asc()).offset(max(0, min(plan.offset, 10_000))).limit(max(1, min(plan.limit, 20)))
    return page.select(*plan.select) if plan.select else page


#: Words of a question that name a metric, direction or tier.
METRICS = {"rating": "rating", "rated": "rating", "win rate": "win_rate", "winrate": "win_rate", "games": "games", "played": "games"}
LOW_WORDS = ("worst", "lowest", "bottom", "least", "fewest")


def plan_question(question: str, dataset: str, roles: tuple[str, ...] = (), default_metric: str = "rating") -> QueryPlan:
    """A plan from words: metric, direction, limit (1 to 20), minimum games, role."""
    q = " ".join(question.lower().split())
    metric = next((m for w, m in METRICS.items() if w in q), default_metric)
    way = "asc" if any(re.search(rf"\b{w}\b", q) for w in LOW_WORDS) else "desc"
    n = re.search(r"\b(?:top|best|worst|bottom|first)\s+(\d+)\b", q)
    least = re.search(r"\b(?:at least|min(?:imum)?|over)\s+(\d+)\s+games?\b", q)
    filters = [Filter("games", "gte", int(least[1]))] if least else []
    role = next((r for r in roles if re.search(rf"\b{re.escape(r.lower())}\b", q)), None)
    if role:
        filters.append(Filter("role", "eq", role))
    return QueryPlan(dataset, tuple(filters), sort=((metric, way),), limit=max(1, min(20, int(n[1]) if n else 10)))
