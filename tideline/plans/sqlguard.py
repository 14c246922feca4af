"""Bounded read-only SQL over registered views."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MAX_CHARS = 50_000
DEFAULT_ROWS, MAX_ROWS = 200, 1000
#: Nodes that a read is parsed to; whatever else the parser gives is refused.
READS = frozenset(
    """Aggregate Distinct Except Filter GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias
    Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition""".split()
)
#: Functions of values only: none reads files, settings or classes, or waits.
FUNCTIONS = frozenset(
    """abs any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_sort avg bool_and bool_or
    ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist date date_add date_diff date_format date_sub date_trunc datediff day
    dayofweek dense_rank element_at endswith every exists exp explode filter first first_value floor from_json get_json_object greatest hour if ifnull initcap instr lag last last_value lead
    least left len length ln locate log log10 log2 lower lpad ltrim map max max_by md5 mean median min min_by minute mod month named_struct nth_value ntile nullif nvl percent_rank percentile
    percentile_approx position pow power quarter rank regexp_extract regexp_like regexp_replace replace reverse right round row_number rpad rtrim second sha2 sign size sort_array split
    sqrt startswith stddev stddev_pop stddev_samp string struct substr substring sum to_date to_json to_timestamp transform trim try_cast try_divide upper var_pop var_samp variance year""".split()
)


class RejectedSql(ValueError):
    """The statement is not a bounded read."""


_STRINGS = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)""", re.DOTALL)


def normalised(sql: str) -> str:
    """White space outside string literals collapsed; literals as they are."""
    parts = _STRINGS.split(sql.strip())
    return "".join(p if k % 2 else re.sub(r"\s+", " ", p) for k, p in enumerate(parts))


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _walk(plan, names: set[str]) -> None:
    """Refuse nodes, relations and functions that are not known; names: views, and common table expressions met so far."""
    kind = _kind(plan)
    if kind not in READS:
        raise RejectedSql(f"{kind} is not a read")
    if kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _walk(pair._2(), names)
            names = names | {pair._1().lower()}
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise RejectedSql(f"{'.'.join(parts)} is not a registered relation")
    for e in _items(plan.expressions()):
        _expression(e, names)
    for child in _items(plan.children()):
        _walk(child, names)


def _expression(e, names: set[str]) -> None:
    kind = _kind(e)
    if kind == "UnresolvedFunction":
        parts = _items(e.nameParts())
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise RejectedSql(f"function {'.'.join(parts)} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "UnresolvedScalarSubquery"):
        _walk(e.plan(), names)
    if kind == "InSubquery":
        _walk(e.query().plan(), names)
    for child in _items(e.children()):
        _expression(child, names)


def check(spark: SparkSession, sql: str, views: set[str]) -> str:
    """The statement, if Spark parses it as one read of the views with known functions and it has no comments."""
    text = sql.strip()
    if not text or len(text) > MAX_CHARS:
        raise RejectedSql(f"a statement has 1 to {MAX_CHARS} characters")
    bare = _STRINGS.sub(" ", text)
    if ";" in bare or "--" in bare or "/*" in bare:
        raise RejectedSql("one statement, without comments")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, Py4JJavaError) as e:
        raise RejectedSql("the statement cannot be parsed") from e
    _walk(plan, {v.lower() for v in views})
    return text


@dataclass(frozen=True)
class Result:
    rows: list
    columns: list[str]
    truncated: bool


class SqlSurface:
    """query(sql, max_rows): rows up to the bound and whether there were more.

    Results are cached by the text with white space outside literals collapsed; what runs is the
    text as given. Only the views given here can be read.
    """

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame]):
        self.spark = spark
        self.views = set(views)
        self.cache: dict[tuple[str, int], Result] = {}
        for name, df in views.items():
            df.createOrReplaceTempView(name)

    def _bounded(self, sql: str, n: int) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM (\n{check(self.spark, sql, self.views)}\n) LIMIT {n}")

    def frame(self, sql: str, max_rows: int = DEFAULT_ROWS) -> DataFrame:
        return self._bounded(sql, max(1, min(int(max_rows), MAX_ROWS)))

    def query(self, sql: str, max_rows: int = DEFAULT_ROWS) -> Result:
        n = max(1, min(int(max_rows), MAX_ROWS))
        key = (normalised(sql), n)
        if key not in self.cache:
            df = self._bounded(sql, n + 1)
            got = df.collect()
            self.cache[key] = Result(got[:n], df.columns, len(got) > n)
        return self.cache[key]

    def schema(self) -> dict[str, list[tuple[str, str]]]:
        return {name: [(f.name, f.dataType.simpleString()) for f in self.spark.table(name).schema] for name in sorted(self.views)}

    def status(self) -> dict[str, int]:
        """Numbers of relations, columns and cached answers."""
        return {"relations": len(self.views), "columns": sum(map(len, self.schema().values())), "cached": len(self.cache)}
