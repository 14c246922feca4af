"""All registered queries and their SQL."""

from . import queries_aggs, queries_api, queries_joins, queries_models, queries_more, queries_scalar, queries_state, queries_windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
