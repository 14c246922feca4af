"""JSON values: guards, stripping, building."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(json: Column, names: list[str]) -> Column:
    """Any object at any depth has one of the keys; null where the text is not JSON. Recursive, so vectorised Python."""
    banned = frozenset(names)

    @F.pandas_udf("boolean")
    def walk(s: pd.Series) -> pd.Series:
        import json as j

        def found(v: object) -> bool:
            if isinstance(v, dict):
                return any(k in banned or found(x) for k, x in v.items())
            return isinstance(v, list) and any(map(found, v))

        def read(t: str) -> bool | None:
            try:
                return found(j.loads(t))
            except (ValueError, RecursionError):
                return None

        return s.map(read, na_action="ignore").astype("boolean")

    return walk(json)


def strip_keys(json: Column, names: list[str]) -> Column:
    """The value without those keys at any depth, in compact form; null where the text is not JSON."""
    banned = frozenset(names)

    @F.pandas_udf("string")
    def walk(s: pd.Series) -> pd.Series:
        import json as j

        def kept(v: object) -> object:
            if isinstance(v, dict):
                return {k: kept(x) for k, x in v.items() if k not in banned}
            return list(map(kept, v)) if isinstance(v, list) else v

        def read(t: str) -> str | None:
            try:
                return j.dumps(kept(j.loads(t)), separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return s.map(read, na_action="ignore")

    return walk(json)


def build(**fields: Column) -> Column:
    """An object of the fields that are not null, keys in order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))


def row_digest(*cols: str) -> Column:
    """SHA-256 of a row's canonical text: each field, in the given order, as its length in bytes, a colon and its text; null is a dash."""
    text = [F.col(c).cast("string") for c in cols]
    return F.sha2(F.concat(F.lit(""), *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def bounded_array(arr: Column, most: int, most_bytes: int) -> Column:
    """At most so many items, each of 1 to most_bytes bytes after trimming."""
    return (F.size(arr) <= most) & F.forall(arr, lambda x: F.octet_length(F.trim(x)).between(1, most_bytes))


def decode_list(json: Column) -> Column:
    """(count, values) of a JSON list, values as text and null for null; null where the text is no list."""
    values = F.from_json(json, "array<string>")
    return F.when(values.isNotNull() & F.ltrim(json).startswith("["), F.struct(F.size(values).cast("long").alias("count"), values.alias("values")))


def at_path(json: Column, path: list[str]) -> Column:
    """The value under nested keys as text; null where a key is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{k}']" for k in path))


def merged(*maps: Column) -> Column:
    """One map of all entries; of equal keys the last map's value stays. Null maps count as empty."""
    out = None
    for m in maps:
        out = m if out is None else F.coalesce(F.map_concat(_without(out, m), m), out, m)
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(other), k))
