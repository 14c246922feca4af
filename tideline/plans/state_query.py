"""Structured state queries: a table of asked states against identities, facts by level and flat item stats, in one plan.

Small or large tables of states take the same plan; joins are on keys, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The levels that have facts, and the names of the one mode that is composed.
LEVELS = (1, 18)
MODES = ("summoners_rift", "summoner's rift", "sr")


def answer_states(states: DataFrame, identities: DataFrame, facts: DataFrame, items: DataFrame, stats: Sequence[str], patch: str, only_base: Sequence[str] = ()) -> DataFrame:
    """(state_id, status, reason, key, the stats, components, blockers): one row per state.

    states: state_id, patch, mode, name, level, items (ids, repeats counted), effects (names of
    buffs, debuffs and rules). identities: name, key; names match exactly but for case. facts:
    key, level, the stats. items: item, stat, amount, flat.

    Null patch or mode means the present one. What is asked first and wrong first gives status and
    reason; only an answered state has stats: its base (null stats: 0, but for only_base) plus
    the flat amounts of its items. Effects, items that are not known and amounts that are not flat
    are blockers by name, in order, and make the answer partial. A name of several keys is not exact.

    All tables may be large, and Spark takes a frame that explodes its rows for as small as its
    source; merge hints keep every side off the driver.
    """
    exact = identities.where("name is not null").groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.count_distinct("key").alias("_keys"), F.min("key").alias("key")).where("_keys = 1").drop("_keys")
    asked = states.withColumn("_name", F.lower(F.trim("name")))
    base = facts.select(F.col("key"), F.col("level"), F.lit(True).alias("_fact"), *[F.col(s).cast("double").alias(f"_{s}") for s in stats])
    found = asked.join(exact.hint("merge"), "_name", "left").join(base.hint("merge"), ["key", "level"], "left")

    held = states.select("state_id", F.explode("items").alias("item")).groupBy("state_id", "item").agg(F.count(F.lit(1)).alias("_copies"))
    known = held.join(items.hint("merge"), "item", "left")
    usable = F.col("flat") & F.col("stat").isin(*stats)
    sums = [F.sum(F.when(usable & (F.col("stat") == s), F.col("amount") * F.col("_copies"))).alias(f"_add_{s}") for s in stats]
    blocked = F.when(F.col("stat").isNull(), F.concat(F.lit("item:"), F.col("item").cast("string"))).when(~F.coalesce(usable, F.lit(False)), F.concat(F.lit("rule:"), F.col("item").cast("string"), F.lit(":"), F.col("stat")))
    parts = known.groupBy("state_id").agg(*sums, F.count(F.when(usable, 1)).alias("_parts"), F.collect_set(blocked).alias("_blocked"))
    row = found.join(parts.hint("merge"), "state_id", "left")

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    low, high = LEVELS
    wrong = (
        F.when(F.col("patch").isNotNull() & (F.regexp_replace("patch", "^v", "") != patch), verdict("invalid_scenario", "patch"))
        .when(F.col("mode").isNotNull() & ~F.lower("mode").isin(*MODES), verdict("unsupported", "mode"))
        .when(F.coalesce(F.col("_name"), F.lit("")) == "", verdict("needs_input", "name"))
        .when(F.col("key").isNull(), verdict("invalid_scenario", "name"))
        .when(F.col("level").isNull(), verdict("needs_input", "level"))
        .when(~F.col("level").between(low, high), verdict("invalid_scenario", "level"))
        .when(F.col("_fact").isNull(), verdict("unsupported", "no fact"))
    )
    none = F.array().cast("array<string>")
    effects = F.transform(F.coalesce(F.array_compact("effects"), none), lambda e: F.concat(F.lit("effect:"), e))
    row = row.withColumn("_wrong", wrong).withColumn("_blockers", F.array_sort(F.array_distinct(F.concat(effects, F.coalesce("_blocked", none)))))
    ok = F.col("_wrong").isNull()
    status = F.when(~ok, F.col("_wrong.status")).when(F.size("_blockers") > 0, "partial").otherwise("answered")
    value = {s: (F.col(f"_{s}") if s in only_base else F.coalesce(F.col(f"_{s}"), F.lit(0.0))) + F.coalesce(F.col(f"_add_{s}").cast("double"), F.lit(0.0)) for s in stats}
    return row.select("state_id", status.alias("status"), F.col("_wrong.reason").alias("reason"), "key", *[F.when(ok, v).alias(s) for s, v in value.items()], F.when(ok, F.coalesce("_parts", F.lit(0))).alias("components"), F.when(ok, F.col("_blockers")).alias("blockers"))


def describe(tables: dict[str, DataFrame]) -> list[dict]:
    """Schema of the warehouse: a row per column, tables and columns in order; no data is read."""
    return [{"table": name, "column": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for name in sorted(tables) for f in tables[name].schema.fields]
