"""State and formula queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import Formulas
from .registry import Tables, query
from .state_query import answer_states

TREE = {
    "mFormulaParts": [
        {"__type": "NamedDataValueCalculationPart", "mDataValue": "base"},
        {"__type": "StatByCoefficientCalculationPart", "mCoefficient": 0.1},
        {"__type": "ProductOfSubPartsCalculationPart", "mPart1": {"__type": "NumberCalculationPart", "mNumber": 2}, "mPart2": {"__type": "ByCharLevelInterpolationCalculationPart", "mStartValue": 10, "mEndValue": 95}},
        {"__type": "ByCharLevelBreakpointsCalculationPart", "mLevel1Value": 5, "mBreakpoints": [{"mLevel": 6, "mAdditionalBonusAtThisLevel": 3}, {"mLevel": 11, "mAdditionalBonusAtThisLevel": 4}]},
    ],
    "mMultiplier": {"__type": "SumOfSubPartsCalculationPart", "mSubparts": [{"__type": "NumberCalculationPart", "mNumber": 1}, {"__type": "StatByNamedDataValueCalculationPart", "mStat": 2, "mDataValue": "ratio"}]},
}


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS s, p_size, p_size % 6 AS r, p_size % 20 AS l FROM part) SELECT p_partkey, round(CASE WHEN l BETWEEN 1 AND 18 AND r BETWEEN 1 AND 4 THEN
    (10 * r + 0.1 * s + 2 * (10 + 85 * (l - 1) / 17.0) + 5 + CASE WHEN l >= 6 THEN 3 ELSE 0 END + CASE WHEN l >= 11 THEN 4 ELSE 0 END) * (1 + p_size * r / 100.0) END, 6) AS plain, round(CASE WHEN l BETWEEN 1 AND 18 AND r BETWEEN 1 AND 4 THEN
    (10 * r + 0.1 * s + 2 * (10 + 85 * (l - 1) / 17.0) + 5 + CASE WHEN l >= 6 THEN 3 ELSE 0 END + CASE WHEN l >= 11 THEN 4 ELSE 0 END) * (1 + p_size * r / 100.0) * 0.5 END, 6) AS halved FROM p""")
def formula_tree(t: Tables) -> DataFrame:
    f = Formulas(F.col("p_size") % 6, F.col("p_size") % 20, {6: F.col("p_retailprice"), 2: F.col("p_size")}, {"base": [0, 10, 20, 30, 40], "ratio": [0, 0.01, 0.02, 0.03, 0.04]}, {"damage": TREE})
    half = {"__type": "GameCalculationModified", "mModifiedGameCalculation": "damage", "mMultiplier": 0.5}
    return t.part.select("p_partkey", F.round(f.calculation(TREE), 6).alias("plain"), F.round(f.calculation(half), 6).alias("halved"))


@query("""WITH asked AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'v9' WHEN 'F' THEN 'v7' END AS patch, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS key, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 20 END AS level, o_orderpriority = '1-URGENT' AS slow FROM orders),
    i AS (SELECT l_orderkey AS id, l_partkey AS item, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT id, item, n, CASE p_size % 3 WHEN 0 THEN 'hp' WHEN 1 THEN 'armor' ELSE 'haste' END AS stat, p_retailprice AS amount, p_size % 5 <> 0 AS flat FROM i JOIN part ON item = p_partkey WHERE item % 17 <> 0 UNION ALL SELECT id, item, n, NULL, NULL, NULL FROM i WHERE item % 17 = 0),
    s AS (SELECT id, sum(amount * n) FILTER (WHERE flat AND stat = 'hp') AS hp, sum(amount * n) FILTER (WHERE flat AND stat = 'armor') AS armor, count(*) FILTER (WHERE flat AND stat <> 'haste') AS parts, list(DISTINCT CASE WHEN stat IS NULL THEN 'item:' || item WHEN NOT (flat AND stat <> 'haste') THEN 'rule:' || item || ':' || stat END) AS blocked FROM p GROUP BY id),
    r AS (SELECT a.*, c_acctbal, s.hp AS add_hp, s.armor AS add_armor, coalesce(parts, 0) AS parts, list_sort(list_filter(list_append(coalesce(blocked, []), CASE WHEN slow THEN 'effect:slow' END), lambda x: x IS NOT NULL)) AS b,
    CASE WHEN patch = 'v9' THEN 'invalid_scenario:patch' WHEN key IS NULL THEN 'needs_input:name' WHEN level IS NULL THEN 'needs_input:level' WHEN level NOT BETWEEN 1 AND 18 THEN 'invalid_scenario:level' WHEN key % 7 = 0 THEN 'unsupported:no fact' END AS wrong FROM asked a LEFT JOIN customer ON c_custkey = key LEFT JOIN s USING (id))
    SELECT id AS state_id, CASE WHEN wrong IS NOT NULL THEN split_part(wrong, ':', 1) WHEN len(b) > 0 THEN 'partial' ELSE 'answered' END AS status, CASE WHEN wrong IS NOT NULL THEN split_part(wrong, ':', 2) END AS reason, key, CASE WHEN wrong IS NULL THEN round(c_acctbal + 10 * level + coalesce(add_hp, 0), 4) END AS hp, CASE WHEN wrong IS NULL THEN round(level + coalesce(add_armor, 0), 4) END AS armor,
    CASE WHEN wrong IS NULL THEN parts END AS components, CASE WHEN wrong IS NULL THEN array_to_string(b, ',') END AS blockers FROM r""")
def state_query(t: Tables) -> DataFrame:
    key, c = F.col("o_orderkey"), t.customer
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("state_id")).agg(F.collect_list("l_partkey").alias("items"))
    patch = F.when(F.col("o_orderstatus") == "P", "v9").when(F.col("o_orderstatus") == "F", "v7")
    name = F.when(key % 11 != 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
    effects = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("slow")))
    states = t.orders.select(key.alias("state_id"), patch.alias("patch"), F.lit("SR").alias("mode"), name.alias("name"), F.when(key % 13 != 0, key % 20).alias("level"), effects.alias("effects")).join(held, "state_id", "left")
    identities = c.select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("key"))
    facts = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("key"), "c_acctbal", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(18).cast("long"))).alias("level")).select("key", "level", (F.col("c_acctbal") + 10 * F.col("level")).alias("hp"), F.col("level").alias("armor"))
    size = F.col("p_size")
    items = t.part.where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("item"), F.when(size % 3 == 0, "hp").when(size % 3 == 1, "armor").otherwise("haste").alias("stat"), F.col("p_retailprice").alias("amount"), (size % 5 != 0).alias("flat"))
    got = answer_states(states, identities, facts, items, ["hp", "armor"], "7")
    return got.select("state_id", "status", "reason", "key", F.round("hp", 4).alias("hp"), F.round("armor", 4).alias("armor"), "components", F.array_join("blockers", ",").alias("blockers"))
