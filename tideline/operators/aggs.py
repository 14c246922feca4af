"""Aggregations beyond plain group-by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record(df: DataFrame, keys: list[str], won: Column) -> DataFrame:
    """games, wins, win_rate per key."""
    wins = F.sum(won.cast("long"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), wins.alias("wins"), (wins / F.count(F.lit(1))).alias("win_rate"))


def record_by_grains(df: DataFrame, key: str, grains: list[str], won: Column) -> DataFrame:
    """Grouping sets (key), (key, grain)...: columns key, grain, value, games, wins in one pass."""
    cells = [F.struct(F.lit("total").alias("grain"), F.lit("").alias("value"))]
    cells += [F.struct(F.lit(g).alias("grain"), F.col(g).cast("string").alias("value")) for g in grains]
    sets = df.groupBy(key, *grains).agg(F.count(F.lit(1)).alias("_g"), F.sum(won.cast("long")).alias("_w"))
    return sets.select(key, "_g", "_w", F.explode(F.array(*cells)).alias("_c")).groupBy(key, "_c.grain", "_c.value").agg(F.sum("_g").alias("games"), F.sum("_w").alias("wins"))


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones the least. Nulls do not count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max("n").alias("n_most"))
    return n.join(best, keys).where("n = n_most").groupBy(*keys).agg(F.min(value).alias(value), F.max("n").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sorted_facets(df: DataFrame, col: str, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(col))), sep)


def set_hash(names: Column) -> Column:
    """SHA-256 of the distinct names in order, joined by |."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(names)), "|"), 256)


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value at or beyond rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def median_mad(df: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """n, median, and 1.4826 MAD per key; IQR / 1.349 where the MAD is 0; null where both are or n < least."""
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("center"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("_iqr"))
    dev = df.join(base.select(*keys, "center"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("center"))).alias("_mad"))
    scale = F.when(F.col("n") < least, None).when(F.col("_mad") > 0, F.col("_mad") * 1.4826).when(F.col("_iqr") > 0, F.col("_iqr") / 1.349)
    return base.join(dev, keys).select(*keys, "n", "center", scale.alias("scale"))


def complete_sum(value: str, n: int) -> Column:
    """The sum where exactly n rows are there and all have a value, else null."""
    return F.when((F.count(F.lit(1)) == n) & (F.count(value) == n), F.sum(value))


def single_or_null(value: str) -> Column:
    return F.when(F.count_distinct(value) == 1, F.min(value))


def two_sided(df: DataFrame, home: str, away: str, edge: str, carry: list[str] = ()) -> DataFrame:
    """Each row as two: (team, edge) for home and (team, -edge) for away."""
    rows = F.array(F.struct(F.col(home).alias("team"), F.lit("home").alias("side"), F.col(edge).alias("edge")), F.struct(F.col(away).alias("team"), F.lit("away").alias("side"), (-F.col(edge)).alias("edge")))
    return df.select(*carry, F.explode(rows).alias("_r")).select(*carry, "_r.*")


def quantile_edges(df: DataFrame, value: str, parts: int) -> list[float]:
    """Distinct edges of equal-count bins; a fixed number of values comes to the driver."""
    got = df.select(F.percentile(value, F.lit([k / parts for k in range(parts + 1)])).alias("q")).first()["q"]
    return sorted(set(got or []))


def right_closed_bin(value: str | Column, edges: list[float]) -> Column:
    """Number of the bin (edge k, edge k + 1], the lowest edge included in bin 0; null outside."""
    v = F.col(value) if isinstance(value, str) else value
    steps = [F.when(v <= e, F.lit(k)) for k, e in enumerate(edges[1:])]
    return F.when(v >= edges[0], F.coalesce(*steps)).cast("int")


def moments_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Negative binomial by moments: n, mean, variance, size (null where not over-dispersed: Poisson)."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return base.withColumn("size", F.when(F.col("variance") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("variance") - F.col("mean"))))


def head_to_head(df: DataFrame, a: str, b: str, a_value: str, b_value: str) -> DataFrame:
    """(first, second, games, first_value, second_value): pairs without order, values turned with them."""
    swap = F.col(a) > F.col(b)
    rows = df.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.when(swap, F.col(b_value)).otherwise(F.col(a_value)).alias("x"), F.when(swap, F.col(a_value)).otherwise(F.col(b_value)).alias("y"))
    return rows.groupBy("first", "second").agg(F.count(F.lit(1)).alias("games"), F.sum("x").alias("first_value"), F.sum("y").alias("second_value"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(left, right, n, r): Pearson on the rows that have both, all pairs in one pass."""
    pairs = [(x, y) for k, x in enumerate(cols) for y in cols[k + 1 :]]
    both = lambda x, y, v: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(v).cast("double"))
    aggs = []
    for k, (x, y) in enumerate(pairs):
        aggs += [F.count(both(x, y, x)).alias(f"n{k}"), F.corr(both(x, y, x), both(x, y, y)).alias(f"r{k}")]
    cells = [F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (x, y) in enumerate(pairs)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def partial_correlation(x: str, y: str, z: str) -> Column:
    """Correlation of x and y with the linear part of z taken out of both."""
    xy, xz, yz = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    return (xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null where all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def share_of(value: str, by: list[str], least: float = 1.0) -> Column:
    return F.col(value) / F.greatest(F.lit(least), F.sum(value).over(Window.partitionBy(*by)))


def equal_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """weight: 1 / rows of the group, scaled to mean 1. The mean over all rows is groups / rows, one row to broadcast."""
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    scale = per.agg((F.sum("_n") / F.count(F.lit(1))).alias("_scale"))
    return df.join(per, by).crossJoin(F.broadcast(scale)).withColumn("weight", F.col("_scale") / F.col("_n")).drop("_n", "_scale")


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def shapley(df: DataFrame, key: str, mask: str, value: str, players: int) -> DataFrame:
    """(key, player, contribution) from the value of every coalition bitmask, in one pass.

    A coalition of size s counts for its members with (s-1)!(n-s)!/n! and against the others
    with s!(n-s-1)!/n!.
    """
    from math import factorial

    n = players
    size = F.bit_count(F.col(mask))
    member = F.array(*[F.lit(factorial(s - 1) * factorial(n - s) / factorial(n) if s else 0.0) for s in range(n + 1)])
    other = F.array(*[F.lit(factorial(s) * factorial(n - s - 1) / factorial(n) if s < n else 0.0) for s in range(n + 1)])
    rows = df.select(key, F.col(mask).alias("_m"), F.col(value).alias("_v"), size.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("player"))
    inside = F.expr("(_m >> player) & 1") == 1
    part = F.when(inside, F.element_at(member, F.col("_s") + 1) * F.col("_v")).otherwise(-F.element_at(other, F.col("_s") + 1) * F.col("_v"))
    return rows.groupBy(key, "player").agg(F.sum(part).alias("contribution"))


def observed_composite(weights: dict[str, float], limit: float = 3.0) -> Column:
    """Weighted mean of clipped scores over those that are not null; null without any."""
    total = sum((F.when(F.col(c).isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(c))) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def best_sets(df: DataFrame, key: str, items: str, slots: int, score: str, top: int = 3) -> DataFrame:
    """(key, place, chosen, total): the best-scored sets of `slots` items of each row's array of (name, score, cost-free) structs.

    Scores add up, so the best `top` sets have only items that fewer than slots + top - 1 others
    of the array exceed; the search is exhaustive over those and runs where the rows are. Equal
    totals go by the names, joined in order.
    """
    from itertools import combinations

    import pandas as pd

    kind = df.schema[key].dataType.simpleString()

    def search(frames):
        for f in frames:
            out = []
            for k, arr in zip(f[key], f[items]):
                if len(arr) < slots:
                    continue
                least = sorted((x[score] for x in arr), reverse=True)[min(len(arr), slots + top - 1) - 1]
                used = [x for x in arr if x[score] >= least]
                found = sorted(((-round(sum(x[score] for x in c), 6), "|".join(sorted(x["name"] for x in c))) for c in combinations(used, slots)))[:top]
                out += [(k, p + 1, names, -total) for p, (total, names) in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "place", "chosen", "total"])

    return df.select(key, items).mapInPandas(search, f"{key} {kind}, place int, chosen string, total double")
