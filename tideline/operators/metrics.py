"""Evaluation: scores of probabilities, bootstrap, calibration, coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def probability_scores(df: DataFrame, label: str, prob: str) -> DataFrame:
    """One row: n, log_loss, brier; null labels or probabilities do not count."""
    rows = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(prob)))
    y = F.col(label)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"))


def calibration_error(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """Expected calibration error on equal-width bins; empty bins do not count."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins))
    per = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("p"), F.avg(label).alias("y"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Area under the ROC curve, ties one half, from counts per distinct score.

    Scores are counted first; the running sum goes over ranges of scores, so no task holds them all.
    """
    from .windows import sum_before

    per = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy(prob).agg(F.sum((F.col(label) > 0).cast("double")).alias("_p"), F.sum((F.col(label) <= 0).cast("double")).alias("_n"))
    per = sum_before(per, [F.col(prob)], "_n", "_below")
    return per.select((F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_w"), "_p", "_n").agg((F.sum("_w") / (F.sum("_p") * F.sum("_n"))).alias("auc"))


def gaussian_crps(y: Column, mu: Column, sigma: Column) -> Column:
    """CRPS of a normal forecast; vectorised for the error function."""

    @F.pandas_udf("double")
    def crps(a: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        from math import erf

        z = (a - m) / s
        cdf = z.map(lambda v: 0.5 * (1 + erf(v / np.sqrt(2))))
        pdf = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
        return s * (z * (2 * cdf - 1) + 2 * pdf - 1 / np.sqrt(np.pi))

    return crps(y, mu, sigma)


def pinball(y: Column, q: Column, tau: float) -> Column:
    d = y - q
    return F.greatest(tau * d, (tau - 1) * d)


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, weight: str | None = None, draws: int = 2000, seed: int = 123) -> DataFrame:
    """One row: clusters, estimate, low and high of the 95 % interval of the mean (or of sum / sum of weights).

    Clusters are summed first. Each draw gives a cluster a Poisson weight from its hash and the
    draw's number, so draws run where the clusters are and only sums per draw meet.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    sums = df.groupBy(cluster).agg(F.sum(value).cast("double").alias("v"), F.sum(w).cast("double").alias("w"))

    def partial(frames):
        total_v, total_w, n = np.zeros(draws + 1), np.zeros(draws + 1), 0
        for f in frames:
            for k, v, x in zip(f["key"], f["v"], f["w"]):
                times = np.random.default_rng([seed, int(k) & 0xFFFFFFFF, (int(k) >> 32) & 0xFFFFFFFF]).poisson(1.0, draws + 1)
                times[0] = 1
                total_v += times * v
                total_w += times * x
                n += 1
        yield pd.DataFrame({"draw": range(draws + 1), "v": total_v, "w": total_w, "n": n})

    keyed = sums.select(F.xxhash64(cluster).alias("key"), "v", "w")
    per = keyed.mapInPandas(partial, "draw int, v double, w double, n long").groupBy("draw").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    stat = F.when(F.col("w") > 0, F.col("v") / F.col("w"))
    return per.select("draw", "n", stat.alias("s")).agg(
        F.max("n").alias("clusters"),
        F.max(F.when(F.col("draw") == 0, F.col("s"))).alias("estimate"),
        F.percentile(F.when(F.col("draw") > 0, F.col("s")), F.lit(0.025)).alias("low"),
        F.percentile(F.when(F.col("draw") > 0, F.col("s")), F.lit(0.975)).alias("high"),
    )


def ridge_normal_equations(df: DataFrame, features: list[str], target: str, lam: float) -> dict[str, float]:
    """Coefficients of ridge regression with an unpenalised intercept.

    The sums of products are one distributed aggregation; a system of the number of features is
    solved on the driver.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    n = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    aggs += [F.sum(cols[i] * F.col(target).cast("double")).alias(f"b{i}") for i in range(n)]
    ok = df.where(" and ".join(f"{c} is not null" for c in [*features, target]))
    got = ok.agg(*aggs).first()
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    a += np.diag([0.0, *[lam] * len(features)])
    x = np.linalg.lstsq(a, np.array([got[f"b{i}"] or 0.0 for i in range(n)]), rcond=None)[0]
    return dict(zip(["intercept", *features], x.tolist()))


def bradley_terry(matches: DataFrame, a: str, b: str, score: str, weight: str | None = None, lam: float = 1.0, lam_side: float = 0.1, anchor: dict | None = None, rounds: int = 100, local_pairs: int = 200_000) -> DataFrame:
    """(entity, rating): ridge-penalised logistic strengths with a side term, toward the anchor (0 by default).

    Matches are summed to one row per ordered pair, which is written once. The driver holds a few
    numbers per entity. While the pairs, which are counted, are few, their gradients are summed
    there too; beyond local_pairs each gradient is a distributed sum over the written pairs. Both
    take the same steps.
    """
    from ..storage import materialise

    w = F.lit(1.0) if weight is None else F.col(weight)
    known = matches.where(F.col(score).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = materialise(known.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(w).cast("double").alias("n"), F.sum(w * F.col(score)).cast("double").alias("s")), "bt-pairs")
    names = sorted(r[0] for r in pairs.select("a").union(pairs.select("b")).distinct().toLocalIterator())
    at = {k: i for i, k in enumerate(names)}
    size, spark = len(names), matches.sparkSession
    start = np.array([float((anchor or {}).get(k, 0.0)) for k in names])

    def sums(i: np.ndarray, j: np.ndarray, n: np.ndarray, s: np.ndarray, beta: np.ndarray, side: float) -> np.ndarray:
        """Gradient and curvature per entity, then the side's."""
        p = 1 / (1 + np.exp(-np.clip(beta[i] - beta[j] + side, -40, 40)))
        d, c = n * p - s, n * p * (1 - p)
        out = np.zeros((2, len(beta) + 1))
        for k, v in ((0, d), (1, 2 * c)):
            out[k, :-1] = np.bincount(i, v if k else d, len(beta)) + np.bincount(j, v if k else -d, len(beta))
        out[:, -1] = d.sum(), c.sum()
        return out

    if pairs.count() <= local_pairs:
        held = pairs.orderBy("a", "b").toPandas()
        columns = (held["a"].map(at).to_numpy(), held["b"].map(at).to_numpy(), held["n"].to_numpy(), held["s"].to_numpy()) if size else None
        total = lambda beta, side: sums(*columns, beta, side)
    else:
        known_at = spark.sparkContext.broadcast(at)

        def total(beta: np.ndarray, side: float) -> np.ndarray:
            now = spark.sparkContext.broadcast((beta, side))

            def partial(frames):
                got = np.zeros((2, len(now.value[0]) + 1))
                for f in frames:
                    got += sums(f["a"].map(known_at.value).to_numpy(), f["b"].map(known_at.value).to_numpy(), f["n"].to_numpy(), f["s"].to_numpy(), *now.value)
                used = np.flatnonzero(got.any(axis=0))
                yield pd.DataFrame({"k": used, "g": got[0, used], "h": got[1, used]})

            out = np.zeros((2, size + 1))
            for r in pairs.mapInPandas(partial, "k long, g double, h double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toLocalIterator():
                out[:, r["k"]] = r["g"], r["h"]
            now.destroy()
            return out

    beta, side = start.copy(), 0.0
    for _ in range(rounds if size else 0):
        got = total(beta, side)
        step = (got[0, :-1] + lam * (beta - start)) / (got[1, :-1] + lam)
        beta = np.clip(beta - step, start - 8, start + 8)
        move = (got[0, -1] + lam_side * side) / (got[1, -1] + lam_side)
        side -= move
        if max(np.abs(step).max(initial=0.0), abs(move)) < 1e-10:
            break
    return spark.createDataFrame([(k, float(v)) for k, v in zip(names, beta)], f"entity {matches.schema[a].dataType.simpleString()}, rating double")


def coverage_interval(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct((mid - half).alias("low"), (mid + half).alias("high"))


def poisson_race(mu_a: Column, mu_b: Column, target: int) -> Column:
    """Chance that side a reaches the target first, exactly; null where both rates are 0 or one is negative.

    Each event is a's with chance p = mu_a / (mu_a + mu_b), so b has j events before a's last one
    with the terms of a negative binomial, which are summed by recurrence.
    """
    p = F.when((mu_a >= 0) & (mu_b >= 0) & (mu_a + mu_b > 0), mu_a / (mu_a + mu_b))
    first = F.pow(p, F.lit(target))
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(target - 1)) if target > 1 else F.array().cast("array<int>"),
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, j: F.struct((a["term"] * (target - 1 + j) / j * (1 - p)).alias("term"), (a["total"] + a["term"] * (target - 1 + j) / j * (1 - p)).alias("total")),
        lambda a: a["total"],
    )
    return state


def clopper_pearson(hits: Column, n: Column, alpha: float = 0.05, steps: int = 60) -> Column:
    """The exact binomial interval (low, high), by bisection on the beta distribution's defining sums; null for n = 0.

    The tails are summed in logarithms, vectorised, so n is meant for counts of cells, not of rows.
    """

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, m: pd.Series) -> pd.DataFrame:
        from math import lgamma

        def at_least(x: int, size: int, p: float) -> float:
            j = np.arange(x, size + 1)
            ways = np.array([lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) for i in j.tolist()])
            return float(np.exp(ways + j * np.log(p) + (size - j) * np.log1p(-p)).sum())

        def solve(x: int, size: int, tail: float) -> float:
            low, high = 0.0, 1.0
            for _ in range(steps):
                mid = (low + high) / 2
                low, high = (mid, high) if at_least(x, size, mid) < tail else (low, mid)
            return (low + high) / 2

        out = []
        for x, size in zip(k, m):
            if pd.isna(x) or pd.isna(size) or size <= 0:
                out.append((None, None))
                continue
            x, size = int(x), int(size)
            out.append((0.0 if x == 0 else solve(x, size, alpha / 2), 1.0 if x == size else solve(x + 1, size, 1 - alpha / 2)))
        return pd.DataFrame(out, columns=["low", "high"], dtype="float64")

    return interval(hits, n)


def affine_logit_calibration(df: DataFrame, label: str, prob: str, least: int = 200, rounds: int = 40, ridge: float = 1e-2) -> dict:
    """intercept, slope and status of p' = logistic(a + b logit(p)); thin data leave p as it is.

    Each Newton step, of at most 1, is one distributed sum of five numbers; a small ridge
    toward (0, 1) keeps separable data finite.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(prob)))
    rows = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(F.log(p / (1 - p)).alias("x"), F.col(label).cast("double").alias("y"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).first()
    if size["n"] < least or not 0 < size["k"] < size["n"]:
        return {"intercept": 0.0, "slope": 1.0, "status": "thin"}
    a, b = 0.0, 1.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = q * (1 - q)
        g = rows.agg(F.sum(q - F.col("y")), F.sum((q - F.col("y")) * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
        step = np.linalg.solve(np.array([[g[2] + ridge, g[3]], [g[3], g[4] + ridge]]), np.array([g[0] + ridge * a, g[1] + ridge * (b - 1)]))
        step = np.clip(step, -1.0, 1.0)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return {"intercept": a, "slope": b, "status": "fitted"}


def isotonic_calibration(df: DataFrame, label: str, prob: str) -> DataFrame:
    """(low, high, value): the steps of the isotonic fit of label on prob; null labels or scores do not count.

    Equal scores are summed first. Ranges of scores pool their adjacent violators apart, which
    leaves few pools each, and the pools are then pooled in order: the fit does not depend on
    the order of pooling. The driver holds the steps alone.
    """

    def pooled(rows) -> list[list[float]]:
        pools: list[list[float]] = []
        for r in rows:
            pools.append(list(r))
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        return pools

    def part(frames):
        rows = (r for f in frames for r in zip(f["p"], f["p"], f["s"], f["n"]))
        yield pd.DataFrame(pooled(rows), columns=["low", "high", "s", "n"], dtype="float64")

    cells = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy(F.col(prob).cast("double").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(label).cast("double").alias("s"))
    found = cells.repartitionByRange("p").sortWithinPartitions("p").mapInPandas(part, "low double, high double, s double, n double")
    steps = pooled(tuple(r) for r in found.orderBy("low").toLocalIterator())
    return df.sparkSession.createDataFrame([(x[0], x[1], x[2] / x[3]) for x in steps], "low double, high double, value double")
