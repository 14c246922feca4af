"""Scalar expressions: keys, safe casts, ratings, grades, rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing value, compared in lower case.
NULL_TOKENS = ("", "nan", "nat", "none", "<na>")
#: Lower bounds of the letter grades, best first.
GRADES = ((90, "S"), (80, "A"), (70, "B"), (60, "C"), (50, "D"))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_token(x: str | Column) -> Column:
    """Trimmed text, null where it is a null token."""
    t = F.trim(_c(x))
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def safe_number(x: str | Column, kind: str = "double") -> Column:
    return _c(x).try_cast(kind)


def safe_timestamp(x: str | Column) -> Column:
    return F.try_to_timestamp(_c(x))


def nan_to_null(x: str | Column) -> Column:
    """Finite numbers; NaN and infinities are null."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def search_key(x: str | Column) -> Column:
    """Lower case, apostrophes unified, white space collapsed (ASCII path)."""
    t = F.regexp_replace(F.lower(F.trim(_c(x))), "[‘’`]", "'")
    return F.regexp_replace(t, r"\s+", " ")


def entity_key(x: str | Column) -> Column:
    """Lower case, quotes dropped, everything but letters and digits to one space."""
    t = F.regexp_replace(F.lower(_c(x)), "['‘’`\"]", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def slug(x: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unicode_key(x: str | Column, form: str = "NFKD") -> Column:
    """Unicode normalised, accents stripped for NFKD, case folded; vectorised because Spark has no normaliser."""
    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        import unicodedata

        def one(v: str | None) -> str | None:
            if v is None:
                return None
            t = unicodedata.normalize(form, v)
            if form == "NFKD":
                t = "".join(ch for ch in t if not unicodedata.combining(ch))
            return " ".join(t.casefold().split())

        return s.map(one, na_action="ignore")

    return norm(_c(x))


def strip_prefixes(x: str | Column, prefixes: tuple[str, ...], fallback: Column | None = None) -> Column:
    """Text without any run of the prefixes at its start; empty becomes the fallback."""
    pattern = "^(" + "|".join(prefixes) + ")+"
    t = F.regexp_replace(F.trim(_c(x)), pattern, "")
    return F.coalesce(F.when(t != "", t), fallback if fallback is not None else F.lit(None).cast("string"))


def has_token(x: str | Column, token: str) -> Column:
    """The token stands alone, bounded by anything but A-Z and 0-9."""
    return F.upper(_c(x)).rlike(f"(?<![A-Z0-9]){token}(?![A-Z0-9])")


def alias_of(x: str | Column, aliases: dict[str, str]) -> Column:
    """The alias's canonical name, or the text itself."""
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.try_element_at(table, _c(x)), _c(x))


def version_parts(x: str | Column) -> Column:
    """(major, minor) of a text like 16.10; null for other texts."""
    c = _c(x)
    ok = c.rlike(r"^\d+\.\d+$")
    parts = F.split(c, r"\.")
    return F.when(ok, F.struct(parts[0].try_cast("int").alias("major"), parts[1].try_cast("int").alias("minor")))


def natural_key(x: str | Column, width: int = 6) -> Column:
    """Text that sorts by the numbers in it, however long: runs of digits follow their length, in `width` digits.

    Leading zeros do not count; texts that differ in them only are told apart by the text itself,
    which comes last.
    """
    parts = F.regexp_extract_all(_c(x), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    keyed = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), width, "0"), number(p))).otherwise(p))
    return F.concat(F.array_join(keyed, ""), F.lit("\u0000"), _c(x))


def turret_attack(seconds: str | Column, first: int, base: int, step: int, cap: int) -> Column:
    """Attack of a structure at a game clock: a step for each minute begun from `first` on, up to cap; null for a negative clock."""
    t = _c(seconds)
    grown = F.least(F.lit(cap), F.lit(base) + F.lit(step) * (F.floor((t - first) / 60) + 1))
    return F.when(t < 0, None).when(t < first, F.lit(base)).otherwise(grown).cast("long")


def stack_bonus(rule: str, stacks: str | Column, rank: str | Column | None = None) -> Column:
    """What stored stacks add, by rule; null for negative stacks or a rank outside 1 to 5.

    manaflow: mana. siphoning: damage, by rank. soul: power and armor alike. mist: damage; mist_range
    and mist_crit: by milestones of 20. mark_range: range. void_melee and void_ranged: damage of a
    burn of eight ticks, for 1 to 3 stacks.
    """
    n = _c(stacks)
    if rule == "siphoning":
        r = _c(rank)
        return F.when((n >= 0) & r.between(1, 5), 40 + 20 * (r - 1) + n).cast("double")
    burn = F.when(n == 1, 4).when(n == 2, 12).when(n == 3, 16)
    rules = {
        "manaflow": F.least(n, F.lit(10)) * 25,
        "soul": n,
        "mist": n * 0.75,
        "mist_range": F.floor(n / 20) * 20,
        "mist_crit": F.floor(n / 20) * 10,
        "mark_range": F.when(n < 4, 0).otherwise(F.least(F.lit(250), 75 + 25 * F.floor((n - 4) / 3))),
        "void_melee": burn * 8,
        "void_ranged": burn / 2 * 8,
    }
    return F.when(n >= 0, rules[rule]).cast("double")


def expected_score(a: str | Column, b: str | Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (_c(b) - _c(a)) / scale))


def logistic(x: str | Column, limit: float = 40.0) -> Column:
    c = F.greatest(F.lit(-limit), F.least(F.lit(limit), _c(x)))
    return 1 / (1 + F.exp(-c))


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    c = clip(p, eps, 1 - eps)
    return F.log(c / (1 - c))


def clip(x: str | Column, low: float, high: float) -> Column:
    """Null stays null."""
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def wilson_lower(wins: str | Column, n: str | Column, z: float = 1.96) -> Column:
    w, m = _c(wins).cast("double"), _c(n).cast("double")
    p = w / m
    low = (p + z * z / (2 * m) - z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m)
    return F.when(m > 0, low)


def shrunk_rate(total: str | Column, n: str | Column, prior: float, weight: float) -> Column:
    return (_c(total) + prior * weight) / (_c(n) + weight)


def grade(score: str | Column) -> Column:
    c = _c(score)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for least, letter in GRADES:
        out = out.when(c >= least, letter)
    return out.otherwise("F")


def soft_rating(mu: str | Column, sigma: str | Column, floor: float) -> Column:
    return _c(mu) - F.greatest(F.lit(0.0), _c(sigma) - floor)


def json_number(x: str | Column, digits: int) -> Column:
    """Rounded half to even; not finite becomes null."""
    return F.bround(nan_to_null(x), digits)


def no_vig(a: str | Column, b: str | Column) -> Column:
    """Share of side a in the implied probabilities of two decimal odds."""
    pa, pb = 1 / _c(a), 1 / _c(b)
    return pa / (pa + pb)


def poisson_cdf(mean: str | Column, upto: int) -> Column:
    """P(X <= upto): the terms by recurrence, as there is no log-gamma function."""
    m = _c(mean).cast("double")
    start = F.struct(F.exp(-m).alias("term"), F.exp(-m).alias("total"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, upto))) if upto > 0 else F.array().cast("array<int>"),
        start,
        lambda a, k: F.struct((a["term"] * m / k).alias("term"), (a["total"] + a["term"] * m / k).alias("total")),
        lambda a: a["total"],
    )


def negative_binomial_cdf(mean: str | Column, size: str | Column, upto: int) -> Column:
    m, r = _c(mean).cast("double"), _c(size).cast("double")
    p = r / (r + m)
    first = F.pow(p, r)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, upto))) if upto > 0 else F.array().cast("array<int>"),
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, k: F.struct((a["term"] * (r + k - 1) / k * (1 - p)).alias("term"), (a["total"] + a["term"] * (r + k - 1) / k * (1 - p)).alias("total")),
        lambda a: a["total"],
    )


def damage_factor(resist: str | Column) -> Column:
    r = _c(resist)
    return F.when(r >= 0, 100 / (100 + r)).otherwise(2 - 100 / (100 - r))


def jaccard(a: str | Column, b: str | Column) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union > 0, F.size(F.array_intersect(_c(a), _c(b))) / union)


def bhattacharyya(a: str | Column, b: str | Column) -> Column:
    """Sum of sqrt(p q) of two arrays of shares."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: F.sqrt(p * q)), F.lit(0.0), lambda s, x: s + x)


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a naive UTC timestamp, with fractions."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)
