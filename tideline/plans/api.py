"""Filtered, ordered and bounded pages over player, team and match relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LIMIT, MAX_OFFSET = 20, 10_000
#: Orders that pages accept: column and direction.
ORDERS = {"rating": ("rating", "desc"), "rating_asc": ("rating", "asc"), "games": ("games", "desc"), "wins": ("wins", "desc"), "win_rate": ("win_rate", "desc"), "name": ("name", "asc")}


def any_of(col: str, values: list | None) -> Column:
    """True without values: an optional parameter."""
    return F.lit(True) if values is None else F.col(col).isin(*values)


def in_scope(given: dict[str, str], levels: tuple[str, ...], nulls: bool = True) -> Column:
    """Given levels match; with nulls, levels that are not given must be null."""
    out = F.lit(True)
    for level in levels:
        if level in given:
            out = out & (F.col(level) == given[level])
        elif nulls:
            out = out & F.col(level).isNull()
    return out


def in_scopes(groups: list[list[Column]]) -> Column:
    """Any within a group, all across groups; an empty group does not restrict."""
    out = F.lit(True)
    for group in groups:
        if group:
            one = group[0]
            for c in group[1:]:
                one = one | c
            out = out & one
    return out


def filtered(df: DataFrame, leagues=None, roles=None, teams=None, names=None, search: str | None = None, min_games: int = 0) -> DataFrame:
    out = df.where(any_of("league", leagues) & any_of("role", roles) & any_of("team", teams) & any_of("name", names))
    if min_games > 0:
        out = out.where(F.coalesce("games", F.lit(0)) >= min_games)
    return out.where(F.lower("name").contains(search.strip().lower())) if search else out


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(0, min(offset, MAX_OFFSET))).limit(max(1, min(limit, MAX_LIMIT)))


def ratings(df: DataFrame, order: str = "rating", limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    if order not in ORDERS:
        raise ValueError(f"order {order!r}")
    col, way = ORDERS[order]
    first = F.col(col).desc_nulls_last() if way == "desc" else F.col(col).asc_nulls_last()
    return page(filtered(df, **filters), [first, F.col("name").asc(), F.col("player_id").asc()], limit, offset)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def facets(df: DataFrame, lists: dict[str, str], span: str) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return df.agg(*[join(c).alias(n) for n, c in lists.items()], F.min(span).alias(f"min_{span}"), F.max(span).alias(f"max_{span}"))


def player_profile(players: DataFrame, games: DataFrame, who: Column, recent: int = 10) -> DataFrame:
    """One row: standing overall and in the role, and the newest games.

    Standings count the rows above, so nothing is ranked in full.
    """
    me = players.where(who).limit(1)
    mine = F.broadcast(me.select(F.col("rating").alias("_r"), F.col("role").alias("_role")))
    above = players.crossJoin(mine).where(F.col("rating") > F.col("_r")).agg((F.count(F.lit(1)) + 1).alias("standing"), (F.count_if(F.col("role") == F.col("_role")) + 1).alias("role_standing"))
    last = games.join(F.broadcast(me.select("player_id")), "player_id", "left_semi").orderBy(F.desc("played_at"), "game_id").limit(recent)
    listed = last.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("played_at").cast("timestamp"))).alias("k"), "game_id"))), lambda x: x["game_id"].cast("string")), ",").alias("recent"))
    return me.select("name", "team", "league").crossJoin(above).crossJoin(listed)


def team_profiles(players: DataFrame, roster: int = 5) -> DataFrame:
    """games, wins and the best-rated players per team; only `roster` rows a team are collected."""
    w = Window.partitionBy("team").orderBy(F.desc("rating"), "name")
    best = players.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= roster).groupBy("team").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda x: x["name"]), ",").alias("roster"))
    return players.groupBy("team").agg(F.sum("games").alias("games"), F.sum("wins").alias("wins")).join(best, "team")


def matches(df: DataFrame, leagues=None, years=None, team: str | None = None, start: str | None = None, end: str | None = None, before: tuple[str, int | None] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, then by game_id; times are half-open, `before` is (played_at, game_id) of the last row of the page before.

    A null game_id stands after all games of its time: the page begins strictly before that time.
    """
    out = df.where(any_of("league", leagues) & any_of("year", years))
    if team is not None:
        out = out.where(F.lower("team") == team.strip().lower())
    if start is not None:
        out = out.where(F.col("played_at") >= start)
    if end is not None:
        out = out.where(F.col("played_at") < end)
    if before is not None:
        earlier = F.col("played_at") < before[0]
        out = out.where(earlier if before[1] is None else earlier | ((F.col("played_at") == before[0]) & (F.col("game_id") > before[1])))
    return page(out, [F.desc("played_at"), F.asc("game_id")], limit, offset)


def entities(kinds: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in kinds.items():
        rows = df.select(F.lit(kind).alias("kind"), "name", F.col("ref").cast("string").alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out


def leaderboards(players: DataFrame, min_games: int, top: int) -> DataFrame:
    """(board, place, name, score): best by rating, by win rate from min_games on, and by rating in each role; null scores have no place.

    A board's rows are cut to `top` before they are gathered.
    """
    rated = players.where("rating is not null")
    boards = [
        rated.select(F.lit("rating").alias("board"), "name", F.col("rating").cast("double").alias("score")),
        players.where(F.col("win_rate").isNotNull() & (F.col("games") >= min_games)).select(F.lit("win_rate").alias("board"), "name", F.col("win_rate").alias("score")),
        rated.where("role is not null").select(F.concat(F.lit("rating:"), "role").alias("board"), "name", F.col("rating").cast("double").alias("score")),
    ]
    rows = boards[0].unionByName(boards[1]).unionByName(boards[2])
    w = Window.partitionBy("board").orderBy(F.desc("score"), "name")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("board", "place", "name", "score")


def tier_rows(cells: DataFrame, cell: list[str], value: str, name: str, buckets: str = "ABCD") -> DataFrame:
    """Rows with their place in their cell by value and a bucket by the share of places above."""
    w = Window.partitionBy(*cell)
    ranked = cells.withColumn("place", F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), name))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.least(F.lit(len(buckets)), F.floor((F.col("place") - 1) / F.col("_n") * len(buckets)).cast("int") + 1)
    return ranked.withColumn("bucket", F.substring(F.lit(buckets), at, F.lit(1))).drop("_n")


def tier_options(index: DataFrame, columns: list[str]) -> dict[str, list]:
    """Sorted values that each column can be filtered by."""
    got = index.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()
    return {c: list(got[c]) for c in columns}


def tier_filter(index: DataFrame, wanted: dict[str, list | None], games: str, min_games: int = 1) -> DataFrame:
    """Rows of the wanted values (None: any) with at least min_games; a column that is not there is an error."""
    for c, values in wanted.items():
        if c not in index.columns:
            raise ValueError(f"no column {c!r}")
        index = index.where(any_of(c, values))
    return index.where(F.col(games) >= min_games)
