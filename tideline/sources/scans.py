"""Sources: validated CSV, JSON, event logs, projected Parquet; and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.scalars import clean_token


class InvalidSource(ValueError):
    """A source lacks what its contract asks for."""


@dataclass(frozen=True)
class CsvProfile:
    rows: int
    games: int
    leagues: int
    first_date: str | None
    last_date: str | None
    bad_dates: int
    other_years: int
    columns: tuple[str, ...] = field(default_factory=tuple)


def read_csv(spark: SparkSession, path: str, text: tuple[str, ...] = ("date", "patch")) -> DataFrame:
    """CSV with every column as text (so 16.10 stays 16.10); header names trimmed, repeats dropped."""
    raw = spark.read.option("header", "false").csv(path)
    head = raw.limit(1).collect()
    if not head:
        raise InvalidSource(f"{path} is empty")
    names, keep, seen = [str(v or "").strip() for v in head[0]], [], set()
    for k, n in enumerate(names):
        if n and n not in seen:
            seen.add(n)
            keep.append((k, n))
    body = spark.read.option("header", "true").schema(StructType.fromDDL(", ".join(f"`_c{k}` string" for k in range(len(names))))).option("enforceSchema", "true").csv(path)
    return body.select(*[F.col(f"_c{k}").alias(n) for k, n in keep])


def profile_csv(df: DataFrame, year: int, required: tuple[str, ...], game: str = "gameid", date: str = "date", league: str = "league") -> CsvProfile:
    """One aggregation over the needed columns; raises where the contract fails."""
    if missing := [c for c in required if c not in df.columns]:
        raise InvalidSource(f"columns missing: {missing}")
    t = F.try_to_timestamp(F.col(date))
    got = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(game).alias("games"), F.count_distinct(league).alias("leagues"),
        F.min(t).cast("string").alias("first"), F.max(t).cast("string").alias("last"),
        F.count_if(F.col(date).isNotNull() & t.isNull()).alias("bad"), F.count_if(F.year(t) != year).alias("other"),
    ).first()
    if not got["rows"] or not got["games"]:
        raise InvalidSource("no rows or no games")
    if got["bad"]:
        raise InvalidSource(f"{got['bad']} dates cannot be read")
    if got["other"]:
        raise InvalidSource(f"{got['other']} rows are of another year than {year}")
    return CsvProfile(got["rows"], got["games"], got["leagues"], got["first"], got["last"], got["bad"], got["other"], tuple(df.columns))


def split_team_player(df: DataFrame, source: str, year: int, position: str = "position") -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumns({"source": F.lit(source), "oe_year": F.lit(year)})
    team = F.lower(F.trim(position)) == "team"
    return tagged.where(team), tagged.where(~F.coalesce(team, F.lit(False)))


def last_wins_union(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Outer-column union with one row per key: the first in `order`."""
    from ..operators.aggs import latest

    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return latest(out, keys, order)


def projected(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Only the wanted columns that are there; pruned in the scan."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns])


def years(df: DataFrame, wanted: list[int], candidates: tuple[str, ...] = ("oe_year", "year")) -> DataFrame:
    col = next(c for c in candidates if c in df.columns)
    return df.where(F.col(col).try_cast("bigint").isin(*wanted))


def two_sides(games: DataFrame, common: list[str], sides: dict[str, dict[str, str]]) -> DataFrame:
    """One game row to a row per side: sides maps the side's name to {output column: source column}."""
    rows = F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(src).alias(out) for out, src in cols.items()]) for s, cols in sides.items()])
    return games.select(*common, F.explode(rows).alias("_s")).select(*common, "_s.*")


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines; lines that cannot be parsed are kept in _corrupt and dropped from the result."""
    full = StructType([*schema.fields]).add("_corrupt", "string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def games_from_events(events: DataFrame, game: str, seq: str, kind: str, team: str, payload: str) -> DataFrame:
    """One row per game: first start and end payloads and kills per team, folded by aggregation."""
    is_ = lambda v: F.col(kind) == v
    return events.groupBy(game).agg(
        F.min_by(F.when(is_("game_info"), F.col(payload)), F.when(is_("game_info"), F.col(seq))).alias("start"),
        F.min_by(F.when(is_("game_end"), F.col(payload)), F.when(is_("game_end"), F.col(seq))).alias("end"),
        F.count_if(is_("champion_kill") & (F.col(team) == 100)).alias("kills_100"),
        F.count_if(is_("champion_kill") & (F.col(team) == 200)).alias("kills_200"),
    )


PARTICIPANTS = "array<struct<teamID:int,role:string,summonerName:string,championName:string>>"


def players_from_games(games: DataFrame, game: str, keep: int = 10) -> DataFrame:
    """One row per player of complete games: side, position, name, champion and result.

    games: (game, start, winner) as games_from_events and verified_end give them; start is JSON
    with `participants`. Games without a winner or without exactly `keep` players on the two
    sides have no rows.
    """
    held = games.where(F.col("winner").isin(100, 200)).select(game, "winner", F.filter(F.from_json(F.get_json_object("start", "$.participants"), PARTICIPANTS), lambda p: p["teamID"].isin(100, 200)).alias("_p"))
    rows = held.where(F.size("_p") == keep).select(game, "winner", F.explode("_p").alias("_p"))
    return rows.select(
        game,
        F.when(F.col("_p.teamID") == 100, "Blue").otherwise("Red").alias("side"),
        F.lower("_p.role").alias("position"),
        F.trim("_p.summonerName").alias("player"),
        F.coalesce("_p.championName", F.lit("Unknown")).alias("champion"),
        (F.col("_p.teamID") == F.col("winner")).cast("int").alias("result"),
    )


def verified_end(games: DataFrame, summary: DataFrame, game: str) -> DataFrame:
    """games with `winner`: from the end event, else from a summary that agrees with the events in every count."""
    s = summary.select(game, F.struct("*").alias("_s"))
    ok = (F.col("_s.status") == "complete") & (F.col("_s.duration") > 0) & (F.col("_s.kills_100") == F.col("kills_100")) & (F.col("_s.kills_200") == F.col("kills_200")) & F.col("_s.winner").isin(100, 200)
    return games.join(s, game, "left").withColumn("winner", F.coalesce(F.get_json_object("end", "$.winner").try_cast("int"), F.when(ok, F.col("_s.winner")))).drop("_s")


def clean_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: clean_token(c) for c in cols})


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """One object a line with keys in order; range-partitioned, so files are in order too."""
    cols = sorted(df.columns)
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def stage_rows(existing: DataFrame, rows: DataFrame, key: str, most: int = 500, most_bytes: int = 3_500_000) -> DataFrame:
    """Rows whose key is not there yet; a batch beyond its bounds is refused."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")).alias("b")).first()
    if size["n"] > most or (size["b"] or 0) > most_bytes:
        raise InvalidSource(f"a batch has at most {most} rows and {most_bytes} bytes")
    return rows.join(existing.select(key), key, "left_anti")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class EnvelopeReader(DataSourceStreamReader):
    """Offsets are sequence numbers, so a restarted query resumes after the last one it committed."""

    def __init__(self, path: str):
        self.path = path

    def _lines(self) -> list[dict]:
        with open(self.path) as f:
            return [json.loads(x) for x in f if x.strip()]

    def initialOffset(self) -> dict:
        return {"sequence": -1}

    def latestOffset(self) -> dict:
        return {"sequence": max((x["sequenceNumber"] for x in self._lines()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(self.path, start["sequence"], end["sequence"])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        last = partition.start
        for x in self._lines():
            n = x["sequenceNumber"]
            if partition.start < n <= partition.end and n > last:
                last = n
                yield (str(x.get("seriesId")), n, x.get("occurredAt"), json.dumps(x.get("events", [])))


class EnvelopeSource(DataSource):
    """`spark.readStream.format("envelopes").load(path)`: event envelopes of a log that grows."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return "series_id string, sequence_number long, occurred_at string, events string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EnvelopeReader(self.options["path"])
