"""Plans, SQL guard, sources, streams and the entry point."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideline.plans import catalogue
from tideline.plans.query_plan import Dataset, Filter, InvalidPlan, QueryPlan, compile_plan, plan_question
from tideline.plans.sqlguard import RejectedSql, SqlSurface, check
from tideline.sources import scans
from tideline.streaming import events as stream


@pytest.mark.parametrize("sql", ["", "drop table x", "select 1; select 2", "select 1 -- x", "select /* c */ 1", "with a as (select 1) insert into b select * from a", "select 1 " + "x" * 60000, "set a=b"])
def test_guard_rejects(spark, sql):
    with pytest.raises(RejectedSql):
        check(spark, sql, {"x", "a", "b"})


@pytest.mark.parametrize(
    "sql",
    [
        "select reflect('java.lang.System', 'getProperty', 'user.name')", "select * from text.`/etc/hostname`", "select * from numbers where n in (select java_method('java.lang.System', 'nanoTime'))", "select * from other", "select * from range(5)",
        "with c as (select * from hidden) select * from c", "select (select max(n) from hidden)", "from numbers insert into x select n", "show tables", "select input_file_name() from numbers", "select n from numbers where exists (select 1 from hidden)",
    ],
)
def test_guard_is_closed(spark, sql):
    spark.range(3).createOrReplaceTempView("hidden")
    s = SqlSurface(spark, {"numbers": spark.range(50).toDF("n")})
    with pytest.raises(RejectedSql):
        s.query(sql)


def test_surface_runs_the_text_as_given(spark):
    s = SqlSurface(spark, {"numbers": spark.range(5).select(F.col("id").alias("use"))})
    assert s.query("select length('a   b') as k").rows[0]["k"] == 5 and s.query("select length('a b') as k").rows[0]["k"] == 3
    assert [r["use"] for r in s.query("with c as (select use from numbers where use > 1), d as (select * from c) select use from d order by use").rows] == [2, 3, 4]
    assert s.query("select case when max(use) over () = 4 then 'it''s; --' end as v from numbers limit 1").rows[0]["v"] is not None
    assert s.status()["relations"] == 1


def test_surface_bounds_and_caches(spark):
    s = SqlSurface(spark, {"numbers": spark.range(50).toDF("n")})
    r = s.query("SELECT n FROM numbers WHERE ';--' = ';--' ORDER BY n", 10)
    assert len(r.rows) == 10 and r.truncated and s.query("SELECT n  FROM numbers WHERE ';--' = ';--' ORDER BY n", 10) is r
    assert len(s.query("select replace('a', 'a', 'b') x", 5000).rows) == 1 and "numbers" in s.schema()


def test_plan_checks_and_order(spark):
    ds = Dataset(text=("name", "role"), number=("rating",))
    df = spark.createDataFrame([("b", "Top'", 1.0), ("a", "top", 1.0), ("c", "mid", None), ("d", "top", None)], "name string, role string, rating double")
    tables, sets = {"p": df}, {"p": ds}
    got = compile_plan(QueryPlan("p", (Filter("role", "eq", "TOP"),), sort=(("rating", "desc"),)), sets, tables)
    assert [r["name"] for r in got.collect()] == ["a", "b", "d"]
    assert [r["name"] for r in compile_plan(QueryPlan("p", (Filter("rating", "gte", 0),), limit=999), sets, tables).collect()] == ["a", "b"]
    for bad in (QueryPlan("q"), QueryPlan("p", (Filter("x", "eq", 1),)), QueryPlan("p", (Filter("rating", "like", 1),)), QueryPlan("p", (Filter("rating", "eq", "1"),)), QueryPlan("p", sort=(("x", "asc"),)), QueryPlan("p", distance_from="mode", distance_field="rating")):
        with pytest.raises(InvalidPlan):
            compile_plan(bad, sets, tables)
    plan = plan_question("top 50 mid players with at least 7 games", "p", ("top", "mid"))
    assert plan.limit == 20 and Filter("games", "gte", 7) in plan.filters


def test_csv_contract(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("gameid , date,league,patch,position,patch\n1,2024-01-02,L,16.10,team,x\n1,2024-01-02,L,16.1,top,x\n")
    df = scans.read_csv(spark, str(p))
    assert df.columns == ["gameid", "date", "league", "patch", "position"] and [r["patch"] for r in df.collect()] == ["16.10", "16.1"]
    prof = scans.profile_csv(df, 2024, ("gameid", "date", "league"))
    assert (prof.rows, prof.games) == (2, 1)
    with pytest.raises(scans.InvalidSource):
        scans.profile_csv(df, 2023, ("gameid",))
    with pytest.raises(scans.InvalidSource):
        scans.profile_csv(df, 2024, ("teamname",))
    team, player = scans.split_team_player(df, "oe", 2024)
    assert (team.count(), player.count()) == (1, 1)


def test_events_to_games_with_verified_summary(spark, tmp_path):
    from pyspark.sql.types import StructType

    p = tmp_path / "e.jsonl"
    ev = [{"game": 1, "seq": 1, "kind": "game_info", "payload": "{}"}, {"game": 1, "seq": 2, "kind": "champion_kill", "team": 100}, {"game": 1, "seq": 3, "kind": "game_end", "payload": '{"winner":100}'}, {"game": 2, "seq": 1, "kind": "champion_kill", "team": 200}]
    p.write_text("\n".join(map(json.dumps, ev)) + "\nnot json\n")
    df = scans.read_events(spark, str(p), StructType.fromDDL("game long, seq long, kind string, team int, payload string"))
    games = scans.games_from_events(df, "game", "seq", "kind", "team", "payload")
    summary = spark.createDataFrame([(2, "complete", 10.0, 0, 1, 200), (1, "complete", 10.0, 0, 0, 200)], "game long, status string, duration double, kills_100 long, kills_200 long, winner int")
    got = {r["game"]: r["winner"] for r in scans.verified_end(games, summary, "game").collect()}
    assert got == {1: 100, 2: 200}


def test_ten_player_rows(spark):
    people = [{"teamID": 100 if k < 5 else 200, "role": "TOP", "summonerName": f" p{k} ", "championName": None if k == 3 else "C"} for k in range(10)]
    games = spark.createDataFrame([(1, json.dumps({"participants": people}), 200), (2, json.dumps({"participants": people[:9]}), 100), (3, json.dumps({"participants": people}), None), (4, "bad", 100), (5, None, 100)], "game long, start string, winner int")
    got = scans.players_from_games(games, "game").collect()
    assert len(got) == 10 and {r["game"] for r in got} == {1} and sum(r["result"] for r in got) == 5
    assert [(r["side"], r["position"], r["champion"], r["result"]) for r in got if r["player"] == "p3"] == [("Blue", "top", "Unknown", 0)]


def test_sinks_and_staging(spark, tmp_path):
    df = spark.createDataFrame([(1, 2023, "a"), (2, 2024, "b")], "k long, oe_year int, v string")
    scans.write_partitions(df, str(tmp_path / "t"), ["oe_year"])
    scans.write_partitions(df.where("oe_year = 2024").withColumn("v", F.lit("c")), str(tmp_path / "t"), ["oe_year"])
    back = scans.projected(spark, str(tmp_path / "t"), ["k", "v", "nope"])
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "c")]
    assert scans.years(spark.read.parquet(str(tmp_path / "t")), [2023]).count() == 1
    assert [r["k"] for r in scans.stage_rows(df.limit(1), df, "k").collect()] == [2]
    with pytest.raises(scans.InvalidSource):
        scans.stage_rows(df, df, "k", most=1)


def test_stream_forms_equal_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = stream.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream.run_to_table(stream.latest_state(events, "user_id", "event_id", ["event_type"]), "t_latest", "complete", str(tmp_path / "c1"))
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert got.join(batch, ["user_id", "event_id"]).count() == batch.count()
    sink = stream.upsert_latest(str(tmp_path / "sink"), "user_id", "event_id")
    base = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type")
    sink(base.where("event_id % 2 = 0"), 0)
    sink(base.where("event_id % 2 = 1"), 1)
    sink(base.where("event_id % 2 = 1"), 1)
    (tmp_path / "sink" / "v7").mkdir()  # a version that was not completed
    version = stream.latest_version(spark, str(tmp_path / "sink"))
    assert version == 1
    assert spark.read.parquet(str(tmp_path / "sink" / f"v{version}")).join(batch, ["user_id", "event_id"]).count() == batch.count()


def test_envelope_source_resumes(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(json.dumps({"seriesId": "s", "sequenceNumber": n, "occurredAt": "x", "events": [{"type": "a"}]}) for n in (1, 2, 2, 3, 1)) + "\n")
    spark.dataSource.register(scans.EnvelopeSource)
    src = spark.readStream.format("envelopes").option("path", str(log)).load()

    def run():
        q = src.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("sequence_number").collect())

    assert run() == [1, 2, 3]
    with log.open("a") as f:
        f.write(json.dumps({"seriesId": "s", "sequenceNumber": 5}) + "\n")
    assert run() == [1, 2, 3, 5]


def test_live_probability(spark):
    df = spark.createDataFrame([(600.0, 1000.0), (60.0 * 80, 1.0), (600.0, None)], "clock double, gold double")
    c = {k: {"gold": 0.001, "intercept": 0.0} for k in ("early", "middle", "late")}
    got = [r["probability"] for r in stream.live_probability(df, c).collect()]
    assert got[0] == pytest.approx(0.7310585786) and got[1:] == [None, None]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(show(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_streams_go_on_after_a_restart(spark, tmp_path):
    schema = spark.range(1).select("id").schema
    for k in (0, 1):
        spark.range(5 * k, 5 * k + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = stream.run_to_table(stream.file_stream(spark, str(tmp_path / "in"), schema), f"again{k}", "append", str(tmp_path / "cp"))
    assert sorted(r["id"] for r in got.collect()) == list(range(10))


def test_pages_go_on_within_ties(spark):
    from tideline.plans import api

    df = spark.createDataFrame([(k, "L", 2000, "t", "2000-01-0%d" % (1 + k // 4)) for k in range(8)], "game_id long, league string, year int, team string, played_at string")
    seen, before = [], None
    while rows := api.matches(df, before=before, limit=3).collect():
        seen += [r["game_id"] for r in rows]
        before = (rows[-1]["played_at"], rows[-1]["game_id"])
    assert seen == [4, 5, 6, 7, 0, 1, 2, 3]


def test_search_index(spark, tmp_path):
    from tideline.functions import text

    data = [(1, "Red Fox", "the fox runs. The red dog sleeps"), (2, "Dog", "red the fox"), (3, None, None), (4, "Fox", "nothing")]
    df = spark.createDataFrame(data, "id long, title string, body string")
    index = text.SearchIndex.build(df, "id", ["title", "body"], str(tmp_path / "i"), buckets=4)
    ids = lambda *a, **k: [r["id"] for r in index.search(*a, **k).collect()]
    assert sorted(ids(["fox"])) == [1, 2, 4] and ids(["fox"], {"title": 5.0, "body": 0.1})[0] == 4
    assert ids(["fox"], {"body": 1.0}) == [2, 1] and ids(["red fox"]) == [1] and sorted(ids(["red", "fox"])) == [1, 2] and ids(["the red dog"]) == [1]
    assert ids(["cat"]) == [] and ids(["..."]) == []
    assert index.search(["fox"])._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [bucket") >= 1 or "bucket" in index.search(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in df.select(text.snippet(F.col("body"), ["fox"], 4)).collect()] == ["the [fox] run", "the [fox]", None, None]
