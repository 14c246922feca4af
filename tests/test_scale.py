"""Plans and results that small tables do not show by themselves."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tideline.operators import joins, sequential
from tideline.plans import catalogue
from tideline.plans.state_query import answer_states
from tideline.streaming import events as stream


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_questions_broadcast_no_table(spark):
    states = spark.createDataFrame([(1, None, None, "A", 2, [7], None), (2, None, None, "b", 19, None, None)], "state_id long, patch string, mode string, name string, level long, items array<long>, effects array<string>")
    identities = spark.sql("select * from values ('a', 5L), ('b', 6L) t(name, key)")  # of known, small size
    facts = identities.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(18).cast("long"))).alias("level")).withColumn("hp", F.col("level") * 10.0)
    items = spark.sql("select * from values (7L, 'hp', 3.0D, true), (8L, 'hp', 4.0D, true) t(item, stat, amount, flat)")
    got = answer_states(states, identities, facts, items, ["hp"], "1")
    assert "Broadcast" not in _plan(got)
    assert [(r["status"], r["hp"]) for r in got.orderBy("state_id").collect()] == [("answered", 23.0), ("invalid_scenario", None)]


def test_pairs_of_one_frequent_set_are_spread(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 100 == 7, F.array(F.lit("c"), F.lit("b"))).when(F.col("id") % 100 == 8, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("s"))
    got = joins.set_similarities(df.where("id % 50 = 0"), df, "id", "s")
    rows = got.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")).collect()
    assert sum(r["n"] for r in rows) == 60 * 3000 and max(r["n"] for r in rows) < 60 * 3000 / 2
    assert abs(sum(r["total"] for r in rows) - 60 * (2940 + 30 / 3)) < 1e-6


def test_similarity_matrix_has_a_row_of_every_customer(spark, tmp_path):
    orders = [(k, c, p) for k, (c, p) in enumerate([(1, "a"), (1, "b"), (7, "b"), (50, "c"), (50, "b"), (50, "b"), (99, "a")])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["left_id"], r["right_id"]): r["score"] for r in catalogue.QUERIES["jaccard_similarity_matrix"](spark, str(tmp_path)).collect()}
    sets = {1: {"a", "b"}, 7: {"b"}, 50: {"b", "c"}, 99: {"a"}}
    assert got == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets}


def test_near_pairs_keep_every_best(spark):
    df = spark.range(400).select("id", F.array(F.col("id") % 7, F.col("id") % 5 + 10, F.col("id") % 3 + 20).alias("s"))
    every = joins.set_similarities(df.where("id % 50 = 0"), df, "id", "s")
    near = joins.set_similarities(df.where("id % 50 = 0"), df, "id", "s", near=1e-5)
    best = lambda e: {r["right_id"]: tuple(r["b"]) for r in e.groupBy("right_id").agg(F.max(F.struct("score", -F.col("left_id"))).alias("b")).collect()}
    assert best(near) == best(every) and len(best(near)) == 400 and near.count() < every.count() / 2


def test_elo_blocks_add_the_sum_of_a_block(spark):
    rng = random.Random(3)
    games = [(k, float(k // 300), *rng.sample(range(5), 2), float(rng.random() < 0.5)) for k in range(1200)]
    df = spark.createDataFrame(games, "k long, t double, a long, b long, score double")
    state, want = [1500.0] * 5, {}
    for block in range(4):
        total = [0.0] * 5
        for k, _, a, b, score in games[300 * block : 300 * block + 300]:
            want[k] = (state[a], state[b])
            d = 24.0 * (score - 1.0 / (1.0 + 10.0 ** ((state[b] - state[a]) / 400.0)))
            total[a] += d
            total[b] -= d
        state = [s + d for s, d in zip(state, total)]
    got = sequential.elo_before(df, "t", "k", "a", "b", "score", blocks=True).collect()
    assert {r["k"]: (r["a_before"], r["b_before"]) for r in got} == want  # to the bit: long runs of large blocks amplify the last one


def test_monotonic_takes_the_frames_of_a_batch_together(spark, tmp_path):
    n = 30_000  # one key, more than a frame of 10 000 rows, later numbers first
    df = spark.range(n).select(F.lit(1).alias("k"), ((F.lit(n - 1) - F.col("id"))).alias("seq"), F.lit("x").alias("v"))
    df.union(df.limit(10)).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    src = stream.file_stream(spark, str(tmp_path / "t.parquet"), df.schema)
    got = stream.run_to_table(stream.monotonic(src, "k", "seq", ["v"]), "frames", "append", str(tmp_path / "cp"))
    assert got.count() == n and got.distinct().count() == n


def test_streams_read_a_file_or_a_folder(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert catalogue.QUERIES["stream_monotonic"](spark, str(tmp_path)).count() == rows.count()


def test_matches_page_begins_before_its_day(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1997-06-15")).otherwise(F.lit("1997-06-14")).cast(orders.schema["o_orderdate"].dataType)
    orders.withColumn("o_orderdate", day).write.parquet(str(tmp_path / "orders.parquet"))
    rows = catalogue.QUERIES["matches_page"](spark, str(tmp_path)).collect()
    assert len(rows) == 20 and {r["played_at"] for r in rows} == {"1997-06-14"}
