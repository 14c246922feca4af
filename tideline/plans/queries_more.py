"""Queries of the remaining operators: scopes, studies, tiers, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsons, scalars as s, text
from ..functions.scalars import epoch_seconds, jaccard
from ..operators import aggs, joins, metrics, sequential
from . import api
from .queries_api import MATCHES_SQL, PLAYERS_SQL, matches, players
from .queries_models import SCORED_SQL, _scored
from .registry import Tables, query


@query("""SELECT n_nationkey, upper(n_name) IN ('NATION_1', 'NATION_2') OR regexp_matches(upper(n_name), '_1|_20') AS is_major FROM nation""")
def membership_with_fallback(t: Tables) -> DataFrame:
    up = F.upper("n_name")
    return t.nation.select("n_nationkey", (up.isin("NATION_1", "NATION_2") | up.rlike("_1|_20")).alias("is_major"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus <> 'P') - INTERVAL 120 DAY""")
def window_from_latest(t: Tables) -> DataFrame:
    # The accepted rows are filtered before the latest date is taken.
    ok = t.orders.where("o_orderstatus <> 'P'")
    last = ok.agg(F.max("o_orderdate").alias("last"))
    return ok.crossJoin(F.broadcast(last)).where(F.expr("o_orderdate >= last - interval 120 days")).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'""")
def through_cutoff(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz")).select("o_orderkey")


@query(f"""SELECT player_id FROM {PLAYERS_SQL} WHERE (league = 'ASIA' OR league = 'AFRICA') AND (role = 'BUILDING' OR games >= 12)""")
def scope_groups(t: Tables) -> DataFrame:
    return players(t).where(api.in_scopes([[F.col("league") == "ASIA", F.col("league") == "AFRICA"], [F.col("role") == "BUILDING", F.col("games") >= 12], []])).select("player_id")


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_contains(list(l_suppkey), 3)""")
def array_membership(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).where(F.array_contains("s", F.lit(3).cast("long"))).select("l_orderkey")


@query("""WITH l AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, o_custkey % 50 AS c FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS other, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS p, o_custkey % 50 AS c FROM orders WHERE o_orderkey % 2 = 1),
    a AS (SELECT d, p, c, min(o_orderkey) AS o_orderkey FROM l GROUP BY ALL HAVING count(*) = 1), b AS (SELECT d, p, c, min(other) AS other FROM r GROUP BY ALL HAVING count(*) = 1), m AS (SELECT o_orderkey, other FROM a JOIN b USING (d, p, c))
    SELECT l.o_orderkey, m.other FROM l LEFT JOIN m ON l.o_orderkey = m.o_orderkey""")
def signature_join(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 50).alias("c"))
    right = o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "other")
    return joins.signature_match(o.where("o_orderkey % 2 = 0"), right, ["d", "p", "c"], "o_orderkey", "other")


@query("""WITH e AS (SELECT *, (epoch_us(ts) / 1000000.0) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 9 = 0 THEN 1000 ELSE 0 END AS seq FROM events), g AS (SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY user_id ORDER BY t, seq) > 1, false) AS gap FROM e),
    c AS (SELECT DISTINCT user_id, floor(t / 604800) * 604800 AS t FROM e), j AS (SELECT c.user_id, c.t, (SELECT arg_max({'id': event_id, 'gap': gap, 't': g.t}, (g.t, seq)) FROM g WHERE g.user_id = c.user_id AND g.t <= c.t) AS s FROM c)
    SELECT user_id, CAST(t AS BIGINT) AS at, CASE WHEN t - s.t <= 259200 AND NOT s.gap THEN s.id END AS event_id FROM j""")
def checkpoint_bounded(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("t", epoch_seconds("ts")).withColumn("seq", F.row_number().over(w) + F.when(F.col("event_id") % 9 == 0, 1000).otherwise(0))
    checks = e.select("user_id", (F.floor(F.col("t") / 604800) * 604800).cast("double").alias("t")).distinct()
    got = joins.checkpoint_states(checks, e.select("user_id", "t", "seq", "event_id"), ["user_id"], "t", "seq", ["event_id"], 259200.0)
    return got.select("user_id", F.col("t").cast("long").alias("at"), "event_id")


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 10 END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 20 END AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((CASE WHEN a IS NULL THEN 0 ELSE 2 * greatest(-3, least(3, a)) END + CASE WHEN b IS NULL THEN 0 ELSE greatest(-3, least(3, b)) END) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END, 0), 6) AS composite FROM z""")
def role_composite(t: Tables) -> DataFrame:
    z = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 10).alias("a"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_discount") * 20).alias("b"))
    return z.select("l_orderkey", "l_linenumber", F.round(aggs.observed_composite({"a": 2.0, "b": 1.0}), 6).alias("composite"))


@query("""WITH e AS (SELECT o_custkey AS s, max(epoch_us(o_orderdate) / 1000000.0) AS fin FROM orders GROUP BY ALL), r AS (SELECT o.*, fin FROM orders o JOIN e ON o_custkey = s)
    SELECT a.o_orderkey, round(coalesce(median(b.o_totalprice), -1), 4) AS prior_o_orderpriority FROM r a LEFT JOIN r b ON a.o_orderpriority = b.o_orderpriority AND b.fin < a.fin GROUP BY a.o_orderkey""")
def expanding_scope_medians(t: Tables) -> DataFrame:
    o = t.orders.withColumn("fin", epoch_seconds("o_orderdate")).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "fin")
    got = sequential.expanding_scope_medians(o, "o_custkey", "fin", ["o_orderpriority"], "o_totalprice", -1.0)
    return got.select("o_orderkey", F.round("prior_o_orderpriority", 4).alias("prior_o_orderpriority"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT event_id, user_id, v, k, 0.0::DOUBLE AS mu, 120.0::DOUBLE AS sigma, 0.0::DOUBLE AS vol FROM e WHERE k = 1
    UNION ALL SELECT e.event_id, e.user_id, e.v, e.k, CASE WHEN f.v IS NULL THEN mu ELSE mu + 0.1::DOUBLE * (sigma / 120) * (f.v - mu) END, CASE WHEN f.v IS NULL THEN sigma ELSE greatest(40.0::DOUBLE, sigma * 0.995::DOUBLE) END, CASE WHEN f.v IS NULL THEN vol ELSE 0.9::DOUBLE * vol + 0.1::DOUBLE * abs(f.v - mu) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT event_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(vol, 6) AS vol FROM f""")
def volatility_fold(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", epoch_seconds("ts").alias("t"), "value")
    return sequential.volatility_fold(e, "user_id", ["t", "event_id"], "value").select("event_id", *[F.round(c, 6).alias(c) for c in ("mu", "sigma", "vol")])


@query("""WITH m AS (SELECT n_nationkey AS k, mask, CAST(mask * (n_nationkey + 1) % 17 AS DOUBLE) AS v FROM nation, range(32) r(mask)), p AS (SELECT unnest(range(5)) AS player),
    x AS (SELECT k, CAST(player AS INTEGER) AS player, a.v, b.v AS w, bit_count(a.mask) AS s FROM m a JOIN p ON (a.mask // CAST(pow(2, player) AS BIGINT)) % 2 = 0 JOIN m b USING (k) WHERE b.mask = a.mask + CAST(pow(2, player) AS BIGINT))
    SELECT k, player, round(sum((w - v) / (5 * CASE s WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END)), 6) AS contribution FROM x GROUP BY k, player""")
def shapley_five(t: Tables) -> DataFrame:
    m = t.nation.select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask"))
    v = m.withColumn("v", (F.col("mask") * (F.col("k") + 1) % 17).cast("double"))
    return aggs.shapley(v, "k", "mask", "v", 5).withColumn("contribution", F.round("contribution", 6))


@query("""WITH i AS (SELECT p_brand AS k, p_partkey, p_retailprice AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part), j AS (SELECT * FROM i),
    c AS (SELECT a.k, a.s + b.s + c.s AS total, list_aggregate(list_sort([CAST(a.p_partkey AS VARCHAR), CAST(b.p_partkey AS VARCHAR), CAST(c.p_partkey AS VARCHAR)]), 'string_agg', '|') AS chosen FROM j a JOIN j b ON a.k = b.k AND a.n < b.n JOIN j c ON b.k = c.k AND b.n < c.n),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(total, 6) DESC, chosen) AS place FROM c) SELECT k, CAST(place AS INTEGER) AS place, chosen, round(total, 4) AS total FROM r WHERE place <= 2""")
def best_builds(t: Tables) -> DataFrame:
    # Only items that fewer than slots + top - 1 others exceed can be in a best set; ranks are cut before rows are gathered.
    first = t.part.withColumn("n", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))).where("n <= 4")
    items = first.groupBy(F.col("p_brand").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("score")))).alias("items"))
    return aggs.best_sets(items, "k", "items", 3, "score", 2).withColumn("total", F.round("total", 4))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 5 + 12 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') END AS patch FROM part""")
def patch_canonical(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 7 == 0, "latest").otherwise(F.concat((F.col("p_size") % 5 + 12).cast("string"), F.lit("."), (F.col("p_partkey") % 25).cast("string")))
    v = s.version_parts(raw)
    return t.part.select("p_partkey", F.when(v.isNotNull(), F.concat(v["major"].cast("string"), F.lit("."), F.lpad(v["minor"].cast("string"), 2, "0"))).alias("patch"))


@query("""SELECT doc_id, n AS name FROM documents, (VALUES ('the'), ('of the'), ('and')) v(n) WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || n || ' ')
    AND NOT (n = 'the' AND contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the '))""")
def entity_mentions(t: Tables) -> DataFrame:
    return text.mentions(t.documents, "doc_id", "text", ["the", "of the", "and"])


@query("""WITH p AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority || o_orderstatus))) AS s FROM orders GROUP BY ALL), e AS (SELECT a.k AS ref, b.k AS candidate, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM p a, p b WHERE a.k % 50 = 0 AND b.k % 50 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, ref) AS n FROM e) SELECT candidate, ref, score FROM r WHERE n = 1 AND score >= 0.3""")
def similar_candidates(t: Tables) -> DataFrame:
    p = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.concat("o_orderpriority", "o_orderstatus")).alias("s"))
    p = p.select(F.col("k").alias("id"), F.array_sort("s").alias("s"))
    picked = p.where("id % 50 = 0")
    # Candidates of one set have one best reference, and of references of one set only the first counts.
    first = lambda df: df.groupBy("s").agg(F.min("id").alias("id"))
    candidates = p.where("id % 50 <> 0")
    firsts = first(candidates)
    edges = joins.set_similarities(first(picked), firsts, "id", "s", near=1e-5).select(F.col("left_id").alias("ref"), F.col("right_id").alias("candidate"), F.round("score", 6).alias("score"))
    best = joins.viable_candidates(edges, picked.select("id"), "ref", "candidate", "score", 0.3)
    classes = firsts.join(best, F.col("id") == F.col("candidate")).select("s", "ref", "score")
    return candidates.select(F.col("id").alias("candidate"), "s").join(classes, "s").select("candidate", "ref", "score")


@query(f"""WITH p AS {PLAYERS_SQL}, c AS (SELECT median(rating) AS med, avg(rating) AS mean FROM p WHERE role = 'HOUSEHOLD'), k AS (SELECT team, max(rating) AS best FROM p GROUP BY team)
    SELECT name, round(abs(rating - med), 4) AS from_median, round(abs(rating - mean), 4) AS from_mean, best FROM p, c, k WHERE role = 'HOUSEHOLD' AND k.team = p.team AND games >= 2 ORDER BY abs(rating - med) DESC, name LIMIT 20""")
def player_champions_page(t: Tables) -> DataFrame:
    p = players(t)
    mine = p.where("role = 'HOUSEHOLD'")
    center = mine.agg(F.median("rating").alias("med"), F.avg("rating").alias("mean"))
    best = p.groupBy("team").agg(F.max("rating").alias("best"))
    out = mine.where("games >= 2").crossJoin(F.broadcast(center)).join(best, "team")
    d = F.abs(F.col("rating") - F.col("med"))
    return out.orderBy(d.desc(), "name").limit(20).select("name", F.round(d, 4).alias("from_median"), F.round(F.abs(F.col("rating") - F.col("mean")), 4).alias("from_mean"), "best")


@query(f"""WITH m AS {MATCHES_SQL}, l AS (SELECT max(year) AS y FROM m WHERE league = 'EUROPE') SELECT team, CAST(count(*) AS BIGINT) AS maps FROM m, l WHERE league = 'EUROPE' AND year = y GROUP BY team HAVING count(*) >= 3 ORDER BY maps DESC, team LIMIT 20""")
def tier_rows_page(t: Tables) -> DataFrame:
    m = matches(t).where("league = 'EUROPE'")
    latest = m.agg(F.max("year").alias("y"))
    return m.join(F.broadcast(latest), F.col("year") == F.col("y")).groupBy("team").agg(F.count(F.lit(1)).alias("maps")).where("maps >= 3").orderBy(F.desc("maps"), "team").limit(20)


@query(f"""SELECT league, string_agg(DISTINCT CAST(year AS VARCHAR), '|' ORDER BY CAST(year AS VARCHAR)) AS years, CAST(count(DISTINCT team) AS BIGINT) AS teams, min(played_at) AS first_day, max(played_at) AS last_day FROM {MATCHES_SQL} GROUP BY league""")
def tier_facets(t: Tables) -> DataFrame:
    return matches(t).groupBy("league").agg(F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), "|").alias("years"), F.count_distinct("team").alias("teams"), F.min("played_at").alias("first_day"), F.max("played_at").alias("last_day"))


@query(f"""SELECT 'players' AS dataset, CAST(player_id AS VARCHAR) AS row_key, name, CAST(rating AS DOUBLE) AS rating, CAST(NULL AS VARCHAR) AS played_at FROM {PLAYERS_SQL} UNION ALL SELECT 'matches', CAST(game_id AS VARCHAR), blue, NULL, played_at FROM {MATCHES_SQL}""")
def projection_builder(t: Tables) -> DataFrame:
    a = players(t).select(F.lit("players").alias("dataset"), F.col("player_id").cast("string").alias("row_key"), "name", "rating")
    b = matches(t).select(F.lit("matches").alias("dataset"), F.col("game_id").cast("string").alias("row_key"), F.col("blue").alias("name"), "played_at")
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH b AS (SELECT doc_id % 20 AS c, sum(y - p) AS num, count(*) AS den FROM {SCORED_SQL} GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS clusters, round(sum(num) / sum(den), 6) AS ratio FROM b""")
def ratio_clusters(t: Tables) -> DataFrame:
    rows = _scored(t).select((F.col("doc_id") % 20).alias("c"), (F.col("y") - F.col("p")).alias("num"), F.lit(1.0).alias("den"))
    return metrics.cluster_bootstrap(rows, "c", "num", "den", draws=200).select("clusters", F.round("estimate", 6).alias("ratio"))


@query(f"""SELECT round(((h + 1.9208) / (n + 3.8416)) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low, round(((h + 1.9208) / (n + 3.8416)) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high
    FROM (SELECT CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM {SCORED_SQL})""")
def coverage_interval(t: Tables) -> DataFrame:
    a = _scored(t).agg(F.sum((F.col("y") == 1).cast("double")).alias("h"), F.count(F.lit(1)).cast("double").alias("n"))
    return a.select(metrics.coverage_interval(F.col("h"), F.col("n")).alias("c")).select(F.round("c.low", 6).alias("low"), F.round("c.high", 6).alias("high"))


@query(f"""WITH RECURSIVE x AS MATERIALIZED (SELECT ln(p / (1 - p)) AS x, y::DOUBLE AS y FROM {SCORED_SQL} WHERE y IS NOT NULL AND p IS NOT NULL),
    f AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS moved
    UNION ALL SELECT k + 1, a - sa, b - sb, greatest(abs(sa), abs(sb)) FROM (SELECT k, a, b, greatest(-1, least(1, (g1 * h3 - g2 * h2) / (h1 * h3 - h2 * h2))) AS sa, greatest(-1, least(1, (h1 * g2 - h2 * g1) / (h1 * h3 - h2 * h2))) AS sb
    FROM (SELECT k, a, b, sum(q - y) + 0.01 * a AS g1, sum((q - y) * x) + 0.01 * (b - 1) AS g2, sum(q * (1 - q)) + 0.01 AS h1, sum(q * (1 - q) * x) AS h2, sum(q * (1 - q) * x * x) + 0.01 AS h3 FROM (SELECT k, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS q FROM f, x WHERE k < 40 AND moved >= 1e-9) GROUP BY k, a, b)))
    SELECT 'fitted' AS status, round(a, 6) AS intercept, round(b, 6) AS slope FROM f ORDER BY k DESC LIMIT 1""")
def affine_calibration(t: Tables) -> DataFrame:
    got = metrics.affine_logit_calibration(_scored(t), "y", "p", least=50)
    return t.spark.createDataFrame([(got["status"], round(got["intercept"], 6), round(got["slope"], 6))], "status string, intercept double, slope double")


@query(f"""WITH c AS (SELECT p, CAST(sum(y) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM {SCORED_SQL} WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY p), u AS (SELECT p, row_number() OVER (ORDER BY p) AS k, sum(s) OVER (ORDER BY p) AS cs, sum(n) OVER (ORDER BY p) AS cn, s, n FROM c),
    m AS (SELECT a.k AS i, b.k AS j, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS mean FROM u a JOIN u b ON b.k >= a.k), r AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS least FROM m),
    f AS (SELECT j AS k, round(max(least), 9) AS value FROM r GROUP BY j) SELECT round(min(p), 6) AS low, round(max(p), 6) AS high, round(value, 6) AS value FROM f JOIN u USING (k) GROUP BY value""")
def isotonic_calibration(t: Tables) -> DataFrame:
    # The fit at k is the greatest over i <= k of the least over j >= k of the means from i to j.
    got = metrics.isotonic_calibration(_scored(t), "y", "p")
    return got.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "value")])


@query("""SELECT conv_id, bool_or(role = 'system') AS has_system, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id""")
def event_detection(t: Tables) -> DataFrame:
    ev = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("e"))
    return ev.select("conv_id", F.exists("e", lambda x: x["role"] == "system").alias("has_system"), F.array_max(F.transform("e", lambda x: x["turn"])).alias("last_turn"))


@query("""SELECT l_suppkey, sum(CASE WHEN l_shipdate <= TIMESTAMP '1996-01-01' AND l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returns, arg_min(l_partkey, (l_shipdate, l_orderkey, l_linenumber)) FILTER (WHERE l_shipdate <= TIMESTAMP '1996-01-01') AS first_part FROM lineitem GROUP BY l_suppkey""")
def first_event_checkpoint(t: Tables) -> DataFrame:
    cut = F.col("l_shipdate") <= F.lit("1996-01-01").cast("timestamp_ntz")
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(cut & (F.col("l_returnflag") == "R")).alias("returns"), F.min_by("l_partkey", F.when(cut, F.struct("l_shipdate", "l_orderkey", "l_linenumber"))).alias("first_part"))


@query("""SELECT user_id, CAST(m AS INTEGER) AS minute, CAST(count(*) FILTER (WHERE event_id % 60 <= m) AS BIGINT) AS n FROM events, (VALUES (10), (20), (30)) v(m) GROUP BY ALL""")
def checkpoint_expansion(t: Tables) -> DataFrame:
    states = F.create_map(*[x for m in (10, 20, 30) for x in (F.lit(m), F.count_if(F.col("event_id") % 60 <= m))])
    return t.events.groupBy("user_id").agg(states.alias("states")).select("user_id", F.explode("states").alias("minute", "n"))


@query("""SELECT p_partkey, CASE WHEN t < 0 THEN NULL WHEN t < 300 THEN 152 ELSE least(278, 152 + 9 * (CAST(floor((t - 300) / 60.0) AS BIGINT) + 1)) END::BIGINT AS attack, least(n, 10) * 25::DOUBLE AS mana, CASE WHEN r BETWEEN 1 AND 5 THEN 40 + 20 * (r - 1) + n END::DOUBLE AS strike,
    n * 0.75::DOUBLE AS power, floor(n / 20.0) * 20 AS reach, CASE WHEN n < 4 THEN 0 ELSE least(250, 75 + 25 * floor((n - 4) / 3.0)) END::DOUBLE AS marks, CASE n WHEN 1 THEN 16 WHEN 2 THEN 48 WHEN 3 THEN 64 END::DOUBLE AS burn
    FROM (SELECT p_partkey, p_size AS n, p_size % 7 AS r, p_partkey % 2000 - 50 AS t FROM part)""")
def stack_rules(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_size").alias("n"), (F.col("p_size") % 7).alias("r"), (F.col("p_partkey") % 2000 - 50).alias("t"))
    rule = lambda name: s.stack_bonus(name, "n", "r")
    return p.select("p_partkey", s.turret_attack("t", 300, 152, 9, 278).alias("attack"), rule("manaflow").alias("mana"), rule("siphoning").alias("strike"), rule("mist").alias("power"), rule("mist_range").alias("reach"), rule("mark_range").alias("marks"), rule("void_ranged").alias("burn"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) / 1000000.0) AS t, value FROM events)
    SELECT a.event_id, arg_min(b.event_id, (abs(b.t - a.t), b.t, b.event_id)) AS frame, round(min(abs(b.t - a.t)), 6) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type = 'error' GROUP BY a.event_id""")
def nearest_frame(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", epoch_seconds("ts").alias("t"))
    frames = e.where("event_type = 'view'").select("user_id", F.col("t").alias("frame_t"), F.col("event_id").alias("frame"))
    got = joins.nearest_frame(e.where("event_type = 'error'"), frames, ["user_id"], "t", "frame_t", ["frame"])
    return got.where("frame is not null").select("event_id", "frame", F.round("distance", 6).alias("distance"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_shipdate AS observed, l_shipdate + INTERVAL (l_linenumber) DAY AS available, o_orderdate + INTERVAL 60 DAY AS as_of, o_orderdate + INTERVAL 65 DAY AS start FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN as_of >= start THEN 'as_of_not_before_start' WHEN observed > available THEN 'available_before_observed' WHEN available > as_of THEN 'not_available_yet' WHEN as_of - observed > INTERVAL 45 DAY THEN 'stale' ELSE 'ok' END AS verdict FROM f""")
def time_axis_guard(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    f = j.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("observed"), F.expr("l_shipdate + make_dt_interval(cast(l_linenumber as int))").alias("available"), F.expr("o_orderdate + interval 60 days").alias("as_of"), F.expr("o_orderdate + interval 65 days").alias("start"))
    return f.select("l_orderkey", "l_linenumber", joins.time_axis("observed", "available", "as_of", "start", 45 * 86400).alias("verdict"))


@query(f"""WITH p AS (SELECT name, role, rating, games, win_rate FROM {PLAYERS_SQL}),
    b AS (SELECT 'rating' AS board, name, CAST(rating AS DOUBLE) AS score, row_number() OVER (ORDER BY rating DESC, name) AS place FROM p WHERE rating IS NOT NULL UNION ALL SELECT 'win_rate', name, win_rate, row_number() OVER (ORDER BY win_rate DESC, name) FROM p WHERE win_rate IS NOT NULL AND games >= 10
    UNION ALL SELECT 'rating:' || role, name, rating, row_number() OVER (PARTITION BY role ORDER BY rating DESC, name) FROM p WHERE rating IS NOT NULL) SELECT board, CAST(place AS INTEGER) AS place, name, score FROM b WHERE place <= 30""")
def leaderboards(t: Tables) -> DataFrame:
    return api.leaderboards(players(t), min_games=10, top=30)


@query(f"""WITH c AS (SELECT m.league, p.role, m.year, p.name, p.games, avg(p.rating) AS value FROM {MATCHES_SQL} m JOIN {PLAYERS_SQL} p ON m.blue = p.name GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY league, role, year ORDER BY value DESC, name) AS place, count(*) OVER (PARTITION BY league, role, year) AS n FROM c)
    SELECT role, year, name, CAST(place AS INTEGER) AS place, substr('ABCD', least(4, CAST(floor((place - 1) / n * 4) AS INTEGER) + 1), 1) AS bucket FROM r WHERE league = 'ASIA' AND role IN ('BUILDING', 'MACHINERY') AND games >= 8""")
def tier_index(t: Tables) -> DataFrame:
    p = players(t).select("name", "role", "games", "rating")
    rows = matches(t).select("league", "year", F.col("blue").alias("name")).join(p, "name").groupBy("league", "role", "year", "name", "games").agg(F.avg("rating").alias("value"))
    index = api.tier_rows(rows, ["league", "role", "year"], "value", "name")
    return api.tier_filter(index, {"league": ["ASIA"], "role": ["BUILDING", "MACHINERY"]}, "games", 8).select("role", "year", "name", "place", "bucket")


@query("""SELECT c_custkey, CAST(json_array_length(j) AS BIGINT) AS n, list_aggregate(list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: coalesce(json_extract_string(j, '$[' || i || ']'), '-')), 'string_agg', '|') AS items, 'deep:' || c_mktsegment AS nested
    FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '[1,null,"x y"]' ELSE '["' || c_name || '",' || c_nationkey || ']' END AS j FROM customer)""")
def json_list_decode(t: Tables) -> DataFrame:
    j = F.when(F.col("c_custkey") % 5 == 0, F.lit('[1,null,"x y"]')).otherwise(F.concat(F.lit('["'), "c_name", F.lit('",'), F.col("c_nationkey").cast("string"), F.lit("]")))
    doc = F.to_json(F.struct(F.struct(F.concat(F.lit("deep:"), "c_mktsegment").alias("b c")).alias("a")))
    got = t.customer.select("c_custkey", jsons.decode_list(j).alias("d"), jsons.at_path(doc, ["a", "b c"]).alias("nested"))
    return got.select("c_custkey", F.col("d.count").alias("n"), F.array_join("d.values", "|", "-").alias("items"), "nested")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'own' ELSE n_name END AS name, 'r' || n_regionkey AS region, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS keys FROM nation""")
def map_merge(t: Tables) -> DataFrame:
    base = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    own = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("name"), F.lit("own"), F.lit("extra"), F.lit("1")))
    m = t.nation.select("n_nationkey", jsons.merged(base, own).alias("m"))
    return m.select("n_nationkey", F.col("m")["name"].alias("name"), F.col("m")["region"].alias("region"), F.size("m").cast("long").alias("keys"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS lines, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, max(l_quantity) AS most FROM lineitem GROUP BY ALL)
    SELECT l.l_orderkey, l.l_linenumber, CAST(lines AS BIGINT) AS lines, CAST(returned AS BIGINT) AS returned, round(l.l_quantity / most, 6) AS of_most FROM lineitem l JOIN o USING (l_orderkey)""")
def group_to_member(t: Tables) -> DataFrame:
    o = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_quantity").alias("most"))
    return t.lineitem.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "lines", "returned", F.round(F.col("l_quantity") / F.col("most"), 6).alias("of_most"))


@query("""WITH m AS (SELECT l_orderkey, list(l_suppkey) AS s, any_value(o_orderpriority) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
    SELECT s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS orders, CAST(count(DISTINCT p) AS BIGINT) AS priorities FROM supplier LEFT JOIN m ON list_contains(m.s, s_suppkey) GROUP BY s_suppkey""")
def array_left_join(t: Tables) -> DataFrame:
    # Membership in an array is equality with one of its elements, so the join has a key.
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    members = sets.select("l_orderkey", "o_orderpriority", F.explode("s").alias("s_suppkey"))
    return t.supplier.select("s_suppkey").join(members, "s_suppkey", "left").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("""WITH n AS (SELECT least(o_custkey % 25, s) AS lo, greatest(o_custkey % 25, s) AS hi, o_orderkey, epoch_us(o_orderdate) AS t, o_custkey % 25 AS a, s, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 END AS y FROM (SELECT *, o_orderkey % 24 AS s FROM orders) WHERE o_custkey % 25 <> s),
    d AS (SELECT *, CASE WHEN a = lo THEN y ELSE 1 - y END AS lo_win FROM n), w AS (SELECT o_orderkey, avg(lo_win) OVER (PARTITION BY lo, hi ORDER BY t, o_orderkey ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS r, a = lo AS first FROM d)
    SELECT o_orderkey, round(CASE WHEN first THEN r - 0.5 ELSE 0.5 - r END, 6) AS edge FROM w""")
def pair_trailing8(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 25).alias("a"), (F.col("o_orderkey") % 24).alias("b"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("y")).where("a <> b")
    # The history is of the unordered pair; a side sees it from its own end.
    o = o.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).withColumn("lo_win", F.when(F.col("a") == F.col("lo"), F.col("y")).otherwise(1 - F.col("y")))
    r = F.avg("lo_win").over(Window.partitionBy("lo", "hi").orderBy("o_orderdate", "o_orderkey").rowsBetween(-8, -1))
    return o.withColumn("r", r).select("o_orderkey", F.round(F.when(F.col("a") == F.col("lo"), F.col("r") - 0.5).otherwise(0.5 - F.col("r")), 6).alias("edge"))
