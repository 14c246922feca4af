"""Ordered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, epoch_seconds, grade, natural_key
from ..operators import sequential, windows
from .registry import Tables, query

T = "(epoch_us(ts) / 1000000.0)"


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("t", epoch_seconds("ts"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY ALL),
    h AS (SELECT event_type, day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, CAST(coalesce(n, 0) AS BIGINT) AS prior_n, round(CASE WHEN n >= 40 AND sqrt(greatest(0, q / n - (s / n) * (s / n))) > 1e-9 THEN (value - s / n) / sqrt(greatest(0, q / n - (s / n) * (s / n))) END, 6) AS z FROM events e JOIN h ON e.event_type = h.event_type AND CAST(e.ts AS DATE) = h.day""")
def historical_z_daily(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.col("ts").cast("date"))
    return windows.daily_history_z(e, ["event_type"], "day", "value", 40).select("event_id", "prior_n", F.round("z", 6).alias("z"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - avg(l_extendedprice) OVER w) / nullif(stddev_pop(l_extendedprice) OVER w, 0) AS z FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, l_linenumber, round(greatest(1, least(99, 50 + 22 * greatest(-3, least(3, z)))), 4) AS score, CASE WHEN z IS NULL THEN NULL WHEN round(greatest(1, least(99, 50 + 22 * greatest(-3, least(3, z)))), 4) >= 90 THEN 'S' WHEN round(greatest(1, least(99, 50 + 22 * greatest(-3, least(3, z)))), 4) >= 80 THEN 'A'
    WHEN round(greatest(1, least(99, 50 + 22 * greatest(-3, least(3, z)))), 4) >= 70 THEN 'B' WHEN round(greatest(1, least(99, 50 + 22 * greatest(-3, least(3, z)))), 4) >= 60 THEN 'C' WHEN round(greatest(1, least(99, 50 + 22 * greatest(-3, least(3, z)))), 4) >= 50 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN z IS NOT NULL THEN z END AS z FROM z) WHERE z IS NOT NULL""")
def group_transform_grade(t: Tables) -> DataFrame:
    z = t.lineitem.select("l_orderkey", "l_linenumber", windows.group_z("l_extendedprice", ["l_orderkey"]).alias("z")).where("z is not null")
    score = F.round(clip(50 + 22 * clip("z", -3, 3), 1, 99), 4)
    return z.select("l_orderkey", "l_linenumber", score.alias("score"), grade(score).alias("grade"))


@query("""SELECT o_orderkey, round(coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.5), 6) AS form,
    round(avg(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 6) AS early FROM orders""")
def form_trailing10(t: Tables) -> DataFrame:
    o = t.orders.withColumn("won", (F.col("o_orderstatus") == "F").cast("double")).withColumn("v", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")))
    by, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    return o.select("o_orderkey", F.round(windows.trailing_mean("won", by, order, 10, 0.5), 6).alias("form"), F.round(windows.trailing_mean("v", by, order, 12), 6).alias("early"))


@query("""SELECT o_orderkey, round(coalesce(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0.5) - 0.5, 6) AS edge FROM orders""")
def h2h_trailing8(t: Tables) -> DataFrame:
    o = t.orders.withColumn("won", (F.col("o_orderstatus") == "F").cast("double"))
    return o.select("o_orderkey", F.round(windows.trailing_mean("won", ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], 8, 0.5) - 0.5, 6).alias("edge"))


@query("""SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM events""")
def roster_change_flag(t: Tables) -> DataFrame:
    return t.events.select("event_id", windows.changed("event_type", ["user_id"], ["ts", "event_id"]).alias("changed"))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY date_trunc('hour', ts), user_id ORDER BY ts, event_id) AS INTEGER) AS map_index FROM events""")
def series_map_index(t: Tables) -> DataFrame:
    w = Window.partitionBy(F.date_trunc("hour", F.col("ts").cast("timestamp")), "user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.row_number().over(w).alias("map_index"))


def _matches(t: Tables) -> DataFrame:
    """Orders as matches of the customer's nation and the nation of the first line's supplier."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("s"))
    o = t.orders.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("s") == F.col("s_suppkey"))
    score = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
    return o.where("a <> b").select("o_orderkey", epoch_seconds("o_orderdate").alias("t"), "a", "b", score.alias("score"), ((F.col("o_totalprice") - 150000) / 1e3).alias("margin"), (F.col("o_orderpriority") == "1-URGENT").alias("inter"), (F.col("o_custkey") % 3).cast("string").alias("la"), F.when(F.col("s") % 5 != 0, (F.col("s") % 3).cast("string")).alias("lb"))


#: The matches of _matches, numbered in order; the folds below are recursions over that number.
MATCHES_SQL = """m0 AS (SELECT o_orderkey, epoch_us(o_orderdate) / 1000000.0 AS t, c_nationkey AS a, s_nationkey AS b, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS score, (o_totalprice - 150000) / 1e3 AS margin, o_orderpriority = '1-URGENT' AS inter, CAST(o_custkey % 3 AS VARCHAR) AS la, CASE WHEN s % 5 <> 0 THEN CAST(s % 3 AS VARCHAR) END AS lb
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, min({'n': l_linenumber, 's': l_suppkey}).s AS s FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = s WHERE c_nationkey <> s_nationkey),
    m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, o_orderkey) AS k FROM m0)"""


@query(f"""WITH RECURSIVE {MATCHES_SQL}, f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS o_orderkey, 0.0::DOUBLE AS a_before, 0.0::DOUBLE AS b_before, list_transform(range(0, 25), lambda i: 1500.0::DOUBLE) AS s
    UNION ALL SELECT k, o_orderkey, ra, rb, CASE WHEN d IS NULL THEN s ELSE list_transform(s, lambda x, i: CASE i WHEN a + 1 THEN x + d WHEN b + 1 THEN x - d ELSE x END) END FROM (SELECT m.k, m.o_orderkey, m.a, m.b, f.s, f.s[m.a + 1] AS ra, f.s[m.b + 1] AS rb, 24.0::DOUBLE * (m.score - 1 / (1 + pow(10.0::DOUBLE, (f.s[m.b + 1] - f.s[m.a + 1]) / 400))) AS d FROM f JOIN m ON m.k = f.k + 1))
    SELECT o_orderkey, round(a_before, 4) AS a_before, round(b_before, 4) AS b_before FROM f WHERE k > 0""")
def elo_fold(t: Tables) -> DataFrame:
    return _rounded(sequential.elo_before(_matches(t), "t", "o_orderkey", "a", "b", "score"), 4)


@query(f"""WITH RECURSIVE {MATCHES_SQL}, bl AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t) AS k, ms FROM (SELECT t, list({{'id': o_orderkey, 'a': a, 'b': b, 'score': score}}) AS ms FROM m GROUP BY t)),
    f AS (SELECT 0::BIGINT AS k, list_transform(range(0, 25), lambda i: 1500.0::DOUBLE) AS s UNION ALL SELECT k, list_transform(s, lambda r, i: r + coalesce(list_sum(list_transform(ds, lambda x: CASE i WHEN x.a + 1 THEN x.d WHEN x.b + 1 THEN -x.d END)), 0))
    FROM (SELECT bl.k, f.s, list_transform(bl.ms, lambda x: {{'a': x.a, 'b': x.b, 'd': 24.0::DOUBLE * (x.score - 1 / (1 + pow(10.0::DOUBLE, (s[x.b + 1] - s[x.a + 1]) / 400)))}}) AS ds FROM f JOIN bl ON bl.k = f.k + 1))
    SELECT x.id AS o_orderkey, round(s[x.a + 1], 4) AS a_before, round(s[x.b + 1], 4) AS b_before FROM (SELECT f.s, unnest(bl.ms) AS x FROM bl JOIN f ON f.k = bl.k - 1)""")
def elo_fold_blocks(t: Tables) -> DataFrame:
    return _rounded(sequential.elo_before(_matches(t), "t", "o_orderkey", "a", "b", "score", blocks=True), 4)


@query(f"""WITH RECURSIVE {MATCHES_SQL}, f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS o_orderkey, 0.0::DOUBLE AS a_mu, 0.0::DOUBLE AS b_mu, 0.0::DOUBLE AS a_sigma, 0.0::DOUBLE AS b_sigma, 0.0::DOUBLE AS p,
    list_transform(range(0, 25), lambda i: 1500.0::DOUBLE) AS r, list_transform(range(0, 25), lambda i: 0.0::DOUBLE) AS w, list_transform(range(0, 25), lambda i: 80.0::DOUBLE) AS sd, list_transform(range(0, 25), lambda i: NULL::DOUBLE) AS seen, list_transform(range(0, 25), lambda i: NULL::VARCHAR) AS lu, list_transform(range(0, 25), lambda i: NULL::DOUBLE) AS h1, list_transform(range(0, 25), lambda i: NULL::DOUBLE) AS h2
    UNION ALL SELECT k, o_orderkey, ma, mb, sa, sb, 0.5 + (p - 0.5) / (1 + (sa * sa + sb * sb) / 14400),
    list_transform(r, lambda e, i: CASE i WHEN a + 1 THEN e + kr * d WHEN b + 1 THEN e - kr * d ELSE e END),
    list_transform(w, lambda e, i: CASE i WHEN a + 1 THEN e + kw * d WHEN b + 1 THEN e - kw * d ELSE e END),
    list_transform(sd, lambda e, i: CASE i WHEN a + 1 THEN CASE WHEN score IS NULL THEN sa ELSE greatest(25, sa * 0.98::DOUBLE) END WHEN b + 1 THEN CASE WHEN score IS NULL THEN sb ELSE greatest(25, sb * 0.98::DOUBLE) END ELSE e END),
    list_transform(seen, lambda e, i: CASE i WHEN a + 1 THEN CASE WHEN score IS NULL THEN e ELSE t END WHEN b + 1 THEN CASE WHEN score IS NULL THEN e ELSE t END ELSE e END),
    list_transform(lu, lambda e, i: CASE i WHEN a + 1 THEN coalesce(la, e) WHEN b + 1 THEN coalesce(lb, e) ELSE e END),
    list_transform(h1, lambda e, i: CASE i WHEN a + 1 THEN CASE WHEN score IS NULL THEN e ELSE score - q END WHEN b + 1 THEN CASE WHEN score IS NULL THEN e ELSE q - score END ELSE e END),
    list_transform(h2, lambda e, i: CASE i WHEN a + 1 THEN CASE WHEN score IS NULL THEN e ELSE ha END WHEN b + 1 THEN CASE WHEN score IS NULL THEN e ELSE hb END ELSE e END)
    FROM (SELECT *, coalesce(score - p, 0) AS d FROM (SELECT *, 1 / (1 + pow(10.0::DOUBLE, (mb - ma) / 400)) AS p, 1 / (1 + pow(10.0::DOUBLE, (bb - ba) / 400)) AS q, CASE WHEN inter THEN 0 ELSE 20 * (1 + tanh(margin / 200)) END AS kr, CASE WHEN inter THEN 12 * (1 + tanh(margin / 200)) ELSE 0 END AS kw
    FROM (SELECT *, ba + 50 * coalesce(list_avg([ha, ha2]), 0) AS ma, bb + 50 * coalesce(list_avg([hb, hb2]), 0) AS mb, CASE WHEN la <> lu[a + 1] THEN least(150, ia + 15) ELSE ia END AS sa, CASE WHEN lb <> lu[b + 1] THEN least(150, ib + 15) ELSE ib END AS sb
    FROM (SELECT m.*, f.r, f.w, f.sd, f.seen, f.lu, f.h1, f.h2, f.r[m.a + 1] + f.w[m.a + 1] AS ba, f.h1[m.a + 1] AS ha, f.h2[m.a + 1] AS ha2, least(150, f.sd[m.a + 1] + 0.8::DOUBLE * greatest(0, floor(coalesce(m.t - f.seen[m.a + 1], 0) / 86400) / 30)) AS ia, f.r[m.b + 1] + f.w[m.b + 1] AS bb, f.h1[m.b + 1] AS hb, f.h2[m.b + 1] AS hb2, least(150, f.sd[m.b + 1] + 0.8::DOUBLE * greatest(0, floor(coalesce(m.t - f.seen[m.b + 1], 0) / 86400) / 30)) AS ib FROM f JOIN m ON m.k = f.k + 1)))))
    SELECT o_orderkey, round(a_mu, 4) AS a_mu, round(b_mu, 4) AS b_mu, round(a_sigma, 4) AS a_sigma, round(b_sigma, 4) AS b_sigma, round(p, 4) AS p FROM f WHERE k > 0""")
def dual_elo_fold(t: Tables) -> DataFrame:
    got = sequential.dual_rating(_matches(t), "t", "o_orderkey", "a", "b", "score", "margin", "inter", "la", "lb", sequential.DualElo(momentum_games=2, momentum_scale=50.0))
    return _rounded(got.drop("a_base", "b_base"), 4)


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, list(DISTINCT l_suppkey::BIGINT) FILTER (WHERE l_linenumber % 2 = 1) AS pa, list(DISTINCT l_suppkey::BIGINT) FILTER (WHERE l_linenumber % 2 = 0) AS pb FROM lineitem GROUP BY ALL),
    m AS MATERIALIZED (SELECT o_orderkey, pa, pb, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS score, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders JOIN l ON l_orderkey = o_orderkey WHERE len(pa) > 0 AND len(pb) > 0),
    f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS o_orderkey, 0.0::DOUBLE AS a_before, 0.0::DOUBLE AS b_before, list_transform(range(0, max(s_suppkey)::BIGINT + 1), lambda i: 1500.0::DOUBLE) AS s FROM supplier
    UNION ALL SELECT k, o_orderkey, ra, rb, CASE WHEN score IS NULL THEN s ELSE list_transform(s, lambda x, i: x + 20 * (score - 1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400))) * (list_contains(pa, i - 1)::INT - list_contains(pb, i - 1)::INT)) END
    FROM (SELECT m.*, f.s, list_avg(list_transform(m.pa, lambda p: f.s[p + 1])) AS ra, list_avg(list_transform(m.pb, lambda p: f.s[p + 1])) AS rb FROM f JOIN m ON m.k = f.k + 1))
    SELECT o_orderkey, round(a_before, 4) AS a_before, round(b_before, 4) AS b_before FROM f WHERE k > 0""")
def lineup_elo_fold(t: Tables) -> DataFrame:
    sides = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey")))).alias("pa"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")))).alias("pb"))
    m = t.orders.join(sides.where("size(pa) > 0 and size(pb) > 0"), F.col("o_orderkey") == F.col("l_orderkey"))
    return _rounded(sequential.lineup_elo(m.select("o_orderkey", epoch_seconds("o_orderdate").alias("t"), "pa", "pb", F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("score")), "t", "o_orderkey", "pa", "pb", "score"), 4)


@query(f"""WITH RECURSIVE u0 AS (SELECT user_id, {T} + (event_id % 5) * 86400.0 AS available, value AS v FROM events WHERE event_type = 'purchase'), u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY available, v) AS k FROM u0),
    f AS (SELECT user_id, available, k, v AS level FROM u WHERE k = 1 UNION ALL SELECT u.user_id, u.available, u.k, 0.9::DOUBLE * level + (1 - 0.9::DOUBLE) * u.v FROM f JOIN u ON u.user_id = f.user_id AND u.k = f.k + 1),
    last AS (SELECT user_id, available, max(k) AS n, arg_max(level, k) AS level FROM f GROUP BY ALL)
    SELECT event_id, round(l.level, 6) AS level, coalesce(l.n, 0) AS n FROM (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'view') e ASOF LEFT JOIN last l ON e.user_id = l.user_id AND e.t > l.available""")
def availability_queue(t: Tables) -> DataFrame:
    e = _events(t)
    updates = e.where("event_type = 'purchase'").select("user_id", "t", (F.col("t") + F.pmod("event_id", F.lit(5)) * 86400.0).alias("available_at"), "value")
    forecasts = e.where("event_type = 'view'").select("event_id", "user_id", "t")
    return sequential.availability_fold(forecasts, updates, "user_id", "t", "available_at", "value").select("event_id", F.round("level", 6).alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_type, coalesce(value, 0) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS applied, 0::BIGINT AS skipped, 100.0::DOUBLE AS gold FROM e
    UNION ALL SELECT f.user_id, e.k, applied + (event_type IN ('purchase', 'click', 'error', 'signup'))::BIGINT, skipped + (event_type NOT IN ('purchase', 'click', 'error', 'signup'))::BIGINT,
    CASE event_type WHEN 'purchase' THEN gold + x WHEN 'click' THEN gold * x WHEN 'error' THEN least(gold, x) WHEN 'signup' THEN x ELSE gold END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, applied, skipped, false AS limit_reached, gold, 0.0::DOUBLE AS shield FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def mechanics_fold(t: Tables) -> DataFrame:
    ev = _events(t).select("user_id", "event_id", "t", F.col("event_type").alias("type"), F.lit("gold").alias("target"), F.col("value").alias("amount"))
    return sequential.event_state(ev, "user_id", ["t", "event_id"], {"purchase": "add", "click": "scale", "error": "cap", "signup": "set"}, {"gold": 100.0, "shield": 0.0})


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN CAST(k AS DOUBLE) / n < 0.7 THEN 'train' WHEN CAST(k AS DOUBLE) / n < 0.8 THEN 'calibrate' WHEN CAST(k AS DOUBLE) / n < 0.85 THEN 'embargo' ELSE 'test' END AS split FROM p""")
def time_split(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderdate")
    return windows.time_split(o, ["o_orderdate", "o_orderkey"], [("train", 0.7), ("calibrate", 0.8), ("embargo", 0.85), ("test", 1.1)]).select("o_orderkey", "split")


@query("""WITH s AS (SELECT l_suppkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY a, l_suppkey) - 1 AS k, count(*) OVER () AS n FROM s), f AS (SELECT unnest(range(1, 5)) AS fold),
    c AS (SELECT fold, min(a) AS cut FROM p, f WHERE CAST(floor(k * 5 / n) AS BIGINT) = fold GROUP BY ALL)
    SELECT CAST(c.fold AS INTEGER) AS fold, l_suppkey, CASE WHEN CAST(floor(k * 5 / n) AS BIGINT) = c.fold THEN 'validate' ELSE 'train' END AS part FROM p, c WHERE CAST(floor(k * 5 / n) AS BIGINT) = c.fold OR (CAST(floor(k * 5 / n) AS BIGINT) < c.fold AND b < cut)""")
def rolling_folds(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    p = windows.global_positions(s, ["a", "l_suppkey"], 8).crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))).withColumn("block", F.expr("position * 5 div n"))
    cuts = p.where("block >= 1").groupBy(F.col("block").cast("int").alias("fold")).agg(F.min("a").alias("cut"))
    return p.join(F.broadcast(cuts), (F.col("block") == F.col("fold")) | ((F.col("block") < F.col("fold")) & (F.col("b") < F.col("cut")))).select("fold", "l_suppkey", F.when(F.col("block") == F.col("fold"), "validate").otherwise("train").alias("part"))


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS now, sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS before FROM orders GROUP BY ALL),
    r AS (SELECT o_custkey, rank() OVER (ORDER BY round(now, 2) DESC) AS now_rank, CASE WHEN before IS NOT NULL THEN rank() OVER (ORDER BY round(before, 2) DESC NULLS LAST) END AS before_rank, now - before AS d FROM s)
    SELECT o_custkey, CAST(now_rank AS BIGINT) AS now_rank, CAST(before_rank AS BIGINT) AS before_rank, CAST(before_rank - now_rank AS BIGINT) AS movement FROM r""")
def rank_movement(t: Tables) -> DataFrame:
    price, early = F.col("o_totalprice"), F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    s = t.orders.groupBy("o_custkey").agg(F.round(F.sum(price), 2).alias("now"), F.round(F.sum(F.when(early, price)), 2).alias("before"))

    def ranks(value: str, out: str) -> DataFrame:
        # Counts of distinct values first, then sums over ranges of values: the rank needs only how many rows are above.
        per = s.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
        return windows.sum_before(per, [F.desc(value)], "_n", "_above").select(value, (F.col("_above") + 1).alias(out))

    out = s.join(ranks("now", "now_rank"), "now").join(ranks("before", "before_rank"), "before", "left")
    return out.select("o_custkey", "now_rank", "before_rank", (F.col("before_rank") - F.col("now_rank")).alias("movement"))


@query("""SELECT c_custkey, CAST(1 + (SELECT count(*) FROM customer o WHERE o.c_nationkey = c.c_nationkey AND o.c_acctbal > c.c_acctbal) AS INTEGER) AS standing FROM customer c""")
def standing_rank(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", windows.standing("c_acctbal", ["c_nationkey"]).alias("standing"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT c_custkey, CASE WHEN k <= 2 THEN 'S' ELSE substr('ABCD', CAST(1 + floor((k - 3) * 4 / (n - 2)) AS INTEGER), 1) END AS bucket FROM r""")
def tier_buckets(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    r = t.customer.select("c_custkey", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    letter = F.substring(F.lit("ABCD"), F.expr("cast(1 + (k - 3) * 4 div (n - 2) as int)"), F.lit(1))
    return r.select("c_custkey", F.when(F.col("k") <= 2, "S").otherwise(letter).alias("bucket"))


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'purchase' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS stack FROM events""")
def state_before_event(t: Tables) -> DataFrame:
    w = windows.prior_rows(["user_id"], ["ts", "event_id"])
    state = F.last(F.when(F.col("event_type") != "purchase", F.col("event_type")), ignorenulls=True).over(w)
    return t.events.select("event_id", state.alias("state"), F.count(F.when(F.col("event_type") == "purchase", 1)).over(w).alias("stack"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), n AS (SELECT *, lead(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS nx FROM d) SELECT l_suppkey, l_orderkey + 1 AS gap_start, nx - 1 AS gap_end FROM n WHERE nx - l_orderkey > 1""")
def sequence_gaps(t: Tables) -> DataFrame:
    return windows.sequence_gaps(t.lineitem, ["l_suppkey"], "l_orderkey")


@query(f"""WITH e AS (SELECT event_id, user_id, {T} AS t, CAST(ts AS DATE) AS d FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0 AND t - lag(t) OVER w <= 21600 AND d = lag(d) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s""")
def gap_sessions(t: Tables) -> DataFrame:
    e = _events(t).withColumn("d", F.col("ts").cast("date"))
    same = F.col("d") == F.lag("d").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return windows.gap_sessions(e, ["user_id"], "t", "event_id", 21600.0, [same]).select("event_id", "session")


@query("""SELECT o_orderkey, CAST(count(*) OVER w AS BIGINT) AS prior_games, round(coalesce(sum(o_totalprice) OVER w, 0), 2) AS prior_total FROM (SELECT *, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def same_ts_batch_prior(t: Tables) -> DataFrame:
    # Per priority and day first: few rows then carry the expanding sums, whatever the number of orders.
    o = t.orders.withColumn("d", F.unix_date(F.col("o_orderdate").cast("date")))
    daily = o.groupBy("o_orderpriority", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    w = windows.prior_times(["o_orderpriority"], "d")
    past = daily.select("o_orderpriority", "d", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("prior_games"), F.round(F.coalesce(F.sum("s").over(w), F.lit(0.0)), 2).alias("prior_total"))
    return o.join(past, ["o_orderpriority", "d"]).select("o_orderkey", "prior_games", "prior_total")


@query("""SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS experience FROM lineitem""")
def pair_experience(t: Tables) -> DataFrame:
    w = windows.prior_rows(["l_suppkey", "l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("experience"))


@query("""SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') DESC) AS k FROM orders) WHERE k <= 20""")
def natural_recent_n(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").cast("date").desc(), natural_key(F.col("o_orderkey").cast("string")).desc())
    return t.orders.withColumn("k", F.row_number().over(w)).where("k <= 20").select("o_custkey", "o_orderkey", "k")


@query("""WITH w AS (SELECT l_suppkey, l_extendedprice AS v, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity AS before FROM lineitem),
    u AS (SELECT l_suppkey, v, least(w, greatest(0, total * 0.25 - before)) AS u FROM w) SELECT l_suppkey, round(sum(u * v) / sum(u), 4) AS tail_mean FROM u GROUP BY l_suppkey""")
def weighted_lower_tail(t: Tables) -> DataFrame:
    return windows.lower_tail_mean(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity", 0.25).select("l_suppkey", F.round("tail_mean", 4).alias("tail_mean"))


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) - DATE '1970-01-01' AS d FROM events), k AS (SELECT DISTINCT event_type, d FROM e), p AS (SELECT k.event_type, k.d, count(b.value) AS n, median(b.value) AS m, quantile_cont(b.value, 0.75) - quantile_cont(b.value, 0.25) AS iqr FROM k LEFT JOIN e b ON k.event_type = b.event_type AND b.d < k.d GROUP BY ALL),
    s AS (SELECT p.event_type, p.d, median(abs(b.value - p.m)) AS mad FROM p JOIN e b ON p.event_type = b.event_type AND b.d < p.d GROUP BY ALL)
    SELECT event_id, round(CASE WHEN n < 30 THEN NULL WHEN mad > 0 THEN (value - m) / (mad * 1.4826) WHEN iqr > 0 THEN (value - m) / (iqr / 1.349) END, 6) AS z FROM e JOIN p USING (event_type, d) LEFT JOIN s USING (event_type, d)""")
def expanding_robust_z(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.unix_date(F.col("ts").cast("date")).alias("d"), "value", "event_id")
    z = windows.expanding_robust_z(e, ["event_type"], "d", "value", 30, ["event_id"])
    return z.select("event_id", F.round("z", 6).alias("z"))
