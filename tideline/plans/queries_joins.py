"""Join, set, change and nesting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entity_key, epoch_seconds, jaccard
from ..operators import aggs, cdc, graph, joins
from .registry import Tables, query

EPOCH = "(epoch_us({0}) / 1000000.0)"


def _epoch(name: str) -> str:
    return EPOCH.format(name)


@query("""SELECT l_orderkey, r.l_extendedprice AS r_price, n.l_extendedprice AS n_price FROM (SELECT l_orderkey, l_extendedprice FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem) WHERE l_returnflag = 'R' AND c = 1) r
    JOIN (SELECT l_orderkey, l_extendedprice FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem) WHERE l_returnflag = 'N' AND c = 1) n USING (l_orderkey)""")
def side_pivot_join(t: Tables) -> DataFrame:
    once = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"), F.first("l_extendedprice").alias("price")).where("c = 1").drop("c")
    return joins.sides_wide(once, "l_orderkey", "l_returnflag", "R", "N")


@query("""WITH u AS (SELECT o_orderkey, o_custkey, 'primary' AS origin, 0 AS k FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'supplement', 1 FROM orders WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey, o_custkey, origin FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS n FROM u) WHERE n = 1""")
def source_precedence_merge(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey")
    a = o.where("o_orderkey % 3 <> 0").withColumn("origin", F.lit("primary"))
    b = o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("supplement"))
    return joins.precedence_merge([a, b], ["o_orderkey"], ["o_custkey"])


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_wins_dedup(t: Tables) -> DataFrame:
    return aggs.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query(f"""WITH l AS (SELECT event_id, user_id, {_epoch('ts')} AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, {_epoch('ts')} AS rt, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL),
    j AS (SELECT l.event_id, click_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(t - rt), rt) AS n FROM l JOIN r ON l.user_id = r.user_id AND abs(t - rt) <= 64800)
    SELECT l.event_id, j.click_id FROM l LEFT JOIN j ON l.event_id = j.event_id AND n = 1""")
def asof_nearest_tolerance(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", epoch_seconds("ts"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("click_id"))
    return joins.asof_nearest(left, right, ["user_id"], "t", "rt", 64800.0, ["click_id"], ["click_id"]).select("event_id", "click_id")


@query("""WITH b AS (SELECT DISTINCT date_trunc('month', ts) AS m FROM events), iv AS (SELECT CAST(m AS DATE) AS s, CAST(m + INTERVAL 40 DAY AS DATE) AS e, strftime(m, '%Y-%m') AS token FROM b),
    h AS (SELECT event_id, count(*) AS n, min(token) AS token FROM events JOIN iv ON CAST(ts AS DATE) BETWEEN s AND e GROUP BY ALL)
    SELECT x.event_id, CAST(coalesce(n, 0) AS BIGINT) AS match_count, CASE WHEN n = 1 THEN token END AS token FROM events x LEFT JOIN h ON x.event_id = h.event_id""")
def interval_containment(t: Tables) -> DataFrame:
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    months = t.events.select(F.date_trunc("month", F.col("ts").cast("timestamp")).alias("m")).distinct()
    iv = months.select(day("m").alias("s"), (day("m") + 40).alias("e"), F.date_format("m", "yyyy-MM").alias("token"), F.lit("all").alias("g"))
    p = t.events.select("event_id", day("ts").alias("d"), F.lit("all").alias("g"))
    return joins.interval_lookup(p, iv, ["g"], "d", "s", "e", ["token"], ["event_id"], 7.0).select("event_id", "match_count", "token")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS s, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS e FROM orders),
    a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey DESC) AS n FROM h WHERE s <= DATE '1996-06-30' AND (e IS NULL OR e >= DATE '1996-06-30')) SELECT o_custkey, o_orderkey, o_orderstatus FROM a WHERE n = 1""")
def scd2_asof(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    h = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("s"), F.lead("o_orderdate").over(w).cast("date").alias("e"))
    valid = joins.valid_as_of(h, F.lit("1996-06-30").cast("date"), "s", "e")
    return aggs.latest(valid, ["o_custkey"], [F.desc("s"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left_only' WHEN a.o_orderkey IS NULL THEN 'right_only' ELSE 'both' END AS "_merge"
    FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) b ON a.o_orderkey = b.o_orderkey""")
def validated_outer_join(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey")
    return joins.validated_join(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0"), ["o_orderkey"], "full", "one_to_one")


@query("""WITH req AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) || ' ' ELSE replace(n_name, '_', '-') || '!' END AS asked FROM nation)
    SELECT asked, coalesce(e.n_nationkey, a.n_nationkey, k.n_nationkey) AS resolved_id FROM req LEFT JOIN nation e ON asked = e.n_name LEFT JOIN nation a ON lower(trim(asked)) = lower(a.n_name)
    LEFT JOIN nation k ON regexp_replace(lower(asked), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(k.n_name), '[^a-z0-9]+', '', 'g')""")
def alias_resolution(t: Tables) -> DataFrame:
    n = t.nation
    asked = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).otherwise(F.concat(F.replace(F.col("n_name"), F.lit("_"), F.lit("-")), F.lit("!")))
    look = lambda c: n.select(c.alias("lookup"), F.col("n_nationkey").alias("id"))
    req = n.select(asked.alias("asked"))
    return joins.resolve_names(req, "asked", look(F.col("n_name")), look(F.lower("n_name")), look(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", ""))).select("asked", "resolved_id")


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM nation n JOIN region r ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name IN ('ASIA', 'EUROPE'))""")
def exists_resolution(t: Tables) -> DataFrame:
    ids = t.nation.join(F.broadcast(t.region.where(F.col("r_name").isin("ASIA", "EUROPE"))), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(F.broadcast(ids), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def anti_changed_ids(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON c_custkey = o_custkey AND n = 1""")
def lateral_top1(t: Tables) -> DataFrame:
    best = aggs.latest(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return t.customer.join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query(f"""WITH e AS (SELECT *, {_epoch('ts')} AS t FROM events) SELECT event_id, EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_type = 'error' AND abs(o.t - e.t) <= 86400 AND sqrt(pow(o.value - e.value, 2)) <= 50) AS contested FROM e WHERE event_type = 'purchase'""")
def contested_window(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", epoch_seconds("ts")).select("event_id", "user_id", "event_type", "t", "value")
    other = e.where("event_type = 'error'").select("user_id", "t", "value")
    out = joins.near_event_flag(e.where("event_type = 'purchase'"), other, ["user_id"], "t", ["event_id"], 86400.0, F.abs(F.col("o_value") - F.col("value")) <= 50)
    return out.select("event_id", "contested")


@query(f"""WITH e AS (SELECT *, {_epoch('ts')} AS t FROM events), c AS (SELECT DISTINCT user_id, floor(t / 604800) * 604800 AS at FROM e)
    SELECT c.user_id, CAST(c.at AS BIGINT) AS at, (SELECT arg_max(event_id, (t, event_id)) FROM e WHERE e.user_id = c.user_id AND e.t <= c.at) AS event_id FROM c""")
def checkpoint_state(t: Tables) -> DataFrame:
    e = t.events.withColumn("t", epoch_seconds("ts"))
    checks = e.select("user_id", (F.floor(F.col("t") / 604800) * 604800).cast("double").alias("t")).distinct().withColumn("at", F.col("t").cast("long"))
    states = e.groupBy("user_id", "t").agg(F.max("event_id").alias("event_id"))
    return joins.asof_backward(checks, states, ["user_id"], "t", ["event_id"]).select("user_id", "at", "event_id")


@query("""WITH b AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), c AS (SELECT m, CAST(last - to_months(m) AS DATE) AS cut FROM b, (VALUES (0), (1), (3), (12)) v(m))
    SELECT o_custkey, CAST(m AS INTEGER) AS months_back, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN c ON CAST(o_orderdate AS DATE) <= cut GROUP BY ALL""")
def calendar_snapshots(t: Tables) -> DataFrame:
    last = t.orders.agg(F.max("o_orderdate").cast("date").alias("last"))
    cuts = last.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.add_months("last", -m).alias("cut")) for m in (0, 1, 3, 12)])).alias("c")).select("c.m", "c.cut")
    # One pass: each order counts for every cut-off on or after its day.
    rows = t.orders.select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("d"))
    hit = rows.join(F.broadcast(cuts), F.col("d") <= F.col("cut"))
    return hit.groupBy("o_custkey", F.col("m").alias("months_back")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_custkey AS id FROM orders UNION SELECT s_suppkey FROM supplier""")
def union_distinct_entities(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).union(t.supplier.select("s_suppkey")).distinct()


@query("""SELECT 'only_customers' AS part, c_custkey AS id FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def set_diff_ids(t: Tables) -> DataFrame:
    c, o = t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")).distinct()
    flagged = c.distinct().join(o.withColumn("_o", F.lit(1)), "id", "left")
    return flagged.select(F.when(F.col("_o").isNull(), "only_customers").otherwise("both").alias("part"), "id")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'stale' WHEN o.o_orderstatus = n.o_orderstatus AND o.o_totalprice = n.o_totalprice THEN 'unchanged' ELSE 'corrected' END AS status FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def cdc_status(t: Tables) -> DataFrame:
    o, n = _versions(t)
    return cdc.change_status(o, n, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return base.where("o_orderkey % 7 <> 0"), base.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0""")
def cdc_apply(t: Tables) -> DataFrame:
    o, n = _versions(t)
    return cdc.apply_changes(o, n, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""WITH l AS (SELECT CAST(n_nationkey AS VARCHAR) || ':' || sha256(list_aggregate(list_transform([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)], lambda v: CAST(octet_length(encode(v)) AS VARCHAR) || ':' || v), 'string_agg', '')) AS line FROM nation)
    SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(sum(octet_length(encode(line))) AS BIGINT) AS byte_count, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l""")
def dataset_digest(t: Tables) -> DataFrame:
    return cdc.dataset_digest(t.nation, "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM v WHERE n = 1""")
def current_versions(t: Tables) -> DataFrame:
    return cdc.current_versions(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, min(l_linestatus) AS m, count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY ALL), x AS (SELECT l_suppkey, l_returnflag, CASE WHEN d = 1 THEN m END AS team FROM s)
    SELECT a.l_suppkey, a.l_returnflag, CASE WHEN count(b.l_returnflag) = 1 THEN min(b.team) END AS opponent FROM x a LEFT JOIN x b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag <> b.l_returnflag GROUP BY ALL""")
def opponent_join(t: Tables) -> DataFrame:
    return joins.opponents(t.lineitem, "l_suppkey", "l_returnflag", "l_linestatus")


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS a, count(*) OVER (PARTITION BY l_partkey) AS b FROM p)
    SELECT l_suppkey, l_partkey, CASE WHEN a = 1 AND b = 1 THEN 'unique' ELSE 'conflict' END AS status FROM c""")
def id_crosswalk(t: Tables) -> DataFrame:
    return joins.crosswalk(t.lineitem, "l_suppkey", "l_partkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 10000000 + l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_discount >= 0.095),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS label FROM r GROUP BY node""")
def player_components(t: Tables) -> DataFrame:
    # A customer and a supplier are linked by a large order at full discount that was sent back.
    strong = t.lineitem.where("l_returnflag = 'R' and l_quantity >= 45 and l_discount >= 0.095").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.components(strong.select(F.col("o_custkey").alias("a"), (F.lit(10000000) + F.col("l_suppkey")).alias("b")))


@query("""WITH r AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY ALL), c AS (SELECT c_custkey AS k, c_mktsegment FROM customer), s AS (SELECT s_suppkey AS k, s_name FROM supplier)
    SELECT coalesce(r.k, c.k, s.k) AS k, CAST(orders AS BIGINT) AS orders, c_mktsegment, s_name FROM r FULL JOIN c ON r.k = c.k FULL JOIN s ON coalesce(r.k, c.k) = s.k""")
def full_outer_merge(t: Tables) -> DataFrame:
    r = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    c, s = t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"), t.supplier.select(F.col("s_suppkey").alias("k"), "s_name")
    return joins.full_outer({"record": r, "customer": c, "supplier": s}, "k")


@query("""WITH n AS (SELECT o_custkey AS c, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders GROUP BY ALL)
    SELECT a.c AS left_id, b.c AS right_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM n a, n b""")
def jaccard_similarity_matrix(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    return joins.set_similarities(n, n, "id", "s").select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT e.vec_id, r.vec_id AS ref, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, r WHERE e.vec_id % 50 <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ref) AS k FROM s) SELECT vec_id, ref, score FROM n WHERE k = 1""")
def embedding_nearest(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    refs = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("ref"), F.col("v").alias("rv"))
    score = F.round(F.aggregate(F.zip_with("v", "rv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
    # Every query row against all others: Spark broadcasts the queries only below its size threshold, else it multiplies partitions.
    hit = e.where("vec_id % 50 <> 0").crossJoin(refs).select("vec_id", "ref", score.alias("score"))
    best = hit.groupBy("vec_id").agg(F.max_by(F.struct("ref", "score"), F.struct("score", -F.col("ref"))).alias("b"))
    return best.select("vec_id", "b.ref", "b.score")


@query("""WITH p AS (SELECT c_nationkey AS k, c_mktsegment AS m, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT k, sum(n) AS s FROM p GROUP BY ALL), o AS (SELECT m, sum(n) AS n FROM p GROUP BY ALL), g AS (SELECT sum(n) AS s FROM o)
    SELECT k, round(sum(sqrt(p.n / t.s * (o.n / g.s))), 6) AS overlap FROM p JOIN t USING (k) JOIN o USING (m), g GROUP BY k""")
def structural_overlap(t: Tables) -> DataFrame:
    p = t.customer.groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    own = p.groupBy("k").agg(F.sum("n").alias("s"))
    overall = p.groupBy("m").agg(F.sum("n").alias("o")).crossJoin(F.broadcast(p.agg(F.sum("n").alias("g"))))
    both = p.join(own, "k").join(overall, "m")
    return both.groupBy("k").agg(F.round(F.sum(F.sqrt(F.col("n") / F.col("s") * (F.col("o") / F.col("g")))), 6).alias("overlap"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN '{"id":' || event_id || '}' ELSE '{"id":' || event_id || ',"kind":"' || event_type || '"}' END AS doc FROM events""")
def json_extract_build(t: Tables) -> DataFrame:
    from ..functions.jsons import build

    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), build(id=F.col("event_id"), kind=kind).alias("doc"))


@query("""WITH v AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') AS k FROM part), w AS (SELECT p_partkey, trim(k) AS k FROM v), c AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w)
    SELECT p_partkey, CASE WHEN n > 1 THEN k || '#' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) ELSE k END AS search_key FROM c""")
def search_key_disambiguation(t: Tables) -> DataFrame:
    k = t.part.select("p_partkey", entity_key("p_name").alias("k"))
    n = F.count(F.lit(1)).over(Window.partitionBy("k"))
    return k.select("p_partkey", F.when(n > 1, F.concat("k", F.lit("#"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 8))).otherwise(F.col("k")).alias("search_key"))
