"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit, shrunk_rate, wilson_lower
from ..operators import aggs
from .registry import Tables, query

#: Customers' orders with their nation; an order of status F counts as won.
ORDERS_SQL = "(SELECT o.*, c_nationkey, n_name, n_regionkey, c_mktsegment FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def orders_wide(t: Tables) -> DataFrame:
    c, n = t.customer, t.nation
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"""SELECT n_name, CAST(count(*) AS BIGINT) AS games, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
    CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS win_rate FROM {ORDERS_SQL} GROUP BY n_name""")
def team_record(t: Tables) -> DataFrame:
    return aggs.record(orders_wide(t), ["n_name"], F.col("o_orderstatus") == "F")


@query(f"""WITH o AS {ORDERS_SQL}, g AS (SELECT n_name, c_mktsegment, o_orderpriority, grouping(c_mktsegment) AS gs, grouping(o_orderpriority) AS gp, count(*) AS games, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS wins
    FROM o GROUP BY GROUPING SETS ((n_name), (n_name, c_mktsegment), (n_name, o_orderpriority)))
    SELECT n_name, CASE WHEN gs = 0 THEN 'c_mktsegment' WHEN gp = 0 THEN 'o_orderpriority' ELSE 'total' END AS grain, CASE WHEN gs = 0 THEN c_mktsegment WHEN gp = 0 THEN o_orderpriority ELSE '' END AS value,
    CAST(games AS BIGINT) AS games, CAST(wins AS BIGINT) AS wins FROM g""")
def team_record_grouping_sets(t: Tables) -> DataFrame:
    return aggs.record_by_grains(orders_wide(t), "n_name", ["c_mktsegment", "o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c)
    SELECT o_custkey, o_orderpriority, CAST(n AS BIGINT) AS n FROM k WHERE k = 1""")
def primary_mode_value(t: Tables) -> DataFrame:
    return aggs.most_common(t.orders, ["o_custkey"], "o_orderpriority")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_affiliation(t: Tables) -> DataFrame:
    return aggs.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks,
    round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 6) AS spent FROM events GROUP BY user_id HAVING count(*) >= 2""")
def conditional_aggs(t: Tables) -> DataFrame:
    is_ = lambda v: F.col("event_type") == v
    out = t.events.groupBy("user_id").agg(F.count_if(is_("purchase")).alias("purchases"), F.count_if(is_("click")).alias("clicks"), F.round(F.coalesce(F.sum(F.when(is_("purchase"), F.col("value"))), F.lit(0.0)), 6).alias("spent"), F.count(F.lit(1)).alias("_n"))
    return out.where("_n >= 2").drop("_n")


@query("""SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders FROM lineitem GROUP BY l_suppkey""")
def distinct_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("""SELECT (SELECT string_agg(p_brand, '|' ORDER BY p_brand) FROM (SELECT DISTINCT p_brand FROM part)) AS brands, (SELECT string_agg(p_type, '|' ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM part)) AS types,
    (SELECT min(p_size) FROM part) AS min_size, (SELECT max(p_size) FROM part) AS max_size""")
def facets_sorted(t: Tables) -> DataFrame:
    p = t.part
    return p.agg(aggs.sorted_facets(p, "p_brand").alias("brands"), aggs.sorted_facets(p, "p_type").alias("types"), F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"))


@query("""SELECT l_orderkey, sha256(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR))) AS lineup FROM lineitem GROUP BY l_orderkey""")
def lineup_hash(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(aggs.set_hash(F.col("l_partkey").cast("string")).alias("lineup"))


@query("""WITH m AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS med, avg(c_acctbal) AS mean FROM customer GROUP BY ALL)
    SELECT c_custkey, round(abs(c_acctbal - med), 6) AS from_median, round(abs(c_acctbal - mean), 6) AS from_mean FROM customer JOIN m USING (c_mktsegment)""")
def pct_cont_distance(t: Tables) -> DataFrame:
    m = t.customer.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("med"), F.avg("c_acctbal").alias("mean"))
    d = lambda c: F.round(F.abs(F.col("c_acctbal") - F.col(c)), 6)
    return t.customer.join(m, "c_mktsegment").select("c_custkey", d("med").alias("from_median"), d("mean").alias("from_mean"))


@query("""SELECT l_returnflag, quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.25) AS q25 FROM lineitem GROUP BY l_returnflag""")
def nearest_rank_quantile(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(aggs.nearest_rank("l_extendedprice", 0.1).alias("p10"), aggs.nearest_rank("l_extendedprice", 0.9).alias("p90"), F.percentile("l_extendedprice", F.lit(0.25)).alias("q25"))


@query("""WITH m AS (SELECT l_suppkey, count(*) AS n, median(l_extendedprice) AS center, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY ALL),
    d AS (SELECT l_suppkey, median(abs(l_extendedprice - center)) AS mad FROM lineitem JOIN m USING (l_suppkey) GROUP BY ALL)
    SELECT l_suppkey, CAST(n AS BIGINT) AS n, round(center, 6) AS center, round(CASE WHEN n < 5 THEN NULL WHEN mad > 0 THEN mad * 1.4826 WHEN iqr > 0 THEN iqr / 1.349 END, 6) AS scale FROM m JOIN d USING (l_suppkey)""")
def mad_scale(t: Tables) -> DataFrame:
    return aggs.median_mad(t.lineitem, ["l_suppkey"], "l_extendedprice", 5).select("l_suppkey", "n", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query("""SELECT l_orderkey, CASE WHEN count(*) = 4 AND count(l_quantity) = 4 THEN sum(l_quantity) END AS quantity FROM lineitem GROUP BY l_orderkey""")
def complete_side_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(aggs.complete_sum("l_quantity", 4).alias("quantity"))


@query("""WITH e AS (SELECT c_nationkey AS team, l_discount - l_tax AS edge FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT s_nationkey, -(l_discount - l_tax) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT team, CAST(count(*) AS BIGINT) AS n, round(avg(edge), 6) AS mean_edge, round(max(edge), 6) AS best, round(min(edge), 6) AS worst, round(avg(CASE WHEN edge > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM e GROUP BY team""")
def signed_double_accumulation(t: Tables) -> DataFrame:
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = t.lineitem.select("l_orderkey", "l_suppkey", (F.col("l_discount") - F.col("l_tax")).alias("edge")).join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = aggs.two_sided(rows, "c_nationkey", "s_nationkey", "edge")
    r = lambda c: F.round(c, 6)
    return e.groupBy("team").agg(F.count(F.lit(1)).alias("n"), r(F.avg("edge")).alias("mean_edge"), r(F.max("edge")).alias("best"), r(F.min("edge")).alias("worst"), r(F.avg((F.col("edge") > 0).cast("double"))).alias("positive"))


@query("""SELECT * FROM (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchase, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS view FROM events GROUP BY user_id) WHERE click > 0 AND purchase > 0""")
def role_pivot_complete(t: Tables) -> DataFrame:
    wide = t.events.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).count()
    return wide.fillna(0, ["click", "purchase", "view"]).where("click > 0 and purchase > 0")


@query("""SELECT CAST(floor(l_quantity / 5) * 5 AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def hist_width5(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.floor(F.col("l_quantity") / 5) * 5).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT quantile_cont(p_retailprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM part)
    SELECT CASE WHEN p_retailprice <= e[2] THEN 0 WHEN p_retailprice <= e[3] THEN 1 WHEN p_retailprice <= e[4] THEN 2 WHEN p_retailprice <= e[5] THEN 3 ELSE 4 END AS bin, CAST(count(*) AS BIGINT) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part, q GROUP BY 1""")
def qcut_bins(t: Tables) -> DataFrame:
    b = aggs.right_closed_bin("p_retailprice", aggs.quantile_edges(t.part, "p_retailprice", 5))
    return t.part.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""SELECT CASE WHEN l_quantity < 0 OR l_quantity > 50 THEN NULL WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def edge_cut(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(aggs.right_closed_bin("l_quantity", [0, 10, 25, 50]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL), m AS (SELECT c_mktsegment, count(*) AS n, avg(orders) AS mean, var_samp(orders) AS variance FROM n GROUP BY ALL)
    SELECT c_mktsegment, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(variance, 6) AS variance, round(CASE WHEN variance > mean THEN mean * mean / (variance - mean) END, 6) AS size FROM m""")
def nb_moment_fit(t: Tables) -> DataFrame:
    n = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment", "c_custkey").agg(F.count("o_orderkey").alias("orders"))
    m = aggs.moments_fit(n, ["c_mktsegment"], "orders")
    return m.select("c_mktsegment", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "size")])


@query("""WITH e AS (SELECT s_nationkey AS a, c_nationkey AS b, l_quantity AS x, l_linenumber AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT least(a, b) AS first, greatest(a, b) AS second, CAST(count(*) AS BIGINT) AS games, CAST(sum(CASE WHEN a > b THEN y ELSE x END) AS DOUBLE) AS first_value, CAST(sum(CASE WHEN a > b THEN x ELSE y END) AS DOUBLE) AS second_value FROM e GROUP BY 1, 2""")
def pair_h2h(t: Tables) -> DataFrame:
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("b"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("a"))
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("l_orderkey") == F.col("o_orderkey"))
    return aggs.head_to_head(rows, "a", "b", "x", "y")


@query("""WITH u AS (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS w, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id)
    SELECT user_id, round((w + 0.2 * 20) / (n + 20), 6) AS shrunk, round((w / n + 3.8416 / (2 * n) - 1.96 * sqrt((w / n * (1 - w / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS wilson FROM u""")
def shrunk_rate_wilson(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("w"), F.count(F.lit(1)).alias("n"))
    return u.select("user_id", F.round(shrunk_rate("w", "n", 0.2, 20), 6).alias("shrunk"), F.round(wilson_lower("w", "n"), 6).alias("wilson"))


@query("""SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", CAST(count(*) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(l_quantity, l_tax), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', count(*), round(corr(l_extendedprice, l_tax), 6) FROM lineitem
    UNION ALL SELECT 'l_discount', 'l_tax', count(*), round(corr(l_discount, l_tax), 6) FROM lineitem""")
def corr_edges(t: Tables) -> DataFrame:
    return aggs.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("r", F.round("r", 6))


@query("""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c""")
def partial_corr(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(aggs.partial_correlation("l_quantity", "l_extendedprice", "l_discount"), 6).alias("r"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS games, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS wins FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CAST(games AS BIGINT) AS games, CAST(wins AS BIGINT) AS wins, CASE WHEN 2 * wins > games THEN 'won' WHEN 2 * wins < games THEN 'lost' ELSE 'unresolved' END AS outcome FROM s""")
def series_majority(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("l_returnflag") == "R").alias("wins"))
    return s.withColumn("outcome", F.when(F.col("wins") * 2 > F.col("games"), "won").when(F.col("wins") * 2 < F.col("games"), "lost").otherwise("unresolved"))


@query("""SELECT o_custkey, round(sum(exp(-date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) / 180.0)), 6) AS weight FROM orders GROUP BY o_custkey""")
def decay_weight(t: Tables) -> DataFrame:
    last = t.orders.agg(F.max("o_orderdate").cast("date").alias("_last"))
    w = F.exp(-F.datediff("_last", F.col("o_orderdate").cast("date")) / F.lit(180.0))
    return t.orders.crossJoin(F.broadcast(last)).groupBy("o_custkey").agg(F.round(F.sum(w), 6).alias("weight"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS nl, count(DISTINCT l_partkey) AS np, count(DISTINCT l_returnflag) AS nf, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
    e AS (SELECT CASE WHEN NOT n BETWEEN 2 AND 6 THEN 'row_count' WHEN nl <> n THEN 'schema' WHEN np <> n THEN 'parts' WHEN nf < 2 THEN 'flags' WHEN NOT q > 1 THEN 'quantity' ELSE 'accepted' END AS reason FROM g)
    SELECT reason, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY reason""")
def identity_error_ladder(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("nl"), F.count_distinct("l_partkey").alias("np"), F.count_distinct("l_returnflag").alias("nf"), F.min("l_quantity").alias("q"))
    reason = aggs.first_failing([("row_count", F.col("n").between(2, 6)), ("schema", F.col("nl") == F.col("n")), ("parts", F.col("np") == F.col("n")), ("flags", F.col("nf") >= 2), ("quantity", F.col("q") > 1)])
    return g.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY l_orderkey""")
def single_or_null(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(aggs.single_or_null("l_returnflag").alias("flag"))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, floor(sum(l_linenumber) / 2) AS m FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(max(m) AS BIGINT) AS tier_games FROM a GROUP BY l_suppkey""")
def role_max_of_sums(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.floor(F.sum("l_linenumber") / 2).alias("m"))
    return a.groupBy("l_suppkey").agg(F.max("m").cast("long").alias("tier_games"))


@query(f"""SELECT n_name, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS wr FROM {ORDERS_SQL} GROUP BY ALL HAVING count(*) >= 80""")
def wr_table(t: Tables) -> DataFrame:
    g = orders_wide(t).groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("wr"))
    return g.where("n >= 80")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM lineitem), g AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem),
    c AS (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS qb, CASE WHEN l_extendedprice <= e[2] THEN 0 WHEN l_extendedprice <= e[3] THEN 1 WHEN l_extendedprice <= e[4] THEN 2 WHEN l_extendedprice <= e[5] THEN 3 ELSE 4 END AS pb, l_returnflag FROM lineitem, q),
    x AS (SELECT qb, pb, count(*) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM c GROUP BY ALL HAVING count(*) >= 40)
    SELECT qb, pb, CAST(n AS BIGINT) AS n, round(r, 6) AS rate, round(ln(greatest(1e-6, least(1 - 1e-6, r)) / (1 - greatest(1e-6, least(1 - 1e-6, r)))) - ln(p / (1 - p)), 6) AS delta FROM x, g""")
def empirical_grid(t: Tables) -> DataFrame:
    edges = aggs.quantile_edges(t.lineitem, "l_extendedprice", 5)
    won = (F.col("l_returnflag") == "R").cast("double")
    overall = t.lineitem.agg(F.avg(won).alias("_p"))
    g = t.lineitem.groupBy(aggs.right_closed_bin("l_quantity", [0, 10, 25, 1e9]).alias("qb"), aggs.right_closed_bin("l_extendedprice", edges).alias("pb")).agg(F.count(F.lit(1)).alias("n"), F.avg(won).alias("r"))
    return g.where("n >= 40").crossJoin(F.broadcast(overall)).select("qb", "pb", "n", F.round("r", 6).alias("rate"), F.round(logit("r") - logit("_p"), 6).alias("delta"))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, l_quantity / greatest(1, sum(l_quantity) OVER (PARTITION BY l_orderkey)) AS share FROM lineitem)
    SELECT l_returnflag, round(avg(share), 6) AS mean_share, round(stddev_samp(share), 6) AS sd_share FROM s GROUP BY l_returnflag""")
def group_share(t: Tables) -> DataFrame:
    s = t.lineitem.select("l_returnflag", aggs.share_of("l_quantity", ["l_orderkey"]).alias("share"))
    return s.groupBy("l_returnflag").agg(F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.stddev_samp("share"), 6).alias("sd_share"))


@query("""SELECT l_suppkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') >= 8 AND count(*) FILTER (WHERE l_returnflag <> 'R') >= 8 THEN
    round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R') - avg(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 6) END AS conversion FROM lineitem GROUP BY l_suppkey""")
def win_loss_contrast(t: Tables) -> DataFrame:
    won = F.col("l_returnflag") == "R"
    q = F.col("l_quantity")
    value = F.when((F.count_if(won) >= 8) & (F.count_if(~won) >= 8), F.round(F.avg(F.when(won, q)) - F.avg(F.when(~won, q)), 6))
    return t.lineitem.groupBy("l_suppkey").agg(value.alias("conversion"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), s AS (SELECT sum(1.0 / n) AS total, count(*) AS rows FROM g)
    SELECT l_orderkey, l_linenumber, round(rows / total / n, 6) AS weight FROM g, s""")
def equal_group_weights(t: Tables) -> DataFrame:
    return aggs.equal_weights(t.lineitem, ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, sum(l_quantity * l_discount) AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(sum(v) / nullif(sum(w), 0), 6) AS weighted_discount FROM s GROUP BY l_suppkey""")
def weighted_mean_scopes(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum(F.col("l_quantity") * F.col("l_discount")).alias("v"), F.sum("l_quantity").alias("w"))
    return s.groupBy("l_suppkey").agg(F.round(F.sum("v") / F.nullif(F.sum("w"), F.lit(0)), 6).alias("weighted_discount"))


@query("""SELECT c_custkey, (c_acctbal + c_nationkey) / 2 AS strict_mean FROM customer""")
def row_mean_strict(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ((F.col("c_acctbal") + F.col("c_nationkey")) / 2).alias("strict_mean"))


@query("""WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS games, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS wins, avg(l_quantity) AS k FROM lineitem GROUP BY ALL)
    SELECT l_partkey, l_suppkey, CAST(games AS BIGINT) AS games, CAST(wins AS BIGINT) AS wins, round(k, 6) AS mean_quantity, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY games DESC, wins DESC, l_partkey) AS INTEGER) AS place FROM g""")
def pair_records(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("l_returnflag") == "R").alias("wins"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("games"), F.desc("wins"), "l_partkey")))


@query("""WITH a AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY ALL) SELECT roles, CAST(count(*) AS BIGINT) AS n, max(last_turn) AS last_turn FROM a GROUP BY roles""")
def ordered_array_agg(t: Tables) -> DataFrame:
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    a = t.conversations.groupBy("conv_id").agg(roles.alias("roles"), F.max("turn").alias("last_turn"))
    return a.groupBy("roles").agg(F.count(F.lit(1)).alias("n"), F.max("last_turn").alias("last_turn"))
