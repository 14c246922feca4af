"""Model, evaluation and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, metrics
from ..storage import scratch_path
from ..streaming import events as stream
from .queries_windows import MATCHES_SQL, _matches
from .registry import Tables, query

SCORED_SQL = "(SELECT d.doc_id, l.quality AS y, least(0.99, greatest(0.01, n_chars / 5000.0)) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(t: Tables) -> DataFrame:
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0))
    return t.documents.select("doc_id", p.alias("p")).join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM {SCORED_SQL}""")
def log_loss_brier(t: Tables) -> DataFrame:
    return metrics.probability_scores(_scored(t), "y", "p").select("n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query(f"""WITH b AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM {SCORED_SQL} GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b""")
def calibration_error(t: Tables) -> DataFrame:
    return metrics.calibration_error(_scored(t), "y", "p").select(F.round("ece", 6).alias("ece"))


@query(f"""WITH s AS {SCORED_SQL} SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 6) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0""")
def auc_pairwise(t: Tables) -> DataFrame:
    return metrics.auc(_scored(t), "y", "p").select(F.round("auc", 6).alias("auc"))


@query()
def cluster_bootstrap(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.length("text").cast("double").alias("v"))
    return metrics.cluster_bootstrap(rows, "conv_id", "v")


@query("""WITH s AS (SELECT conv_id, avg(CASE WHEN length(text) <= 300 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS maps FROM conversations GROUP BY ALL), w AS (SELECT share, maps / sum(maps) OVER () AS w FROM s)
    SELECT round(sum(w * share), 6) AS share, round(sqrt(ln(2 / 0.05) * sum(w * w) / 2), 6) AS half_width FROM w""")
def cluster_cdf(t: Tables) -> DataFrame:
    s = t.conversations.groupBy("conv_id").agg(F.avg((F.length("text") <= 300).cast("double")).alias("share"), F.count(F.lit(1)).alias("maps"))
    a = s.agg(F.sum(F.col("maps") * F.col("share")).alias("v"), F.sum("maps").alias("w"), F.sum(F.col("maps") * F.col("maps")).alias("q"))
    return a.select(F.round(F.col("v") / F.col("w"), 6).alias("share"), F.round(F.sqrt(F.log(F.lit(2 / 0.05)) * F.col("q") / (F.col("w") * F.col("w")) / 2), 6).alias("half_width"))


@query("""SELECT round(avg(CASE WHEN y = (p >= 0.5)::INT THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM """ + SCORED_SQL + """ WHERE abs(p - 0.5) >= (SELECT quantile_cont(abs(p - 0.5), 0.4) FROM """ + SCORED_SQL + """))""")
def selective_threshold(t: Tables) -> DataFrame:
    s = _scored(t).withColumn("c", F.abs(F.col("p") - 0.5))
    cut = s.agg(F.percentile("c", F.lit(0.4)).alias("cut"))
    kept = s.crossJoin(F.broadcast(cut)).where("c >= cut")
    return kept.agg(F.round(F.avg((F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, count(*) AS n FROM lineitem), b AS (SELECT *, (xy - x * y / n) / (xx - x * x / n + 10000) AS slope FROM a)
    SELECT 'l_quantity' AS name, round(slope, 4) AS coefficient FROM b UNION ALL SELECT 'intercept', round((y - slope * x) / n, 4) FROM b""")
def ridge_fit(t: Tables) -> DataFrame:
    got = metrics.ridge_normal_equations(t.lineitem, ["l_quantity"], "l_extendedprice", 10000.0)
    return t.spark.createDataFrame(list(got.items()), "name string, coefficient double").withColumn("coefficient", F.round("coefficient", 4))


@query(f"""WITH RECURSIVE {MATCHES_SQL}, g AS (SELECT a, b, count(*)::DOUBLE AS n, sum(score) AS s FROM m WHERE score IS NOT NULL GROUP BY ALL), e AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT a AS x FROM g UNION SELECT b FROM g)),
    p AS MATERIALIZED (SELECT ea.i AS a, eb.i AS b, n, s FROM g JOIN e ea ON ea.x = g.a JOIN e eb ON eb.x = g.b),
    f AS (SELECT 0 AS k, list_transform(range(0, count(*) + 1), lambda i: 0.0::DOUBLE) AS v, 1.0::DOUBLE AS moved FROM e
    UNION ALL SELECT k + 1, list(CASE WHEN i = 0 THEN old - step ELSE greatest(-8, least(8, old - step)) END ORDER BY i), max(abs(step)) FROM (SELECT k, i, v[i + 1] AS old, (sum(d) + CASE WHEN i = 0 THEN 0.1::DOUBLE ELSE 1 END * v[i + 1]) / (sum(h) + CASE WHEN i = 0 THEN 0.1::DOUBLE ELSE 1 END) AS step
    FROM (SELECT k, v, unnest([0, a, b]) AS i, unnest([d, d, -d]) AS d, unnest([h, 2 * h, 2 * h]) AS h FROM (SELECT k, v, a, b, n * q - s AS d, n * q * (1 - q) AS h FROM (SELECT k, v, a, b, n, s, 1 / (1 + exp(-(v[a + 1] - v[b + 1] + v[1]))) AS q FROM f, p WHERE k < 100 AND moved >= 1e-10))) GROUP BY k, v, i) GROUP BY k)
    SELECT x AS entity, round(v[i + 1], 6) AS rating FROM e, (SELECT v FROM f ORDER BY k DESC LIMIT 1)""")
def bradley_terry_fit(t: Tables) -> DataFrame:
    return metrics.bradley_terry(_matches(t), "a", "b", "score").select("entity", F.round("rating", 6).alias("rating"))


@query()
def calibration_selection(t: Tables) -> DataFrame:
    z = _scored(t).select(F.log(F.col("p") / (1 - F.col("p"))).alias("z"), "y", (F.col("doc_id") % 60).alias("series"), "doc_id")
    got = calibration.select_calibration(z, "z", "y", "series", "doc_id")
    chosen = got.chosen.family if got.chosen else None
    return t.spark.createDataFrame([(f, round(v, 6), f == chosen) for f, v in got.losses.items()], "family string, loss double, chosen boolean")


@query("""WITH p AS (SELECT c_nationkey AS a, c_mktsegment AS m, avg(c_acctbal) AS v FROM customer GROUP BY ALL) SELECT a, round(greatest(0, avg(v) - quantile_cont(v, 0.25)), 4) AS regret FROM p GROUP BY a""")
def response_regret(t: Tables) -> DataFrame:
    p = t.customer.groupBy(F.col("c_nationkey").alias("a"), "c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    return p.groupBy("a").agg(F.round(F.greatest(F.lit(0.0), F.avg("v") - F.percentile("v", F.lit(0.25))), 4).alias("regret"))


@query("""WITH p AS (SELECT n_nationkey, (n_nationkey / 10.0 + 1.0) / (n_nationkey / 10.0 + 3.0) AS p FROM nation) SELECT n_nationkey, round(pow(p, 5) * (1 + 5 * (1 - p) + 15 * pow(1 - p, 2) + 35 * pow(1 - p, 3) + 70 * pow(1 - p, 4)), 9) AS chance FROM p""")
def poisson_race(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.round(metrics.poisson_race(F.col("n_nationkey") / 10 + 1.0, F.lit(2.0), 5), 9).alias("chance"))


@query("""WITH z AS (SELECT (c_acctbal - 4500) / 3000 AS z FROM customer), e AS (SELECT z, sign(z) * exp(-z * z / 2) * list_sum(list_transform(range(0, 100), lambda n: pow(abs(z) / sqrt(2), 2 * n + 1) / gamma(n + 1.5))) AS erf FROM z)
    SELECT round(avg(3000 * (z * erf + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps FROM e""")
def gaussian_crps(t: Tables) -> DataFrame:
    return t.customer.agg(F.round(F.avg(metrics.gaussian_crps(F.col("c_acctbal"), F.lit(4500.0), F.lit(3000.0))), 6).alias("crps"))


def _stream(t: Tables) -> DataFrame:
    return stream.table_stream(t.spark, t.path("events"), t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(t: Tables, df: DataFrame, mode: str, name: str) -> DataFrame:
    return stream.run_to_table(df, f"tideline_{name}", mode, scratch_path(t.spark, name))


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_latest(t: Tables) -> DataFrame:
    return _run(t, stream.latest_state(_stream(t), "user_id", "event_id", ["event_type"]), "complete", "latest").select("user_id", "event_id", "event_type")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def stream_tumbling(t: Tables) -> DataFrame:
    out = _run(t, stream.tumbling(_stream(t), "ts", "1 day", ["event_type"], "value"), "complete", "tumbling")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT strftime(date_trunc('day', ts) - INTERVAL (k) DAY, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events, range(3) r(k) GROUP BY ALL""")
def stream_sliding(t: Tables) -> DataFrame:
    out = _run(t, stream.sliding(_stream(t), "ts", "3 days", "1 day", ["event_type"], "value"), "complete", "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedup(t: Tables) -> DataFrame:
    out = _run(t, stream.dedup(_stream(t), ["user_id", "event_type"], "ts", "3650 days"), "append", "dedup")
    return out.select("user_id", "event_type")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id""")
def stream_session(t: Tables) -> DataFrame:
    out = _run(t, stream.sessions(_stream(t), "ts", "6 hours", "user_id"), "complete", "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@query("""SELECT event_id, user_id FROM events""")
def stream_monotonic(t: Tables) -> DataFrame:
    return _run(t, stream.monotonic(_stream(t), "user_id", "event_id", ["event_type"]), "append", "monotonic").select("event_id", "user_id")
