"""Scalar, text and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, scalars as s, text
from .registry import Tables, query


@query("""SELECT p_partkey, CASE WHEN lower(trim(x)) IN ('', 'nan', 'nat', 'none', '<na>') THEN NULL ELSE trim(x) END AS cleaned FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN '  ' WHEN 2 THEN 'None' ELSE ' ' || p_name || ' ' END AS x FROM part)""")
def null_token_clean(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    dirty = F.when(k == 0, " NaN ").when(k == 1, "  ").when(k == 2, "None").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    return t.part.select("p_partkey", s.clean_token(dirty).alias("cleaned"))


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE (p_size % 4 + 13) || '.' || (p_partkey % 25) END AS patch FROM part)
    SELECT patch, CAST(count(*) AS BIGINT) AS n, CASE WHEN regexp_full_match(patch, '[0-9]+\\.[0-9]+') THEN CAST(row_number() OVER (ORDER BY try_cast(split_part(patch, '.', 1) AS INTEGER) DESC NULLS LAST, try_cast(split_part(patch, '.', 2) AS INTEGER) DESC NULLS LAST) AS INTEGER) END AS place FROM v GROUP BY patch""".replace("\\\\", "\\"))
def patch_version_sort(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    patch = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.concat((F.col("p_size") % 4 + 13).cast("string"), F.lit("."), (F.col("p_partkey") % 25).cast("string")))
    g = t.part.groupBy(patch.alias("patch")).agg(F.count(F.lit(1)).alias("n")).withColumn("v", s.version_parts("patch"))
    # One row per patch: the global order is over distinct patches only.
    return g.withColumn("k", F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last()))).select("patch", "n", F.when(F.col("v").isNotNull(), F.col("k")).alias("place"))


@query("""SELECT n_nationkey, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'major' WHEN regexp_matches(upper(n_name), 'AN|IA') THEN 'regional' ELSE 'other' END AS tier, r_name = 'EUROPE' AS is_international,
    CASE WHEN r_name = 'AMERICA' THEN 'west' WHEN r_name IN ('ASIA', 'MIDDLE EAST') THEN 'east' ELSE 'none' END AS scope FROM nation JOIN region ON n_regionkey = r_regionkey""")
def competition_classifier(t: Tables) -> DataFrame:
    r = F.col("r_name")
    tier = F.when(r.isin("ASIA", "EUROPE"), "major").when(F.upper("n_name").rlike("AN|IA"), "regional").otherwise("other")
    scope = F.when(r == "AMERICA", "west").when(r.isin("ASIA", "MIDDLE EAST"), "east").otherwise("none")
    c = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct(tier.alias("tier"), (r == "EUROPE").alias("is_international"), scope.alias("scope")).alias("c"))
    return c.select("n_nationkey", "c.*")


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, levenshtein(p_brand, 'Brand#12') AS distance,
    regexp_matches(upper(p_type), '(^|[^A-Z0-9])STEEL($|[^A-Z0-9])') AS steel FROM part""")
def text_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", s.entity_key("p_type").alias("key"), s.slug("p_name").alias("slug"), F.levenshtein("p_brand", F.lit("Brand#12")).cast("long").alias("distance"), s.has_token("p_type", "STEEL").alias("steel"))


@query("""SELECT o_orderkey, regexp_replace(x, '^(oe-api:|oracle-api:)+', '') AS key FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'oe-api:oracle-api:' ELSE '' END || o_orderkey AS x FROM orders)""")
def strip_source_prefix(t: Tables) -> DataFrame:
    x = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "oe-api:oracle-api:").otherwise(""), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", s.strip_prefixes(x, ("oe-api:", "oracle-api:")).alias("key"))


@query("""SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' ELSE n_name END AS name FROM nation""")
def alias_map(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", s.alias_of("n_name", {"NATION_1": "One", "NATION_2": "Two"}).alias("name"))


@query("""SELECT o_orderkey, CAST(date_trunc('hour', o_orderdate) AS VARCHAR) AS hour, CAST(CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS VARCHAR) AS sunday, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def date_frames(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(F.date_trunc("hour", d.cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("hour"), F.date_sub(d.cast("date"), F.dayofweek(d) - 1).cast("string").alias("sunday"), F.date_format(d, "yyyy-MM").alias("month"))


@query("""SELECT c_custkey, round(1 / (1 + pow(10, (0 - c_acctbal) / 400)), 6) AS expected, round(1 / (1 + exp(-greatest(-40, least(40, c_acctbal / 1000)))), 6) AS logistic, round(c_acctbal - greatest(0, abs(c_acctbal) / 10 - 100), 6) AS soft,
    round((1 / (1.5 + c_nationkey)) / (1 / (1.5 + c_nationkey) + 1 / 2.0), 6) AS no_vig, round(CASE WHEN c_acctbal >= 0 THEN 100 / (100 + c_acctbal) ELSE 2 - 100 / (100 - c_acctbal) END, 6) AS factor, round_even(c_acctbal / 3, 2) AS rounded FROM customer""")
def rating_scalars(t: Tables) -> DataFrame:
    r = lambda c: F.round(c, 6)
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", r(s.expected_score(b, F.lit(0.0))).alias("expected"), r(s.logistic(b / 1000)).alias("logistic"), r(s.soft_rating(b, F.abs(b) / 10, 100.0)).alias("soft"), r(s.no_vig(F.col("c_nationkey") + 1.5, F.lit(2.0))).alias("no_vig"), r(s.damage_factor(b)).alias("factor"), s.json_number(b / 3, 2).alias("rounded"))


@query("""WITH m AS (SELECT n_nationkey, (n_nationkey + 1) / 4.0 AS mu FROM nation), k AS (SELECT unnest(range(0, 6)) AS k)
    SELECT n_nationkey, round(sum(exp(-mu) * pow(mu, k) / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE)), 6) AS under FROM m, k GROUP BY n_nationkey""")
def poisson_under(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.round(s.poisson_cdf((F.col("n_nationkey") + 1) / 4.0, 5), 6).alias("under"))


@query("""WITH m AS (SELECT n_nationkey, (n_nationkey + 1) / 2.0 AS mu, 3.0 AS r FROM nation), k AS (SELECT unnest(range(0, 9)) AS k)
    SELECT n_nationkey, round(sum(exp(lgamma(r + k) - lgamma(r) - lgamma(k + 1)) * pow(r / (r + mu), r) * pow(mu / (r + mu), k)), 6) AS under FROM m, k GROUP BY n_nationkey""")
def negative_binomial_under(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.round(s.negative_binomial_cdf((F.col("n_nationkey") + 1) / 2.0, F.lit(3.0), 8), 6).alias("under"))


@query("""WITH a AS (SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
    SELECT CASE WHEN n = 0 THEN 'unsupported' WHEN last < TIMESTAMP '1996-01-01' THEN 'stale' WHEN n >= 15 THEN 'settled' WHEN n >= 8 THEN 'observed' ELSE 'thin' END AS state, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1""")
def evidence_state_ladder(t: Tables) -> DataFrame:
    a = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("last"))
    state = F.when(F.col("n") == 0, "unsupported").when(F.col("last") < F.lit("1996-01-01").cast("timestamp_ntz"), "stale").when(F.col("n") >= 15, "settled").when(F.col("n") >= 8, "observed").otherwise("thin")
    return a.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""".replace("\\\\", "\\"))
def markup_clean(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.clean_markup(F.col("html")).alias("body"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(replace(html, '<h', chr(10) || '== '), chr(10))) AS line, generate_subscripts(string_split(replace(html, '<h', chr(10) || '== '), chr(10)), 1) AS n FROM pages)
    SELECT page_id, CAST(count(*) FILTER (WHERE starts_with(line, '== ')) + CASE WHEN any_value(starts_with(line, '== ')) FILTER (WHERE n = 1) THEN 0 ELSE 1 END AS BIGINT) AS sections, CAST(max(n) AS BIGINT) AS lines FROM l GROUP BY page_id""")
def section_split(t: Tables) -> DataFrame:
    marked = t.pages.select("page_id", F.replace(F.col("html"), F.lit("<h"), F.lit("\n== ")).alias("body"))
    parts = text.split_sections(marked, "page_id", "body", r"(?s)^(==) (.*)$")
    return parts.groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"), F.max("end_line").alias("lines"))


@query("""WITH tk AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS al FROM tk),
    h AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS l, CAST(len(list_filter(t, lambda x: x = 'the')) AS DOUBLE) AS a, CAST(len(list_filter(t, lambda x: x = 'with')) AS DOUBLE) AS b FROM tk), d AS (SELECT CAST(count(*) FILTER (WHERE a > 0) AS DOUBLE) AS da, CAST(count(*) FILTER (WHERE b > 0) AS DOUBLE) AS db FROM h)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / al)), 4) AS score FROM h, c, d WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_search(t: Tables) -> DataFrame:
    index = text.search_index(t.documents, "doc_id", ["source", "text"], t.path("documents"))
    return index.search(["the", "with"], {"text": 1.0}).select("doc_id", F.round("score", 4).alias("score"))


@query("""WITH tk AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t, list_filter(string_split_regex(lower(coalesce(source, '')), '[^a-z0-9]+'), lambda x: x <> '') AS s FROM documents),
    c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t) + len(s)) AS al FROM tk), h AS (SELECT doc_id, CAST(len(t) + len(s) AS DOUBLE) AS l, len(list_filter(t, lambda x: x = 'the')) + 4.0 * len(list_filter(s, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'src3')) + 4.0 * len(list_filter(s, lambda x: x = 'src3')) AS b FROM tk),
    d AS (SELECT CAST(count(*) FILTER (WHERE a > 0) AS DOUBLE) AS da, CAST(count(*) FILTER (WHERE b > 0) AS DOUBLE) AS db FROM h)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / al)), 4) AS score FROM h, c, d WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def weighted_search(t: Tables) -> DataFrame:
    index = text.search_index(t.documents, "doc_id", ["source", "text"], t.path("documents"))
    return index.search(["the", "src3"], {"source": 4.0, "text": 1.0}).select("doc_id", F.round("score", 4).alias("score"))


@query("""SELECT event_id, event_type = 'error' AS has_secret FROM events""")
def json_key_guard(t: Tables) -> DataFrame:
    doc = F.concat(F.lit('{"a":[{"'), F.when(F.col("event_type") == "error", "draft").otherwise("plain"), F.lit('":1}]}'))
    return t.events.select("event_id", jsons.has_key(doc, ["draft"]).alias("has_secret"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '{"a":[{}],"k":1}' ELSE '{"a":[{"plain":1}],"k":1}' END AS doc FROM events""")
def json_key_strip(t: Tables) -> DataFrame:
    doc = F.concat(F.lit('{"a":[{"'), F.when(F.col("event_type") == "error", "draft").otherwise("plain"), F.lit('":1}],"k":1}'))
    return t.events.select("event_id", jsons.strip_keys(doc, ["draft"]).alias("doc"))


@query("""SELECT conv_id, len(list(role)) <= 6 AND bool_and(octet_length(encode(trim(role))) BETWEEN 1 AND 9) AS bounded FROM conversations GROUP BY conv_id""")
def bounded_arrays(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("r")).select("conv_id", jsons.bounded_array(F.col("r"), 6, 9).alias("bounded"))


@query("""WITH k AS (SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, code FROM customer JOIN k USING (c_mktsegment)""")
def category_codes(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    codes = t.customer.select("c_mktsegment").distinct().withColumn("code", (F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1).cast("int"))
    return t.customer.join(codes, "c_mktsegment").select("c_custkey", "code")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_building, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS is_machinery FROM customer""")
def dummy_encoding(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", *[(F.col("c_mktsegment") == m).cast("int").alias(f"is_{m.lower()}") for m in ("BUILDING", "MACHINERY")])


@query("""SELECT page_id, lower(url) AS key FROM pages""")
def unicode_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", s.unicode_key("url").alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN CASE p_size WHEN 1 THEN 'Blue' ELSE 'Red' END ELSE 'Other' END AS side FROM part""")
def side_canonical(t: Tables) -> DataFrame:
    v = F.initcap(F.trim(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.when(v == "1", "Blue").when(v == "2", "Red").otherwise("Other").alias("side"))
