"""Lookups, summaries and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import summaries as U
from trailmill.plans.views import jround_sql as R
from trailmill.plans.views import stable_sql as S
from trailmill.sources.tables import table


@query("run_by_id", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 33")
def run_by_id(spark, sf_dir):
    return U.by_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "33")


@query("number_summary", f"SELECT o_orderstatus, count(v) AS n, {S('avg(v)', 6)} AS average, {R('min(v)', 6)} AS least, {R('max(v)', 6)} AS greatest FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN o_totalprice / 1000 END AS v FROM orders) GROUP BY 1")
def number_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("v", F.when((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 5 > 0), F.col("o_totalprice") / 1000))
    return U.number_summary(rows, "v", "o_orderstatus")


@query(
    "telemetry_rollup",
    f"""WITH g AS (SELECT l_orderkey AS run_id, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS prompt_tokens, CAST(sum(l_linenumber * 7) AS BIGINT) AS completion_tokens, bool_or(l_returnflag = 'N') AS estimated, count(*) FILTER (l_linestatus = 'F' AND l_linenumber = 1) AS timeouts FROM lineitem GROUP BY 1)
SELECT *, prompt_tokens + completion_tokens AS total_tokens, {R("(prompt_tokens * 0.3::DOUBLE + completion_tokens * 0.6::DOUBLE) / 1e6::DOUBLE", 8)} AS cost FROM g""",
)
def telemetry_rollup(spark, sf_dir):
    n = F.col("l_linenumber")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_quantity").cast("long") * 10).alias("prompt_tokens"), (n * 7).alias("completion_tokens"), (F.col("l_returnflag") == "N").alias("estimated"), ((F.col("l_linestatus") == "F") & (n == 1)).alias("timed_out"))
    return U.telemetry(calls, 0.3, 0.6)


@query("manifest_histograms", "SELECT section, value, count(*) AS n FROM (SELECT 'lang' AS section, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'domain', unnest([lang, CASE WHEN n_chars > 1000 THEN 'long' END]) FROM documents) WHERE value IS NOT NULL GROUP BY 1, 2")
def manifest_histograms(spark, sf_dir):
    return U.histograms(table(spark, sf_dir, "documents"), {"lang": F.col("lang"), "source": F.col("source")}, {"domain": F.array("lang", F.when(F.col("n_chars") > 1000, "long"))})


@query("cost_ceilings", "SELECT l_returnflag, CAST(ceil(sum(CAST(l_quantity AS BIGINT)) * 1.25::DOUBLE) AS BIGINT) AS tokens, CAST(ceil(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) * 1.25) AS BIGINT) AS amount FROM lineitem GROUP BY 1")
def cost_ceilings(spark, sf_dir):
    return U.cost_ceilings(table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("tokens"), F.col("l_extendedprice").alias("amount")), 1.25, "l_returnflag")


@query(
    "best_round",
    f"""WITH v AS (SELECT o_custkey AS seed_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS round, floor(o_totalprice / 50000) / 10 AS score FROM orders)
SELECT seed_id, arg_min(run_id, (-score, round, run_id)) AS run_id, arg_min(round, (-score, round, run_id)) AS round, count(*) AS rounds, {R("max(score)", 6)} AS score, {R("min(score)", 6)} AS pair_minimum, {R("max(score) - min(score)", 6)} AS pair_gap FROM v GROUP BY 1""",
)
def best_round(spark, sf_dir):
    from trailmill.operators.datasets import round_numbers

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), (F.floor(F.col("o_totalprice") / 50000) / 10).alias("score"), F.lit(False).alias("anchor"))
    return U.best_round(round_numbers(o).select(F.col("sample_id").alias("seed_id"), "run_id", "round", "score"))


@query("recent_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def recent_runs(spark, sf_dir):
    return U.recent(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 500)


@query("concept_union", "SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:24], '|') AS concepts FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{5,}') || regexp_extract_all(lower(text), '[a-z]+') AS l FROM benchmark)")
def concept_union(spark, sf_dir):
    words = lambda p: F.regexp_extract_all(F.lower("text"), F.lit(p), 0)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(U.ordered_union(words("[a-z]{5,}"), words("[a-z]+")), "|").alias("concepts"))


@query("subset_check", "SELECT count(*) AS missing, count(*) = 0 AS subset FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0))")
def subset_check(spark, sf_dir):
    return U.subset(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("doc_id % 7 > 0"), "doc_id")


@query("complete_join", "WITH p AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber < 3), c AS (SELECT (SELECT count(*) FROM p) AS planned, (SELECT count(*) FROM r) AS found, (SELECT count(*) FROM p JOIN r USING (k)) AS joined) SELECT *, planned = found AND found = joined AS complete FROM c")
def complete_join(spark, sf_dir):
    return U.complete_join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("k")), "k")


@query("durations", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) AS ms FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def durations(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    instant = lambda c: F.col(c).cast("timestamp")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", U.duration_ms(instant("o_orderdate"), instant("l_shipdate")).alias("ms"))


@query(
    "breaker_state",
    """WITH e AS (SELECT user_id % 50 AS agent, ts, event_id, event_type NOT IN ('error', 'view') AS ok FROM events), m AS (SELECT max(ts) AS now FROM events), l AS (SELECT agent, max((ts, event_id)) AS good FROM e WHERE ok GROUP BY 1),
f AS (SELECT e.agent, count(*) AS failures, max(ts) AS failed_at FROM e LEFT JOIN l ON l.agent = e.agent WHERE NOT ok AND (good IS NULL OR (ts, event_id) > good) GROUP BY 1)
SELECT a.agent, coalesce(failures, 0) AS failures, CASE WHEN failures >= 2 THEN failed_at + INTERVAL 12 HOUR END AS open_until, coalesce(now < CASE WHEN failures >= 2 THEN failed_at + INTERVAL 12 HOUR END, false) AS open FROM (SELECT DISTINCT agent FROM e) a LEFT JOIN f ON f.agent = a.agent, m""",
)
def breaker_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    calls = e.select((F.col("user_id") % 50).alias("agent"), F.col("ts").alias("at"), "event_id", (~F.col("event_type").isin("error", "view")).alias("ok"))
    return U.breaker_state(calls, 2, "INTERVAL 12 HOURS", F.lit(now))


_ROUTES = [("The", "article"), ("Th", "start"), ("D", "german")]


@query("prefix_route", "SELECT doc_id, CASE " + " ".join(f"WHEN starts_with(coalesce(text, ''), '{p}') THEN '{r}'" for p, r in _ROUTES) + " ELSE 'other' END AS route FROM documents")
def prefix_route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.first_prefix(F.coalesce("text", F.lit("")), _ROUTES, "other").alias("route"))


@query("reference_excerpt", "SELECT doc_id, CASE WHEN length(c) > 120 THEN substr(c, 1, 120) || '…' ELSE c END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS c FROM documents)")
def reference_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.excerpt(F.col("text")).alias("excerpt"))


@query("context_block", "SELECT g, sha256(string_agg('[来源 ' || CAST(k AS VARCHAR) || ' | item-' || CAST(item_id AS VARCHAR) || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY k)) AS block FROM (SELECT item_id % 20 AS g, item_id, text, row_number() OVER (PARTITION BY item_id % 20 ORDER BY item_id) AS k FROM benchmark) GROUP BY 1")
def context_block(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 20).alias("g")).agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("d"))
    named = F.transform("d", lambda x: F.struct(F.concat(F.lit("item-"), x["item_id"].cast("string")).alias("source"), x["text"].alias("text")))
    return b.select("g", F.sha2(U.context_block(named), 256).alias("block"))


@query(
    "ranked_quantiles",
    "WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(n) AS n, max(v) FILTER (k = floor((n - 1) * 0.975::DOUBLE)) AS by_floor, max(v) FILTER (k = round_even((n - 1) * 0.975::DOUBLE, 0)) AS by_round FROM r GROUP BY 1",
)
def ranked_quantiles(spark, sf_dir):
    return U.ranked_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.975, "l_returnflag")


@query("embedded_object", "SELECT event_id, CAST(json_extract(regexp_extract('Result: ' || props || ' (end)', '\\{.*\\}'), '$.k') AS BIGINT) AS k FROM events")
def embedded_object(spark, sf_dir):
    text = F.concat(F.lit("Result: "), F.col("props"), F.lit(" (end)"))
    return table(spark, sf_dir, "events").select("event_id", U.embedded_object(text, "k long")["k"].alias("k"))
