"""Dataset-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.functions.text import normalised
from trailmill.operators import datasets as D
from trailmill.plans.views import RUNS_SQL, runs
from trailmill.plans.views import jround_sql as R
from trailmill.sources.tables import table

_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "round_numbers",
    f"WITH {RUNS_SQL} SELECT run_id, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY completed_at NULLS LAST, run_id) - 1 AS round, bool_or(reward > 0.9::DOUBLE) OVER (PARTITION BY sample_id) AS labeled_anchor FROM runs",
)
def round_numbers(spark, sf_dir):
    return D.round_numbers(runs(spark, sf_dir).withColumn("anchor", F.col("reward") > 0.9)).select("run_id", "sample_id", "round", "labeled_anchor")


@query("best_per_group", f"WITH {RUNS_SQL} SELECT sample_id, run_id, reward FROM runs QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY reward DESC, run_id) = 1")
def best_per_group(spark, sf_dir):
    return D.best_per(runs(spark, sf_dir), "sample_id", F.desc("reward"), F.asc("run_id")).select("sample_id", "run_id", "reward")


@query("exact_dedup_normalised", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {_NORM} ORDER BY n_chars DESC, doc_id) = 1")
def exact_dedup(spark, sf_dir):
    keyed = _docs(spark, sf_dir).select("doc_id", "n_chars", F.sha2(normalised(F.col("text")), 256).alias("k"))
    return D.best_per(keyed, "k", F.desc("n_chars"), F.asc("doc_id")).select("doc_id")


@query("hash_split", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, least(n - 1, floor(n * 0.1::DOUBLE + 0.5))) AS validation FROM documents, n")
def hash_split(spark, sf_dir):
    return D.hash_split(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.1)


@query("stratified_round_robin", "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS turn FROM documents) SELECT doc_id, lang, source, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, lang, source, doc_id LIMIT 150")
def stratified_round_robin(spark, sf_dir):
    return D.round_robin(_docs(spark, sf_dir).select("doc_id", "lang", "source"), ["lang", "source"], [F.sha2(F.col("doc_id").cast("string"), 256)], 150, "doc_id")


@query("top_ratio_union", "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY source) * 0.3::DOUBLE)) OR n_chars >= 3000")
def top_ratio_union(spark, sf_dir):
    return D.top_ratio_or(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", "n_chars", "doc_id", 0.3, 3000)


@query(
    "quota_sample",
    "WITH t AS (SELECT doc_id, lang, n_chars, CASE WHEN n_chars > 15000 THEN 0 WHEN row_number() OVER (PARTITION BY lang ORDER BY n_chars > 15000 DESC, n_chars, doc_id) <= 5 THEN 1 ELSE 2 END AS tier FROM documents) SELECT doc_id, lang, tier FROM t ORDER BY tier, n_chars, doc_id LIMIT 60",
)
def quota_sample(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars", (F.col("n_chars") > 15000).alias("must"))
    return D.quota_sample(rows, "lang", "must", [F.asc("n_chars")], 5, 60, "doc_id").select("doc_id", "lang", "tier")


@query("interleaved_lists", "SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS source_no, CAST(row_number() OVER (PARTITION BY lang = 'de' ORDER BY doc_id) AS INTEGER) AS turn FROM documents WHERE lang IN ('de', 'fr')")
def interleaved(spark, sf_dir):
    ids = lambda x: _docs(spark, sf_dir).where(F.col("lang") == x).select("doc_id")
    return D.interleave(ids("fr"), ids("de"), "doc_id")


@query("pending_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(spark, sf_dir):
    return D.pending(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("selected_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected(spark, sf_dir):
    return D.selected(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("tainted_groups_anti", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 20000)")
def tainted(spark, sf_dir):
    return D.without_tainted(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "source", F.col("n_chars") > 20000).select("doc_id", "source")


@query("left_enrich", "SELECT doc_id, coalesce(CASE WHEN l.quality IS NOT NULL THEN l.quality * 0.5::DOUBLE END, CASE WHEN d.n_chars > 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS confidence FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_enrich(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", (F.col("n_chars") > 5000).alias("anchor"))
    return D.enriched(docs, table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 0.5).alias("confidence")), "doc_id").select("doc_id", "confidence")


_PAIRS = f"""{RUNS_SQL}, pr AS (SELECT sample_id * 10000 + year(completed_at) AS seed_id, run_id, reward AS score, status <> 'CANCELLED' AS gate, repeat('x', CAST(run_id % 40 AS INTEGER)) || CAST(run_id AS VARCHAR) AS t, row_number() OVER (PARTITION BY sample_id, year(completed_at) ORDER BY completed_at, run_id) - 1 AS rnd FROM runs),
g AS (SELECT seed_id, count(*) AS n, arg_max(run_id, (score, -rnd)) AS hi, arg_min(run_id, (score, -rnd)) AS lo, max(score) AS hs, min(score) AS ls, bool_and(gate) AS gates, arg_max(t, (score, -rnd)) AS ht, arg_min(t, (score, -rnd)) AS lt FROM pr GROUP BY 1),
j AS (SELECT *, CASE WHEN n <> 2 THEN 'rounds' WHEN NOT gates THEN 'hard_gate' WHEN hs - ls < 0.1::DOUBLE THEN 'margin' WHEN ht = lt THEN 'same' WHEN length(ht) > 40 OR length(lt) > 40 THEN 'long' ELSE 'accepted' END AS reason FROM g)"""


def _pair_runs(spark, sf_dir):
    # A seed is a customer's year.
    base = runs(spark, sf_dir).withColumn("sample_id", F.col("sample_id") * 10000 + F.year("completed_at")).withColumn("anchor", F.lit(False))
    text = F.concat(F.repeat(F.lit("x"), (F.col("run_id") % 40).cast("int")), F.col("run_id").cast("string"))
    return D.round_numbers(base).select(F.col("sample_id").alias("seed_id"), "round", "run_id", F.col("reward").alias("score"), (F.col("status") != "CANCELLED").alias("gate"), text.alias("text"))


@query("preference_pairs", f"WITH {_PAIRS} SELECT seed_id, hi AS chosen, lo AS rejected, CAST(floor((hs - ls) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS margin_micro FROM j WHERE reason = 'accepted'")
def preference_pairs(spark, sf_dir):
    return D.preference_pairs(_pair_runs(spark, sf_dir), 0.1, 40)[0]


@query("preference_rejections", f"WITH {_PAIRS} SELECT reason, count(*) AS n FROM j GROUP BY 1")
def preference_rejections(spark, sf_dir):
    return D.preference_pairs(_pair_runs(spark, sf_dir), 0.1, 40)[1]


_COMPACT = "lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g'))"


@query("benchmark_containment", f"SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_COMPACT} AS d FROM documents) JOIN (SELECT item_id, {_COMPACT} AS c FROM benchmark) ON length(c) >= 12 AND contains(d, c)")
def benchmark_containment(spark, sf_dir):
    return D.contained(_docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query(
    "near_dup_jaccard",
    f"""WITH g AS (SELECT doc_id, list_distinct([c[i:i + 2] for i in range(1, greatest(2, length(c) - 1))]) AS g FROM (SELECT doc_id, {_COMPACT} AS c FROM documents) WHERE length(c) > 0),
e AS (SELECT doc_id, unnest(g) AS x, len(g) AS n FROM g), p AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS k, max(a.n) AS na, max(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.82 * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT l AS left_id, r AS right_id, {R("k / (na + nb - k)::DOUBLE", 6)} AS similarity FROM p WHERE k / (na + nb - k)::DOUBLE >= 0.82""",
)
def near_dup_jaccard(spark, sf_dir):
    from trailmill.functions.numeric import jround

    out = D.near_pairs(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), 0.82)
    return out.withColumn("similarity", jround("similarity", 6))


_RULES_SQL = "length(text) >= 300 AS a, source <> 'src3' AS b, lang IN ('en', 'de') AS c"


def _rules():
    return {"short": F.length("text") >= 300, "source": F.col("source") != "src3", "language": F.col("lang").isin("en", "de")}


@query("dataset_violations", f"WITH v AS (SELECT {_RULES_SQL} FROM documents) SELECT unnest(['short', 'source', 'language', 'too_few', 'repeated_key']) AS rule, unnest([count(*) FILTER (NOT a), count(*) FILTER (NOT b), count(*) FILTER (NOT c), greatest(0, 5000 - count(*)), 0]) AS n FROM v")
def dataset_violations(spark, sf_dir):
    return D.violations(_docs(spark, sf_dir), "doc_id", _rules(), 5000)


@query("reason_histogram", f"WITH v AS (SELECT {_RULES_SQL} FROM documents) SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT a THEN 'short' END, CASE WHEN NOT b THEN 'source' END, CASE WHEN NOT c THEN 'language' END], lambda x: x IS NOT NULL)) AS reason FROM v) GROUP BY 1")
def reason_histogram(spark, sf_dir):
    return D.reason_histogram(D.rejections(_docs(spark, sf_dir), _rules()))


@query(
    "trajectory_selection",
    """WITH o AS (SELECT o_custkey AS sample_id, o_custkey % 7 AS task_group, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS round, o_totalprice / 500000 AS reward, o_custkey % 5 = 0 AS anchor, 0.6::DOUBLE + (o_custkey % 4) / 10.0::DOUBLE AS confidence FROM orders WHERE o_custkey % 9 <> 0),
c AS (SELECT sample_id, task_group, list(reward ORDER BY round) AS r, avg(confidence) AS confidence, bool_or(anchor) AS anchor FROM o GROUP BY 1, 2), sh AS (SELECT task_group, min(len(r)) AS short FROM c WHERE anchor GROUP BY 1),
m AS (SELECT task_group, i, avg(v) AS v FROM (SELECT task_group, unnest(r) AS v, unnest(range(0, len(r))) AS i FROM c WHERE anchor) GROUP BY 1, 2),
x AS (SELECT sample_id, task_group, unnest(r) AS a, unnest(range(0, len(r))) AS i, least(len(r), short) AS n FROM c JOIN sh USING (task_group) WHERE NOT anchor AND confidence >= 0.72::DOUBLE),
s AS (SELECT sample_id, x.task_group, corr(a, v) AS similarity, max(n) AS n FROM x JOIN m ON m.task_group = x.task_group AND m.i = x.i AND x.i < n GROUP BY 1, 2 HAVING max(n) >= 2)
SELECT sample_id, task_group, CAST(floor(similarity * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS similarity_micro FROM (SELECT * FROM s WHERE similarity >= 0 AND NOT isnan(similarity)) QUALIFY row_number() OVER (PARTITION BY task_group ORDER BY similarity DESC, sample_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY task_group) * 0.3::DOUBLE)) OR similarity >= 0.8::DOUBLE""",
)
def trajectory_selection(spark, sf_dir):
    base = runs(spark, sf_dir).withColumn("anchor", F.col("sample_id") % 5 == 0)
    o = D.round_numbers(base).select("sample_id", (F.col("sample_id") % 7).alias("task_group"), "round", "reward", (0.6 + (F.col("sample_id") % 4) / 10.0).alias("confidence"), "anchor", (F.col("sample_id") % 9 == 0).alias("evaluation_only"))
    return D.trajectory_selection(o)


@query("jsonl_export", "SELECT '{\"doc_id\":' || doc_id || ',\"lang\":' || CAST(to_json(lang) AS VARCHAR) || ',\"text\":' || CAST(to_json(text) AS VARCHAR) || '}' AS value FROM documents WHERE n_chars >= 500")
def jsonl_export(spark, sf_dir):
    return D.export_rows(_docs(spark, sf_dir).where("n_chars >= 500"), ["doc_id", "lang", "text"])


@query("dataset_fingerprint", "WITH h AS (SELECT sha256(doc_id || ':' || text) AS h FROM documents), p AS (SELECT h[1:3] AS p, h[4:5] AS q, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY p, q)) AS fingerprint FROM p")
def dataset_fingerprint(spark, sf_dir):
    return D.fingerprint(_docs(spark, sf_dir), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")))
