"""Seed questions about suppliers (one topic) and nations (two), tested against questions that look like some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import seeds as S
from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table

SCENARIOS = ("our budget is tight", "we only talk at weekends", "the contract ends soon", "our orders come late", "money and time are both short")
OPENINGS = ("Regarding {t}, {s}. ", "{s}; what troubles me is {t}. ", "I want to improve things with {t}; {s}. ")
REQUESTS = ("Give me one step for this week.", "Which risks come first?", "Make a plan for a month.", "What should I ask them?")
BOUNDARIES = (" Say what is a guess.", " Keep it short.", " Weigh both sides.", " Name your sources.")
_SINGLE, _MULTI, _THRESHOLD = 35, 15, 0.82


def _text(topic: str):
    """The question of a candidate: what is said depends on its number and its opening, as in a loop that counts."""

    def build(df: DataFrame, offset: int = 0) -> DataFrame:
        variant = F.col("ordinal") + offset + F.col("opening")
        pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (k + 1).cast("int"))
        opening = F.replace(F.replace(pick(OPENINGS, variant % 3), F.lit("{t}"), F.col(topic)), F.lit("{s}"), pick(SCENARIOS, F.col("scenario")))
        return df.withColumn("question", F.concat(opening, pick(REQUESTS, F.col("request")), pick(BOUNDARIES, F.floor(variant / 3) % 4)))

    return build


def _benchmark(spark, sf_dir):
    """Questions of a test set: some equal a candidate, some hold one, some are held by one, some are near."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 1").select("s_suppkey", "s_name")
    k = F.col("s_suppkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("REGARDING "), "s_name", F.lit(", our budget is tight! Give me one step for this week. Say what is a guess")))
        .when(k == 1, F.concat("s_name", F.lit("; our budget is tight")))
        .when(k == 2, F.concat(F.lit("Well: our budget is tight; what troubles me is "), "s_name", F.lit(". Which risks come first? Say what is a guess. Thanks.")))
        .otherwise(F.concat(F.lit("Regarding "), "s_name", F.lit(", our budget is so tight. Make a plan for a month. Keep it very short.")))
    )
    return s.select(F.col("s_suppkey").alias("item_id"), text.alias("text"))


def _made(spark, sf_dir):
    store, bench = Store(spark, "seeds"), _benchmark(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("topic"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("unit"), F.concat(F.lit("trade with "), "n_name").alias("topic"))
    radix = lambda n: {"scenario": 5, "opening": 3, "unit": n, "request": 4}
    text = _text("topic")
    total = suppliers.count()
    # The last scenario speaks of two things at once, which is no question for a single agent.
    single = S.generated(spark, radix(total), lambda df: text(df.join(suppliers, "unit")), bench, _target(total)[0], _THRESHOLD, store, suits=F.col("scenario") < 4, fewer=True)
    multi = S.generated(spark, radix(25), lambda df: text(df.join(nations, "unit"), single.tried), bench, _target(total)[1], _THRESHOLD, store, taken=single.accepted.select("form"), fewer=True)
    return single, multi


def _target(suppliers: int) -> tuple[int, int]:
    """35 seeds of one topic for each supplier, and 15 of two."""
    return _SINGLE * suppliers, _MULTI * 25


_OPEN_SQL = "CASE v % 3 WHEN 0 THEN 'Regarding ' || topic || ', ' || s || '. ' WHEN 1 THEN s || '; what troubles me is ' || topic || '. ' ELSE 'I want to improve things with ' || topic || '; ' || s || '. ' END"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _candidates_sql(name: str, units: str, n: str, offset: str) -> str:
    return f"""{name}_c AS (SELECT o AS ordinal, o // (4 * {n} * 3) AS scenario, (o // (4 * {n})) % 3 AS opening, (o // 4) % {n} AS unit, o % 4 AS request, o + {offset} + (o // (4 * {n})) % 3 AS v FROM (SELECT unnest(range(0, 5 * 3 * 4 * {n})) AS o)),
{name}_t AS (SELECT c.*, u.topic, ({_LIST(SCENARIOS)})[CAST(scenario AS INTEGER) + 1] AS s FROM {name}_c c JOIN ({units}) u USING (unit)),
{name}_q AS (SELECT *, {_OPEN_SQL} || ({_LIST(REQUESTS)})[CAST(request AS INTEGER) + 1] || ({_LIST(BOUNDARIES)})[CAST((v // 3) % 4 AS INTEGER) + 1] AS question FROM {name}_t),
{name}_f AS (SELECT *, lower(regexp_replace(question, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS form FROM {name}_q),
{name}_g AS (SELECT ordinal, form, list_distinct([form[i:i + 2] for i in range(1, length(form) - 1)]) AS g FROM {name}_f),
{name}_e AS (SELECT ordinal, len(g) AS n, unnest(g) AS x FROM {name}_g),
{name}_j AS (SELECT e.ordinal, b.item_id, count(*) AS k, max(e.n) AS n, max(b.n) AS m FROM {name}_e e JOIN bench_e b USING (x) GROUP BY ALL),
{name}_s AS (SELECT ordinal, max(k / (n + m - k)::DOUBLE) AS sim FROM {name}_j GROUP BY 1),
{name}_i AS (SELECT DISTINCT f.ordinal FROM {name}_f f JOIN bench b ON contains(f.form, b.form) OR contains(b.form, f.form)),
{name}_v AS (SELECT f.*, CASE WHEN sim >= 1 OR i.ordinal IS NOT NULL THEN 'exact' WHEN sim >= {_THRESHOLD} THEN 'near' END AS verdict FROM {name}_f f LEFT JOIN {name}_s USING (ordinal) LEFT JOIN {name}_i i ON i.ordinal = f.ordinal)"""


_SEEDS_SQL = f"""WITH n AS (SELECT count(*) AS n FROM supplier),
bench AS (SELECT item_id, lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS form FROM (SELECT s_suppkey AS item_id, CASE s_suppkey % 4 WHEN 0 THEN 'REGARDING ' || s_name || ', our budget is tight! Give me one step for this week. Say what is a guess' WHEN 1 THEN s_name || '; our budget is tight'
  WHEN 2 THEN 'Well: our budget is tight; what troubles me is ' || s_name || '. Which risks come first? Say what is a guess. Thanks.' ELSE 'Regarding ' || s_name || ', our budget is so tight. Make a plan for a month. Keep it very short.' END AS t FROM supplier WHERE s_suppkey % 3 = 1)),
bench_e AS (SELECT item_id, len(g) AS n, unnest(g) AS x FROM (SELECT item_id, list_distinct([form[i:i + 2] for i in range(1, length(form) - 1)]) AS g FROM bench)),
{_candidates_sql("a", "SELECT s_suppkey AS unit, s_name AS topic FROM supplier", "(SELECT n FROM n)", "0")},
a_first AS (SELECT form, min(ordinal) AS ordinal FROM a_v WHERE verdict IS NULL AND scenario < 4 GROUP BY 1),
a_ok AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS k FROM a_first QUALIFY k < {_SINGLE} * (SELECT n FROM n)),
a_last AS (SELECT max(ordinal) + 1 AS tried FROM a_ok),
{_candidates_sql("m", "SELECT n_nationkey AS unit, 'trade with ' || n_name AS topic FROM nation", "25", "(SELECT tried FROM a_last)")},
m_first AS (SELECT form, min(ordinal) AS ordinal FROM m_v WHERE verdict IS NULL AND form NOT IN (SELECT form FROM a_ok) GROUP BY 1),
m_ok AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS k FROM m_first QUALIFY k < {_MULTI * 25})"""


@query(
    "seed_questions",
    f"""{_SEEDS_SQL}, sizes AS (SELECT (SELECT count(*) FROM a_ok) AS n, (SELECT count(*) FROM m_ok) AS m)
SELECT 'SINGLE_AGENT' AS mode, ordinal, question, k + least(k, m) AS position FROM a_ok JOIN a_v USING (ordinal, form), sizes UNION ALL SELECT 'ADAPTIVE_MULTI_AGENT', ordinal, question, k + least(k + 1, n) FROM m_ok JOIN m_v USING (ordinal, form), sizes""",
)
def seed_questions(spark, sf_dir):
    single, multi = _made(spark, sf_dir)
    named = lambda made, mode: made.accepted.select(F.lit(mode).alias("mode"), "ordinal", "question")
    return S.interleaved(named(single, "SINGLE_AGENT"), named(multi, "ADAPTIVE_MULTI_AGENT"))


@query(
    "seed_counters",
    f"""{_SEEDS_SQL} SELECT 'SINGLE_AGENT' AS mode, (SELECT count(*) FROM a_ok) AS accepted, count(*) FILTER (verdict = 'exact') AS exact, count(*) FILTER (verdict = 'near') AS near, count(*) AS tried FROM a_v WHERE ordinal <= (SELECT max(ordinal) FROM a_ok)
UNION ALL SELECT 'ADAPTIVE_MULTI_AGENT', (SELECT count(*) FROM m_ok), count(*) FILTER (verdict = 'exact'), count(*) FILTER (verdict = 'near'), count(*) FROM m_v WHERE ordinal <= (SELECT max(ordinal) FROM m_ok)""",
)
def seed_counters(spark, sf_dir):
    out = None
    for mode, made in zip(("SINGLE_AGENT", "ADAPTIVE_MULTI_AGENT"), _made(spark, sf_dir), strict=True):
        one = made.accepted.agg(F.lit(mode).alias("mode"), F.count("*").alias("accepted"), *[F.lit(x).cast("long").alias(n) for n, x in (("exact", made.exact), ("near", made.near), ("tried", made.tried))])
        out = one if out is None else out.unionAll(one)
    return out
