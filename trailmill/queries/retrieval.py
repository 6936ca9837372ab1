"""Retrieval over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.operators import retrieval as R
from trailmill.plans.shared_store import application_folder
from trailmill.plans.views import jround_sql
from trailmill.sources import vector_index as V
from trailmill.sources.tables import table

_VECTOR = f"""vs AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {jround_sql("list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))", 6)} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
v AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM vs WHERE score >= 0.2::DOUBLE QUALIFY rank <= 10)"""
_LEXICAL = f"""qt AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) AS term FROM benchmark),
tot AS (SELECT query_id, count(*) AS total FROM qt GROUP BY 1), dt AS (SELECT doc_id AS item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) AS term FROM documents),
ls AS (SELECT query_id, item_id, {jround_sql("count(*) / max(total)::DOUBLE", 6)} AS score FROM qt JOIN dt USING (term) JOIN tot USING (query_id) GROUP BY 1, 2),
l AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ls QUALIFY rank <= 10)"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


@query("vector_topk", f"WITH {_VECTOR} SELECT * FROM v")
def vector_topk(spark, sf_dir):
    return R.vector_topk(*_vectors(spark, sf_dir), k=10)


def _index(spark, sf_dir):
    """Kept for the application: a second query finds it and reads no table."""
    rows = lambda: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label")
    prints = V.file_fingerprint(table(spark, sf_dir, "embeddings"))
    return V.opened(spark, f"{application_folder(spark)}/vector-index", prints, rows, "item_id long, v array<float>, label int")


@query("vector_index_topk", f"WITH {_VECTOR} SELECT * FROM v")
def vector_index_topk(spark, sf_dir):
    return V.search(_index(spark, sf_dir), _vectors(spark, sf_dir)[0], k=10)


@query(
    "vector_filtered_topk",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {jround_sql("list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))", 6)} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label % 3 = 1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score >= 0.5::DOUBLE QUALIFY rank <= 3""",
)
def vector_filtered_topk(spark, sf_dir):
    return V.search(_index(spark, sf_dir), _vectors(spark, sf_dir)[0], k=3, threshold=0.5, where=F.col("label") % 3 == 1)


@query("lexical_topk", f"WITH {_LEXICAL} SELECT * FROM l")
def lexical_topk(spark, sf_dir):
    return R.lexical_topk(*_texts(spark, sf_dir), k=10)


_TERMS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]{{2,}}'))"
_PLAIN = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{Han}}a-z0-9]', '', 'g')"


@query(
    "hybrid_rank_fusion",
    f"""WITH {_VECTOR}, {_LEXICAL}, j AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.item_id, l.item_id) AS item_id, v.score AS vs, v.rank AS vrank, l.score AS cov, l.rank AS lrank FROM v FULL JOIN l ON v.query_id = l.query_id AND v.item_id = l.item_id),
t AS (SELECT j.*, {_TERMS.format("b.text")} AS qs, {_TERMS.format("d.text")} AS ds, {_PLAIN.format("b.text")} AS qp, {_PLAIN.format("d.text")} AS dp FROM j LEFT JOIN benchmark b ON b.item_id = j.query_id LEFT JOIN documents d ON d.doc_id = j.item_id),
c AS (SELECT *, greatest(coalesce(cov, 0), CASE WHEN len(qs) > 0 THEN {jround_sql("len(list_intersect(qs, ds)) / len(qs)::DOUBLE", 6)} ELSE 0 END) AS coverage, CASE WHEN length(qp) BETWEEN 2 AND 24 AND contains(dp, qp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM t),
s AS (SELECT *, {jround_sql("0.45::DOUBLE * (coalesce(0.6::DOUBLE * 61 / (60 + vrank), 0) + coalesce(0.4::DOUBLE * 61 / (60 + lrank), 0)) + 0.30::DOUBLE * coverage + 0.20::DOUBLE * least(1, greatest(0, coalesce(vs, 0))) + 0.05::DOUBLE * bonus", 4)} AS score FROM c)
SELECT query_id, item_id, score, coalesce(vrank, 0) AS vrank, coalesce(lrank, 0) AS lrank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.vrank NULLS LAST, s.lrank NULLS LAST, item_id) AS rank FROM s QUALIFY rank <= 5""",
)
def hybrid(spark, sf_dir):
    hits = R.vector_topk(*_vectors(spark, sf_dir), k=10), R.lexical_topk(*_texts(spark, sf_dir), k=10)
    return R.reranked(*hits, *_texts(spark, sf_dir), 5).na.fill(0, ["vrank", "lrank"])


@query("dynamic_k", "SELECT conv_id, turn, least(6, greatest(3, CASE WHEN length(text) <= 10 THEN 3 WHEN length(text) <= 22 THEN 4 ELSE 5 END + CAST(regexp_matches(text, '[,，;；、]|以及|同时|分别') AS INTEGER))) AS k FROM conversations WHERE role = 'user'")
def dynamic_k(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", R.dynamic_k(F.col("text")).alias("k"))


@query(
    "context_first_wins",
    "WITH f AS (SELECT user_id AS conv_id, event_id % 17 AS item_id, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2) SELECT conv_id, item_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seen, item_id) AS INTEGER) AS place FROM f QUALIFY place <= 12",
)
def context(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("ts").alias("step"), F.col("event_id").alias("rank"), (F.col("event_id") % 17).alias("item_id"))
    return R.context(hits)
