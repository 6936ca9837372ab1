"""Text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.catalog import query
from trailmill.functions import text as T
from trailmill.functions.numeric import java_hash, jround
from trailmill.plans.views import jround_sql as R
from trailmill.sources.tables import table

_HAN = "\\p{Han}"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("text_normal_forms", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS question, sha256(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS compact FROM documents")
def text_normal_forms(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("question"), F.sha2(T.compact(F.col("text")), 256).alias("compact"))


@query("repeated_lines", f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 8) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) < 2 THEN 0 ELSE {R('(len(l) - len(list_distinct(l))) / len(l)::DOUBLE', 6)} END AS ratio FROM l")
def repeated_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", jround(T.repeated_line_ratio(F.col("text")), 6).alias("ratio"))


@query("token_estimate", f"SELECT doc_id, CAST(CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) = 0 THEN 0 ELSE greatest(1, length(regexp_replace(text, '[^{_HAN}]', '', 'g')) + ceil(length(regexp_replace(text, '[\\s{_HAN}]', '', 'g')) / 4.0)) END AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("length_quality", f"SELECT doc_id, {R('CASE WHEN length(text) = 0 THEN 0 WHEN length(text) < 400 THEN length(text) / 400.0::DOUBLE WHEN length(text) > 3000 THEN 3000 / length(text)::DOUBLE ELSE 1 END', 6)} AS quality FROM documents")
def length_quality(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", jround(T.length_quality(F.col("text"), F.lit(400), F.lit(3000)), 6).alias("quality"))


@query("text_structure", "SELECT doc_id, greatest(len(regexp_extract_all(text, '(?m)^\\s*[0-9]{1,2}[.、)]\\s*\\S')), len(regexp_extract_all(text, '(?m)^\\s*[-*•]\\s+\\S')), len(regexp_extract_all(text, '第[0-9一二三四五六七八九十]+天'))) AS actions, len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[^|]', '', 'g')) >= 2)) AS table_lines FROM documents")
def text_structure(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.action_items(F.col("text")).cast("long").alias("actions"), T.table_lines(F.col("text")).cast("long").alias("table_lines"))


@query("stable_hash", "SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM documents")
def stable_hash(spark, sf_dir):
    """The hash of every whole text; null counts as empty."""
    return _docs(spark, sf_dir).select("doc_id", java_hash(F.coalesce("text", F.lit(""))).alias("h"))


@query("stable_hash_key", "SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM documents")
def stable_hash_key(spark, sf_dir):
    """The hash of the whole routing key (doc_id as text) for every row."""
    return _docs(spark, sf_dir).select("doc_id", java_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))


@query("concept_coverage", f"SELECT doc_id, {R('(CAST(contains(lower(text), $$the$$) OR contains(lower(text), $$der$$) AS INTEGER) + CAST(contains(lower(text), $$ing$$) AS INTEGER)) / 2.0::DOUBLE', 6)} AS coverage FROM documents")
def concept_coverage(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", jround(T.concept_coverage(F.col("text"), F.array(F.lit("the|der"), F.lit("ing"))), 6).alias("coverage"))


@query("page_titles", "SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, length(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)) AS article_chars FROM pages")
def page_titles(spark, sf_dir):
    from trailmill.sources.files import page_fields

    return page_fields(table(spark, sf_dir, "pages")).select("page_id", "title", F.length("article").cast("long").alias("article_chars"))
