"""Training-corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of their docs, whatever those are; only doc_id, text, lang
and source are looked at. Of repeated rows one stays (near-dedup); null and empty texts fail the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import decontam, packing, quality, secret_scan, simhash
from trailmill.plans.shared_store import Store, small
from trailmill.sources.tables import table

#: No SQL states fingerprints or the packing; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
BROADCAST_ROWS = 500_000


def _wrapped(docs: DataFrame) -> DataFrame:
    """The text and the columns looked at, with all other columns in one struct, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"), "text")


def _unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col("_doc")[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _wrapped(docs).withColumns({"lang": F.col("_doc.lang"), "source": F.col("_doc.source")})
    return _unwrapped(quality.judged(rows, "verdict", store=Store(spark, "stage-quality")).where("verdict.kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = Store(spark, "stage-near-copies")
    rows = store.put(_wrapped(docs).withColumn("row", F.monotonically_increasing_id()))
    groups = simhash.similar(rows, store, key="row")
    ids = rows.select("row", F.coalesce(F.col("_doc.doc_id"), F.lit((1 << 63) - 1)).alias("id"))
    members = store.put(groups.join(ids, "row").select("component", F.struct("id", "row").alias("m")))
    first = store.put(members.groupBy("component").agg(F.min("m").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first"))
    first = F.broadcast(first) if small(first, BROADCAST_ROWS) else first
    gone = store.put(members.join(first, "component").where("m <> first").select(F.col("m.row").alias("row")))
    gone = F.broadcast(gone) if small(gone, BROADCAST_ROWS) else gone
    return _unwrapped(rows.join(gone, "row", "left_anti"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _wrapped(docs).withColumn("doc_id", F.col("_doc.doc_id"))
    return _unwrapped(decontam.clean(rows, table(spark, sf_dir, "benchmark"), Store(spark, "stage-decontam")), docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(_wrapped(docs), Store(spark, "stage-secrets"))
    spans = F.col("secrets.spans")
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), spans))
    if "n_chars" in docs.columns:
        n = F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
        clean = clean.withColumn("_doc", F.col("_doc").withField("n_chars", n))
    return _unwrapped(clean, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
