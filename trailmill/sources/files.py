"""File sources and sinks: run and assessment JSON, JSONL with validation, Markdown corpora, web pages, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.plans.shared_store import Store

STEP = "struct<stepId:string,type:string,startedAt:timestamp,durationMs:bigint,success:boolean,input:string,output:string>"
RUN_SCHEMA = (
    f"trajectoryId string, chatId string, policyVersion string, model string, question string, startedAt timestamp, completedAt timestamp, status string, steps array<{STEP}>, retrievedDocumentIds array<string>, finalAnswer string, "
    "reward struct<total:double,retrievalQuality:double,groundingQuality:double,convergenceQuality:double,taskCompletionQuality:double,collaborationQuality:double,efficiency:double,userFeedback:double>, userRating int, feedbackComment string, "
    "telemetry struct<model:string,modelCallCount:int,promptTokens:int,completionTokens:int,totalTokens:int,usageEstimated:boolean,estimatedCostCny:double,timeoutCount:int>, error string"
)


def _strip(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per run; any bad file fails the read."""
    return spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(folder)


def route_field(runs: DataFrame, name: str, kind: str = "string"):
    """A field of the first ROUTE step's output."""
    first = F.try_element_at(F.filter("steps", lambda s: s["type"] == "ROUTE"), F.lit(1))
    return F.get_json_object(first["output"], f"$.{name}").cast(kind)


def observations(runs: DataFrame) -> DataFrame:
    """The flat view that the policy operators read. Costs are null where there is no telemetry."""
    return runs.select(
        F.col("trajectoryId").alias("run_id"), route_field(runs, "featureBucket").alias("bucket"), route_field(runs, "mode").alias("mode"), "status", F.coalesce("completedAt", "startedAt", F.timestamp_seconds(F.lit(0))).alias("completed_at"),
        F.col("reward.total").alias("reward"), F.col("reward.groundingQuality").alias("grounding"), F.col("telemetry.estimatedCostCny").alias("cost"),
        F.coalesce(F.aggregate(F.transform("steps", lambda s: F.coalesce(s["durationMs"], F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("latency_ms"),
        route_field(runs, "policyRolloutMode").alias("rollout"), F.coalesce(route_field(runs, "policyCanarySelected", "boolean"), F.lit(False)).alias("selected"),
        route_field(runs, "policyBehaviorActionProbability", "double").alias("probability"), F.coalesce(route_field(runs, "policyExplorationEligible", "boolean"), F.lit(False)).alias("exploration"),
    )


def read_quarantined(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad files) of a folder with one JSON object per file; a file that does not parse is set aside."""
    kept = T.StructType.fromDDL(schema).add("_corrupt", "string")
    files = spark.read.text(folder, wholetext=True).withColumn("file", F.input_file_name())
    rows = files.select("file", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), rows.where("r._corrupt IS NOT NULL").select("file", "r._corrupt")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of JSON lines; blank lines and lines that begin with # are skipped."""
    lines = spark.read.text(path).withColumn("value", _strip("value")).where("value <> '' AND NOT startswith(value, '#')")
    parsed = lines.select("value", F.from_json("value", T.StructType.fromDDL(schema).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value")


def numbered_lines(spark: SparkSession, path: str, store: Store) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1. A long file is read in blocks by many tasks: within a block the
    lines' order is that of one task's rows, and what lies before a block is the sum of the counts of the blocks before it. So
    nothing is sorted, and the only rows that meet are one for each block of a file."""
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = store.put(spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("row")))
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), "value")


def checked_jsonl(spark: SparkSession, path: str, schema: str, store: Store, required: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """The rows of JSON lines with ``file`` and ``line``, if all of them are right. Else a ``ValueError`` names the first bad line of each kind
    by its number: no JSON object of this schema, a required field that is null or blank, a key that an earlier line has. Blank lines
    and lines that begin with # are skipped, and counted."""
    kept = T.StructType.fromDDL(schema).add("_bad", "string")
    lines = numbered_lines(spark, path, store).withColumn("value", _strip("value")).where("value <> '' AND NOT startswith(value, '#')")
    rows = lines.select("file", "line", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.get_json_object("value", "$").alias("o"))
    broken = F.col("r._bad").isNotNull() | F.col("o").isNull() | ~F.startswith(F.coalesce("o", F.lit("")), F.lit("{"))
    empty = [F.when(F.col(f"r.{c}").isNull() | (_strip(F.col(f"r.{c}").cast("string")) == ""), f"no {c}") for c in required]
    rows = store.put(rows.select("file", "line", "r", F.when(broken, "not an object of the schema").otherwise(F.coalesce(*empty, F.lit(None).cast("string"))).alias("fault")))
    faults = rows.where("fault IS NOT NULL").select("file", "line", "fault")
    if key:
        again = rows.where("fault IS NULL").groupBy(F.col(f"r.{key}").alias("k")).agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("first")).where("n > 1")
        twice = rows.join(again, F.col(f"r.{key}") == F.col("k")).where(F.struct("file", "line") > F.col("first"))
        faults = faults.unionAll(twice.select("file", "line", F.lit(f"repeats {key}")))
    found = faults.groupBy("fault").agg(F.min(F.struct("file", "line")).alias("at"), F.count("*").alias("n")).orderBy("at").collect()  # one row a kind
    if found:
        told = "; ".join(f"{r['at']['file'].rsplit('/', 1)[-1]}:{r['at']['line']}: {r['fault']}" + (f" (and {r['n'] - 1} more)" if r["n"] > 1 else "") for r in found)
        raise ValueError(told)
    return rows.select("file", "line", "r.*").drop("_bad")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part between horizontal rules, without code blocks and quotes; the status is spelled before the extension."""
    files = spark.read.text(folder, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    plain = F.regexp_replace(F.regexp_replace("value", r"(?s)```.*?```", ""), r"(?m)^>.*$", "")
    parts = files.select("file", F.posexplode(F.split(plain, r"(?m)^\s*(?:---+|\*\*\*+|___+)\s*$")).alias("part", "text"))
    return parts.withColumn("text", _strip("text")).where("text <> ''").withColumn("status", F.expr("substring(file, length(file) - 5, 2)"))


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """One row per level-4 section: title, body and its SHA-256."""
    files = spark.read.text(folder, wholetext=True).withColumn("file", F.input_file_name())
    found = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?ms)^####\s+(.+?\n.*?)(?=^#{1,4}\s|\z)"), 1)).alias("section", "s"))
    title, body = _strip(F.substring_index("s", "\n", 1)), _strip(F.expr("substr(s, instr(s, chr(10)) + 1)"))
    return found.select("file", "section", title.alias("title"), body.alias("answer"), F.sha2(F.concat_ws("\n", title, body), 256).alias("fingerprint"))


def page_fields(pages: DataFrame, most: int = 2000) -> DataFrame:
    """Title, description and the raw article, main or body part of each page, and its text cut to ``most`` characters for display."""
    part = lambda tag: F.regexp_extract("html", f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    out = pages.withColumn("title", F.trim(part("title"))).withColumn("description", F.regexp_extract("html", r"<meta\s+name=\"description\"\s+content=\"([^\"]*)\"", 1))
    out = out.withColumn("article", F.coalesce(*[F.when(part(t) != "", part(t)) for t in ("article", "main", "body")], F.lit("")))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("article", r"(?is)<(script|style|nav|aside|form)\b.*?</\1>", " "), "<[^>]+>", " "), r"\s+", " "))
    return out.withColumn("excerpt", F.substring(plain, 1, most))


def write_jsonl(lines: DataFrame, path: str) -> None:
    """Text lines (column value); the folder appears only when the job has committed."""
    lines.select("value").write.mode("overwrite").text(path)


def write_once(spark: SparkSession, report: DataFrame, folder: str, report_id: str) -> bool:
    """Writes a report under its content id unless it is there already; whether it wrote."""
    path = f"{folder.rstrip('/')}/{report_id[:16]}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    report.write.mode("overwrite").json(path)
    return True


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of both tables, changes first on equal versions; write it to a new folder and swap by name."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_new")]
    picked = both.groupBy(key).agg(F.max(F.struct(version, "_new", *[c for c in columns if c != version])).alias("r"))
    return picked.select(key, *[F.col("r")[c].alias(c) for c in columns])
