"""Lookups, summaries, histograms, ceilings, checks between tables, and small text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.numeric import jround, stable


def by_id(rows: DataFrame, column: str, wanted: str, valid: str = "[a-zA-Z0-9-]+") -> DataFrame:
    """The row of an id, none for an id that is not well formed. The comparison reaches the scan."""
    return rows.where(F.col(column) == F.lit(wanted).cast(rows.schema[column].dataType)) if re.fullmatch(valid, wanted) else rows.limit(0)


def number_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, least and greatest of the numbers that are there, rounded to 6; null where there is none."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), stable(F.avg(value), 6).alias("average"), jround(F.min(value), 6).alias("least"), jround(F.max(value), 6).alias("greatest"))


def telemetry(calls: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Per run: calls, tokens, whether any count is an estimate, timeouts, cost by prices a million tokens. calls: run_id, prompt_tokens, completion_tokens, estimated, timed_out."""
    out = calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.bool_or("estimated").alias("estimated"), F.count_if("timed_out").alias("timeouts"))
    cost = (F.col("prompt_tokens") * input_price + F.col("completion_tokens") * output_price) / 1e6
    return out.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "cost": jround(cost, 8)})


def histograms(rows: DataFrame, single: dict[str, Column], several: dict[str, Column]) -> DataFrame:
    """(section, value, n): counts of the values of each section, those of array sections one by one; nulls are left out. One pass, one shuffle."""
    named = lambda section, values: F.transform(values, lambda v: F.struct(F.lit(section).alias("section"), v.cast("string").alias("value")))
    every = F.concat(*[named(k, F.array(v)) for k, v in single.items()], *[named(k, v) for k, v in several.items()])
    return rows.select(F.explode(every).alias("x")).where("x.value IS NOT NULL").groupBy("x.section", "x.value").agg(F.count("*").alias("n"))


def cost_ceilings(rows: DataFrame, multiplier: float, *by: str) -> DataFrame:
    """Ceilings with a margin: of tokens, and of an amount in exact decimals. rows: tokens (long), amount."""
    exact = F.sum(F.col("amount").cast("decimal(18,2)")) * F.lit(multiplier).cast("decimal(6,2)")
    return rows.groupBy(*by).agg(F.ceil(F.sum("tokens") * F.lit(multiplier)).alias("tokens"), F.ceil(exact).cast("long").alias("amount"))


def best_round(rows: DataFrame) -> DataFrame:
    """Per seed the best run (score descending, round, id), the least score of its rounds and the gap between best and least. rows: seed_id, round, run_id, score."""
    out = rows.groupBy("seed_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "round", "run_id")).alias("b"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("rounds"))
    return out.select("seed_id", "b.run_id", F.col("b.round").alias("round"), "rounds", jround("high", 6).alias("score"), jround("low", 6).alias("pair_minimum"), jround(F.col("high") - F.col("low"), 6).alias("pair_gap"))


def recent(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The newest rows, 1 to 200 of them."""
    return rows.orderBy(F.desc(at), F.asc(key)).limit(max(1, min(200, n)))


def ordered_union(first: Column, second: Column, most: int = 24) -> Column:
    """Different values of both lists in order of first sight, ``most`` at most."""
    return F.slice(F.array_distinct(F.concat(first, second)), 1, most)


def subset(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many different keys of ``left`` ``right`` lacks, and whether it lacks none."""
    lost = left.select(key).distinct().join(right.select(key), key, "left_anti")
    return lost.agg(F.count("*").alias("missing")).select("missing", (F.col("missing") == 0).alias("subset"))


def complete_join(plan: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row: rows of the plan, of the results, of their inner join, and whether all three agree. Counts per key, so no key's rows meet."""
    side = lambda d, p, r: d.groupBy(key).agg(F.count("*").alias("n")).select(key, (F.col("n") * p).alias("p"), (F.col("n") * r).alias("r"))
    both = side(plan, 1, 0).unionByName(side(results, 0, 1)).groupBy(key).agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    out = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("p"), "planned"), (F.col("r"), "found"), (F.col("p") * F.col("r"), "joined"))])
    return out.withColumn("complete", (F.col("planned") == F.col("found")) & (F.col("found") == F.col("joined")))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants, 0 where the end comes first."""
    return F.greatest(F.lit(0).cast("long"), F.unix_millis(end) - F.unix_millis(start))


def breaker_state(calls: DataFrame, threshold: int, cooldown: str, now: Column) -> DataFrame:
    """Per agent: failures since the last success, until when the breaker is open (null: closed), and whether it is open at ``now``.

    calls: agent, at, event_id, ok. Two aggregates: no agent's calls meet in one task.
    """
    last = calls.where("ok").groupBy("agent").agg(F.max(F.struct("at", "event_id")).alias("good"))
    bad = calls.where("NOT ok").join(last, "agent", "left").where(F.col("good").isNull() | (F.struct("at", "event_id") > F.col("good")))
    out = calls.select("agent").distinct().join(bad.groupBy("agent").agg(F.count("*").alias("failures"), F.max("at").alias("failed_at")), "agent", "left")
    until = F.when(F.col("failures") >= threshold, F.col("failed_at") + F.expr(cooldown))
    return out.select("agent", F.coalesce("failures", F.lit(0)).alias("failures"), until.alias("open_until"), F.coalesce(now < until, F.lit(False)).alias("open"))


def first_prefix(text: Column, prefixes: list[tuple[str, str]], other: str) -> Column:
    """The route of the first listed prefix that the text begins with."""
    out = None
    for prefix, route in prefixes:
        out = F.when(F.startswith(text, F.lit(prefix)), route) if out is None else out.when(F.startswith(text, F.lit(prefix)), route)
    return out.otherwise(other) if out is not None else F.lit(other)


def excerpt(text: Column, most: int = 120) -> Column:
    """White space single and trimmed; beyond ``most`` characters cut, with an ellipsis."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def context_block(documents: Column) -> Column:
    """Numbered documents (array of source, text) as one context: a heading line for each, rules between them."""
    one = lambda d, i: F.concat(F.lit("[来源 "), (i + 1).cast("string"), F.lit(" | "), d["source"], F.lit("]\n"), d["text"])
    return F.array_join(F.transform(documents, one), "\n---\n")


def ranked_quantiles(rows: DataFrame, value: str, probability: float, *by: str) -> DataFrame:
    """Two quantiles by index into the sorted values: floor(p (n - 1)), and (n - 1) p rounded half to even. Numbers are counted by value, values by
    their whole part, and only the whole part that holds an index is ranked: no task sorts a group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("part", F.when(F.isnan(F.col("v").cast("double")), F.lit(2**63 - 1)).otherwise(F.floor("v").cast("long")))
    parts = counts.groupBy(*by, "part").agg(F.sum("c").alias("s"))
    w = Window.partitionBy(*by)
    parts = parts.withColumn("n", F.sum("s").over(w)).withColumn("before", F.sum("s").over(w.orderBy("part")) - F.col("s"))
    exact = (F.col("n") - 1) * F.lit(probability)
    holds = lambda index: (F.col("before") <= index) & (index < F.col("before") + F.col("s"))
    parts = parts.where(holds(F.floor(exact)) | holds(F.rint(exact)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "part")]
    near = counts.alias("a").join(parts.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in by], "v", "c", "n", "before", F.col("a.part").alias("part"))  # two parts a group at most
    end = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "part").orderBy("v"))
    at = lambda index: F.max(F.when((F.col("start") <= index) & (index < F.col("end")), F.col("v")))
    ranked = near.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), at(F.floor(exact)).alias("by_floor"), at(F.rint(exact)).alias("by_round"))


def embedded_object(text: Column, schema: str) -> Column:
    """The object from the first to the last brace of a free text, parsed; null if it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
