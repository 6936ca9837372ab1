"""Generation of training questions from a product of parts, tested against a benchmark as they are made.

The product is never joined out. A candidate is one number, and its parts are the digits of that number in a mixed radix; a
block of numbers is a range that Spark deals over its tasks. Blocks grow, and none is made once enough candidates
passed. What is kept and counted is what a loop over the numbers in order would keep and count that stops at the target:
the last number is found by counts of number ranges, not by one ordered partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.functions.text import compact
from trailmill.operators.datasets import contained, could_be_inside, near_any
from trailmill.plans.shared_store import Store

_RANGE = 4096


def digits(ordinal: Column, radix: Mapping[str, int]) -> dict[str, Column]:
    """The digits of a number, the first name's the slowest: ordinal = ((a * size_b + b) * size_c + c) ..."""
    out, below = {}, 1
    for name, size in reversed(radix.items()):
        out[name] = F.floor(ordinal / F.lit(below)).cast("long") % F.lit(size) if below > 1 else ordinal % F.lit(size)
        below *= size
    return {name: out[name] for name in radix}


def against_benchmark(questions: DataFrame, benchmark: DataFrame, threshold: float, shortest: int = 12) -> DataFrame:
    """Adds ``verdict`` to (ordinal, question): exact (same normal form or trigrams, or one inside the other), near, or null. benchmark:
    item_id, text."""
    # The verdict is that of the normal form, so one candidate and one item stand for all of their form.
    forms = questions.withColumn("_form", compact(F.coalesce("question", F.lit(""))))
    q = forms.groupBy("_form").agg(F.min(F.struct("ordinal", F.col("question").alias("text"))).alias("one")).select("one.*")
    b = benchmark.groupBy(compact(F.coalesce("text", F.lit(""))).alias("_form")).agg(F.min(F.struct("item_id", "text")).alias("one")).select("one.*")
    near = near_any(q.withColumnRenamed("ordinal", "left_id"), b.select(F.col("item_id").alias("right_id"), "text"), threshold)
    inside = contained(q.withColumnRenamed("ordinal", "doc_id"), b, shortest).select(F.col("doc_id").alias("left_id"))
    holders = b.select(F.col("item_id").alias("doc_id"), "text")
    around = contained(holders, could_be_inside(q.withColumnRenamed("ordinal", "item_id"), holders), shortest).select(F.col("item_id").alias("left_id"))
    hits = near.unionAll(inside.unionAll(around).withColumn("same", F.lit(True)))
    verdicts = hits.groupBy(F.col("left_id").alias("ordinal")).agg(F.when(F.max("same"), "exact").otherwise("near").alias("verdict"))
    by_form = q.select("ordinal", compact(F.coalesce("text", F.lit(""))).alias("_form")).join(verdicts.hint("merge"), "ordinal").select("_form", "verdict")
    return forms.join(by_form.hint("merge"), "_form", "left").drop("_form")


def nth(df: DataFrame, order: str, n: int) -> int | None:
    """The n-th smallest (from 1) of a column of different whole numbers. Counts by range go to the driver, and one range's numbers."""
    left = n
    for r in sorted(df.groupBy(F.floor(F.col(order) / _RANGE).alias("r")).count().collect()):
        if left <= r["count"]:
            return sorted(x[0] for x in df.where(F.floor(F.col(order) / _RANGE) == r["r"]).select(order).collect())[left - 1]
        left -= r["count"]
    return None


def placed(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds each row's place (from 0) in the order of different whole numbers: the place within a range of numbers, and what is before it."""
    keyed = df.withColumn("_r", F.floor(F.col(order) / _RANGE))
    before = keyed.groupBy("_r").count().withColumn("_before", F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    return keyed.join(before, "_r").withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(Window.partitionBy("_r").orderBy(order)) - 1).drop("_r", "_before")


@dataclass
class Made:
    """accepted: ordinal, question and the digits; exact, near: candidates turned away before the last that was needed; tried: candidates
    that were looked at, up to and with the last; blocks: how many were made."""

    accepted: DataFrame
    exact: int
    near: int
    tried: int
    blocks: int


def generated(
    spark: SparkSession,
    radix: Mapping[str, int],
    question: Callable[[DataFrame], DataFrame],
    benchmark: DataFrame,
    target: int,
    threshold: float,
    store: Store,
    suits: Column | None = None,
    taken: DataFrame | None = None,
    first_block: int | None = None,
    fewer: bool = False,
) -> Made:
    """The first ``target`` candidates that are new, clean and suit. question: from a frame of ordinal and digits to one with
    ``question``; suits: over its columns; taken: normal forms (``form``) that others have taken. Fewer than the target is an error, unless ``fewer`` takes what there is; then counts go up
    to the last that was taken, as they do otherwise."""
    if target < 1 or not 0 < threshold < 1:
        raise ValueError("a target of one at least and a threshold between 0 and 1 are needed")
    total = 1
    for size in radix.values():
        total *= size
    at, size, found, blocks = 0, first_block or 4 * target, 0, 0
    exact = near = last = 0
    kept: list[DataFrame] = []
    verdicts: list[DataFrame] = []
    while at < total and found < target:
        upto = min(total, at + size)
        ids = spark.range(at, upto).withColumnRenamed("id", "ordinal")
        made = question(ids.withColumns(digits(F.col("ordinal"), radix))).withColumn("form", compact(F.col("question")))
        judged = store.put(against_benchmark(store.put(made.withColumn("suits", F.lit(True) if suits is None else F.coalesce(suits, F.lit(False)))), benchmark, threshold))
        first = judged.where("verdict IS NULL AND suits").groupBy("form").agg(F.min("ordinal").alias("ordinal"))
        for seen in [*([taken] if taken is not None else []), *(k.select("form") for k in kept)]:
            first = first.join(seen.hint("merge"), "form", "left_anti")
        first = store.put(first)
        n, last = first.count(), upto - 1
        if found + n >= target:
            last = nth(first, "ordinal", target - found)
            first = first.where(F.col("ordinal") <= last)
        counts = judged.where(F.col("ordinal") <= last).agg(F.count_if(F.col("verdict") == "exact").alias("e"), F.count_if(F.col("verdict") == "near").alias("n")).first()
        exact, near, found, blocks = exact + counts["e"], near + counts["n"], min(target, found + n), blocks + 1
        verdicts.append(judged.select("ordinal", "verdict"))
        kept.append(judged.join(first.select("ordinal").hint("merge"), "ordinal").drop("verdict", "suits"))
        at, size = upto, 2 * size
    if found < target and not (fewer and found):
        raise ValueError(f"only {found} clean candidates of {total}; {target} were asked for")
    accepted = kept[0]
    for more in kept[1:]:
        accepted = accepted.unionByName(more)
    if found < target:
        last = accepted.agg(F.max("ordinal")).first()[0]
        upto_last = [v.where(F.col("ordinal") <= last).agg(F.count_if(F.col("verdict") == "exact"), F.count_if(F.col("verdict") == "near")).first() for v in verdicts]
        exact, near = (sum(r[k] for r in upto_last) for k in (0, 1))
    return Made(accepted, exact, near, last + 1, blocks)


def shares(target: int, ratio: float) -> tuple[int, int]:
    """How many of a target are of the first and the second kind; each gets one at least where its share is not 0."""
    second = int(target * ratio)
    if target > 1 and ratio > 0 and second == 0:
        second = 1
    if target > 1 and ratio < 1 and second == target:
        second -= 1
    return target - second, second


def interleaved(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists in turn (``position``), the rest of the longer one after: first, second, first, second, ..."""
    a, b = placed(first, "ordinal", "k"), placed(second, "ordinal", "k")
    n, m = first.count(), second.count()
    turn = lambda k, other, late: k + F.least(k + late, F.lit(other))
    return a.withColumn("position", turn(F.col("k"), m, 0)).unionByName(b.withColumn("position", turn(F.col("k"), n, 1)), allowMissingColumns=True).drop("k")
