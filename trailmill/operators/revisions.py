"""Draft or revision: both are brought to one form, scored against the question and its contract, and only a strictly better revision wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmill.functions.text import says
from trailmill.operators import contracts as C
from trailmill.operators.rule_reward import grounding, token_f1

# Points, marks and weights that must be these for right results.
PASSED, MISSED, CITED, LONG_ENOUGH, HONEST, EACH = 20, 5, 4, 3, 2, 1
SCALE, BLANK = 100_000, -(2**31)
FIRST_DAY = ["第一天", "第1天", "星期一", "周一", "Day 1", "Day1"]
LAST_DAY = ["第七天", "第7天", "星期日", "周日", "Day 7", "Day7"]
TOGETHER_CUES, TOGETHER = ["协调", "不要把责任全部推给一方"], ["协调", "共同", "双方", "轮换"]
STEP_LINE = r"(?m)^\s*(?:#{1,6}\s*)?(?:\d+[.、)]|[-*])\s*"
REFERENCE_SHARE, GROUNDING_SHARE = 0.10, 0.20


def candidate_score(question: Column, context: Column, answer: Column, terms: Column) -> Column:
    """Points in steps of ``SCALE``, and below that how near the answer is to the context. A blank answer has the least of all."""
    return C._let(_scored, q=F.coalesce(question, F.lit("")), context=F.coalesce(context, F.lit("")), answer=F.coalesce(answer, F.lit("")), terms=terms)


def _scored(q: Column, context: Column, answer: Column, terms: Column) -> Column:
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    weekly = F.contains(q, F.lit("七天小计划"))
    bounds = lambda k: F.when(weekly, C.WEEKLY_CHARS[k]).otherwise(C.CHARS[k])
    week = F.contains(q, F.lit("七天")) | (F.contains(q, F.lit("星期一")) & F.contains(q, F.lit("星期日")))
    missed = F.size(C.missing(terms, answer, context))
    score = (
        C._let(lambda missed: points(missed == 0, PASSED) - MISSED * missed, missed=missed)
        + points(C.citations_satisfied(answer, context), CITED)
        + points(F.length(answer).between(bounds(0), bounds(1)), LONG_ENOUGH)
        + points(~C._any(q, C.DIRECT_CUES) | ~C._any(answer, C.FOLLOW_UPS), EACH)
        + points(~week | (C._any(answer, FIRST_DAY) & C._any(answer, LAST_DAY)), EACH)
        + points(~C._any(q, C.THREE_CUES) | (F.size(F.regexp_extract_all(answer, F.lit(STEP_LINE), 0)) >= 3), EACH)
        + points(~C._any(q, C.ASSUMPTION_CUES) | C._any(answer, C.ASSUMPTION_MARKS), EACH)
        + points(~F.contains(q, F.lit("复盘")) | F.contains(answer, F.lit("复盘")), EACH)
        + points(~C._any(q, TOGETHER_CUES) | C._any(answer, TOGETHER), EACH)
        + points(~F.contains(q, F.lit(C.NO_COURSES_CUE)) | ~C._any(answer, C.NO_COURSES), HONEST)
    )
    near = F.floor((REFERENCE_SHARE * token_f1(answer, context) + GROUNDING_SHARE * grounding(answer, context)) * SCALE + 0.5)
    return F.when(says(answer), score.cast("long") * SCALE + near).otherwise(F.lit(BLANK).cast("long"))


def chosen(question: Column, context: Column, draft: Column, revised: Column, given: Column | None = None) -> Column:
    """A struct: answer (in its one form), winner (DRAFT or REVISED), draft_score, revised_score. given: a contract, to which the question's own
    demands are added; without one the question alone decides. Null texts are empty."""
    terms = C.inferred(question) if given is None else C.merged(given, question)

    def formed(terms: Column) -> Column:
        whole = lambda text: C.structured(C.canonical_citations(F.coalesce(text, F.lit(""))), terms)
        return C._let(scored, terms=terms, d=whole(draft), r=whole(revised))

    def scored(terms: Column, d: Column, r: Column) -> Column:
        return C._let(picked, d=d, r=r, a=candidate_score(question, context, d, terms), b=candidate_score(question, context, r, terms))

    def picked(d: Column, r: Column, a: Column, b: Column) -> Column:
        return F.struct(F.when(b > a, r).otherwise(d).alias("answer"), F.when(b > a, "REVISED").otherwise("DRAFT").alias("winner"), a.alias("draft_score"), b.alias("revised_score"))

    return C._let(formed, terms=terms)
