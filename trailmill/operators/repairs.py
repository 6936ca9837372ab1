"""Rendering of structured repairs: what a revision brought as evidence is set under the headings that its contract asks for.

Nothing is made up and nothing taken away: a missing concept gets a section only from evidence of its own, actions are added only if there
are enough, assumptions only if they say something; forbidden phrases stay and citations are not invented. The requirements are
folded in their order, each over the text that the ones before have left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmill.functions.text import WHITE, says
from trailmill.operators import contracts as C

#: A repair: evidence names a requirement by its id, by the concept or by the requirement's text.
REPAIR = "answer string, evidence array<struct<id: string, content: string>>, actions array<string>, assumptions string"
# Limits, headings and marks that must be these for right results.
EVIDENCE, ACTIONS, ANSWER_CHARS, CONTENT_CHARS = 24, 20, 8000, 1600
EVIDENCE_CHARS, ACTION_CHARS = 8, 4
ACTION_HEADING, ASSUMPTION_HEADING, CONCEPT_REQUIREMENT = "行动项", "合理假设", "覆盖概念："
LEADING_MARKS = r"^\s*(?:(?:10|[1-9])[.、)）]\s*)+"


def _bounded(text: Column, most: int) -> Column:
    return F.substring(C._trimmed(F.coalesce(text, F.lit(""))), 1, most)


def bounded(repair: Column) -> Column:
    """The repair within its limits: texts trimmed and cut, evidence without a name and blank or repeated actions left out."""
    evidence = F.transform(F.coalesce(repair["evidence"], F.array().cast("array<struct<id: string, content: string>>")), lambda e: F.struct(C._trimmed(F.coalesce(e["id"], F.lit(""))).alias("id"), _bounded(e["content"], CONTENT_CHARS).alias("content")))
    actions = F.transform(F.coalesce(repair["actions"], F.array().cast("array<string>")), lambda a: _bounded(a, CONTENT_CHARS))
    return F.struct(
        _bounded(repair["answer"], ANSWER_CHARS).alias("answer"),
        F.slice(F.array_distinct(F.filter(evidence, lambda e: says(e["id"]))), 1, EVIDENCE).alias("evidence"),
        F.slice(F.array_distinct(F.filter(actions, says)), 1, ACTIONS).alias("actions"),
        _bounded(repair["assumptions"], CONTENT_CHARS).alias("assumptions"),
    )


def _appended(text: Column, heading: Column | str, content: Column) -> Column:
    heading = F.lit(heading) if isinstance(heading, str) else heading
    return F.concat(F.regexp_replace(text, f"[{WHITE}]+$", ""), F.lit("\n\n**"), heading, F.lit("**"), content)


def _evidence(evidence: Column, concept: Column, i: Column) -> Column:
    named = lambda e: e["id"].isin(concept) | (e["id"] == C._numbered("concept-", i)) | (e["id"] == F.concat(F.lit(CONCEPT_REQUIREMENT), concept))
    return F.coalesce(F.get(F.filter(evidence, lambda e: named(e) & says(e["content"])), F.lit(0))["content"], F.lit(""))


def rendered(terms: Column, repair: Column, context: Column) -> Column:
    """A struct: answer, accepted (anything was added), sections, actions, assumed, missing (id, requirement). A repair without an answer gives
    an empty one and adds nothing."""
    return C._let(_rendered, terms=terms, repair=bounded(repair), context=F.coalesce(context, F.lit("")))


def _rendered(terms: Column, repair: Column, context: Column) -> Column:
    has = says(repair["answer"])
    concepts = F.transform(terms["concepts"], lambda c, i: F.struct(c.alias("c"), i.alias("i"), _evidence(repair["evidence"], c, i).alias("e")))
    usable = F.filter(concepts, lambda x: F.length(x["e"]) >= EVIDENCE_CHARS)

    def section(state: Column, x: Column) -> Column:
        def judged(text: Column, x: Column, n: Column) -> Column:
            met = C._let(lambda seen, c: C.covered(seen, c, C.observed_actions(seen)), seen=C.structured(text, terms), c=x["c"])
            more = _appended(text, F.element_at(C._alternatives_or_blank(x["c"]), 1), F.concat(F.lit("："), x["e"]))
            return C._let(lambda met, text, more, n: F.struct(F.when(met, text).otherwise(more).alias("text"), F.when(met, n).otherwise(n + 1).alias("n")), met=met, text=text, more=more, n=n)

        return C._let(judged, text=state["text"], x=x, n=state["n"])

    start = F.struct(C.structured(repair["answer"], terms).alias("text"), F.lit(0).alias("n"))
    told = F.aggregate(usable, start, section)
    full = C._let(lambda told: _finished(told, terms, repair, context), told=told)
    none = F.struct(F.lit("").alias("answer"), F.lit(False).alias("accepted"), F.lit(0).alias("sections"), F.lit(0).alias("actions"), F.lit(False).alias("assumed"), C.missing(terms, F.lit(""), context).alias("missing"))
    return F.when(has, full).otherwise(none)


def _finished(told: Column, terms: Column, repair: Column, context: Column) -> Column:
    wanted = F.coalesce(terms["actions"], F.lit(0))
    plain = F.array_distinct(F.filter(F.transform(repair["actions"], lambda a: C._trimmed(F.regexp_replace(a, LEADING_MARKS, ""))), lambda a: F.length(a) >= ACTION_CHARS))

    # Every text that is looked at more than once is bound first: named twice, an expression is worked out twice.
    def acting(seen: Column, wanted: Column, plain: Column) -> Column:
        return C._let(acted, short=(wanted > 0) & (F.size(plain) >= wanted) & (C.observed_actions(seen) < wanted), wanted=wanted, plain=plain)

    def acted(short: Column, wanted: Column, plain: Column) -> Column:
        steps = F.transform(F.slice(plain, 1, F.greatest(wanted, F.lit(1))), lambda a, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), a))
        text = F.when(short, _appended(told["text"], ACTION_HEADING, F.array_join(steps, ""))).otherwise(told["text"])
        return C._let(assuming, text=text, acted=F.when(short, wanted).otherwise(0))

    def assuming(text: Column, acted: Column) -> Column:
        return C._let(assumed, text=text, acted=acted, seen=C.structured(text, terms))

    def assumed(text: Column, acted: Column, seen: Column) -> Column:
        open_ = F.coalesce(terms["assume"], F.lit(False)) & ~C._any(seen, C.ASSUMPTION_MARKS) & (F.length(repair["assumptions"]) >= EVIDENCE_CHARS)
        return C._let(ending, text=text, actions=acted, open=open_)

    def ending(text: Column, actions: Column, open: Column) -> Column:
        last = F.when(open, _appended(text, ASSUMPTION_HEADING, F.concat(F.lit("："), repair["assumptions"]))).otherwise(text)
        return C._let(closed, text=C.structured(last, terms), actions=actions, open=open)

    def closed(text: Column, actions: Column, open: Column) -> Column:
        return F.struct(text.alias("answer"), ((told["n"] > 0) | (actions > 0) | open).alias("accepted"), told["n"].alias("sections"), actions.alias("actions"), open.alias("assumed"), C.missing(terms, text, context).alias("missing"))

    return C._let(acting, seen=C.structured(told["text"], terms), wanted=wanted, plain=plain)
