"""Answer contracts: what a question asks of its answer, what an answer still misses, and audits of such findings.

A contract is a struct column; requirements are structs of a stable ``id`` and their text. All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, phrases and patterns that must be these for right results.
ITEMS, ITEM_CHARS = 24, 80
CHARS, WEEKLY_CHARS = (140, 1600), (320, 2400)
CONCEPT_CUES = [
    (["十五分钟", "15分钟"], ["15分钟|十五分钟"]),
    (["话术"], ["话术|可以这样说"]),
    (["七天"], ["周一|星期一|第一天|第1天", "周日|星期日|第七天|第7天"]),
    (["复盘", "回顾"], ["复盘|回顾"]),
    (["优先级", "排序"], ["优先级|排序"]),
]
DIRECT_CUES = ["不要追问", "不要继续追问", "不要反复追问", "直接给"]
ASSUMPTION_CUES = ["标明合理假设", "标明假设"]
THREE_CUES = ["三项", "三个", "检查清单"]
NO_COURSES_CUE, NO_COURSES = "不要编造课程或案例", ["推荐课程", "课程链接", "真实案例"]
FOLLOW_UPS = ["请你详细描述", "请详细描述", "请补充更多", "请提供更多", "接下来，请你", "以便我为你"]
ASSUMPTION_MARKS = ["假设", "基于目前", "基于现有", "信息不足"]
ALIASES = {
    "情绪管理": ["正视情绪", "缓解焦虑", "调节情绪", "应对焦虑"],
    "原因": ["根源", "成因"],
    "优先级|排序": ["优先处理", "按优先顺序"],
    "今天|立即": ["今日", "今晚", "当日"],
}
DAYS = [
    ["周一", "星期一", "第一天", "第1天"],
    ["周二", "星期二", "第二天", "第2天"],
    ["周三", "星期三", "第三天", "第3天"],
    ["周四", "星期四", "第四天", "第4天"],
    ["周五", "星期五", "第五天", "第5天"],
    ["周六", "星期六", "第六天", "第6天"],
    ["周日", "周天", "星期日", "星期天", "第七天", "第7天"],
]
THREE_WORDS, FIRST_DAY_WORDS, LAST_DAY_WORDS = ["三项", "3项", "三个", "3个"], ["周一", "星期一"], ["周日", "周天", "星期日", "星期天"]
NUMBERED = r"(?<![\p{L}\p{N}])(10|[1-9])[.、)）](?!\d)(?=\s*\S)"
BULLETS = r"(?m)^\s*(?:#{1,6}\s*)?[-*]\s+"
BULLET_MARKS, INLINE_STEP_MARKS = ["-", "*"], ["：", "；", ";"]
INLINE_STEP = r"([：；;])\s*((?:10|[1-9])[.、)）])(?!\d)\s*"
NUMBERS = r"\d{1,3}(?:\s*[,，、]\s*\d{1,3})*"
CITATION_FORMS = [
    r"\[来源\s*(\d{1,3}(?:\s*[,，、]\s*\d{1,3})+)\]",
    rf"(?:参考)?来源\s*[:：]?\s*\[({NUMBERS})\]",
    rf"[（(]\s*(?:依据|参考)?来源\s*[:：]?\s*({NUMBERS})\s*[）)]",
    rf"(?<!\[)(?:依据|参考)?来源\s*[:：]?\s*({NUMBERS})(?!\s*\])",
]

_TYPE = "concepts array<string>, forbidden array<string>, least_chars int, most_chars int, cite boolean, direct boolean, assume boolean, actions int"
_OPEN, _CLOSE = "\x01", "\x02"


#: Bounds of a contract's numbers; one outside is an error (fixed values).
LEAST_CHARS, MOST_CHARS, ACTIONS = (0, 8000), (1, 8000), (0, 20)


def _let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of values that are worked out once a row, however often it names them: variables of a lambda are not inlined."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(bound, lambda x: body(**{k: x[k] for k in values})), 1)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _alternatives(expression: Column) -> Column:
    return F.filter(F.transform(F.split(expression, "[|]"), _trimmed), lambda a: a != "")


def canonical_citations(text: Column) -> Column:
    """Source lists of four forms as single ``[来源 n]`` marks, each number of a list once; null stays null.

    A list is set between two control characters before it is taken apart; texts do not hold those around numbers.
    """
    for form in CITATION_FORMS:
        text = F.regexp_replace(text, form, f"{_OPEN}$1{_CLOSE}")
    head = rf"^{_OPEN}({NUMBERS}){_CLOSE}"

    def expanded(piece: Column) -> Column:
        numbers = F.array_distinct(F.split(F.regexp_extract(piece, head, 1), r"\s*[,，、]\s*"))
        marks = F.transform(numbers, lambda n: F.concat(F.lit("[来源 "), n.cast("int").cast("string"), F.lit("]")))
        return F.when(piece.rlike(head), F.concat(F.array_join(marks, ""), F.regexp_replace(piece, head, ""))).otherwise(piece)

    return F.array_join(F.transform(F.split(text, f"(?={_OPEN})"), expanded), "")


def citations_satisfied(answer: Column, context: Column) -> Column:
    """True where the context numbers no source; else the answer cites one at least, and none that is not there."""
    numbers = lambda text, form: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(form), 1), lambda x: x.cast("int"))
    known, cited = numbers(context, r"\[来源\s+(\d{1,3})\s*\|"), numbers(answer, r"\[来源\s*(\d{1,3})\]")
    return (F.size(known) == 0) | ((F.size(cited) > 0) & (F.size(F.array_except(cited, known)) == 0))


def _items(values: Column) -> Column:
    """Trimmed, without blanks and repeats, the first 24; an item over 80 characters is an error."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), _trimmed), lambda x: x.rlike(r"\S"))), 1, ITEMS)
    error = F.raise_error(F.lit("a contract item is too long")).cast("array<string>")
    return _let(lambda kept: F.when(F.exists(kept, lambda x: F.length(x) > ITEM_CHARS), error).otherwise(kept), kept=kept)


def contract(concepts=None, forbidden=None, least_chars=None, most_chars=None, cite=None, direct=None, assume=None, actions=None) -> Column:
    """A contract of columns; what is not given is null, or empty for the two lists."""
    none = F.lit(None)
    given = [_items(none.cast("array<string>") if c is None else c) for c in (concepts, forbidden)]
    low, high, steps = (none if c is None else c.cast("int") for c in (least_chars, most_chars, actions))
    low, high, steps = (_within(c, *bounds) for c, bounds in ((low, LEAST_CHARS), (high, MOST_CHARS), (steps, ACTIONS)))
    high = F.when(low > high, F.raise_error(F.lit("a contract's least length is above its most")).cast("int")).otherwise(high)
    given += [low, high, *(none if c is None else c for c in (cite, direct, assume)), steps]
    names = [part.strip().split(" ") for part in _TYPE.split(", ")]
    return F.struct(*[c.cast(kind).alias(name) for c, (name, kind) in zip(given, names, strict=True)])


def _within(number: Column, low: int, high: int) -> Column:
    error = F.raise_error(F.lit(f"a contract's number is not between {low} and {high}")).cast("int")
    return F.when((number < low) | (number > high), error).otherwise(number)


def inferred(question: Column) -> Column:
    """The contract that a question states by itself; null counts as an empty question."""
    q = F.coalesce(question, F.lit(""))
    none = _strings([])
    concepts = F.concat(*[F.when(_any(q, cues), _strings(found)).otherwise(none) for cues, found in CONCEPT_CUES])
    weekly = F.contains(q, F.lit("七天小计划"))
    return contract(
        concepts,
        F.when(F.contains(q, F.lit(NO_COURSES_CUE)), _strings(NO_COURSES)).otherwise(none),
        F.when(weekly, WEEKLY_CHARS[0]).otherwise(CHARS[0]),
        F.when(weekly, WEEKLY_CHARS[1]).otherwise(CHARS[1]),
        None,
        _any(q, DIRECT_CUES),
        _any(q, ASSUMPTION_CUES),
        F.when(F.contains(q, F.lit("七天")), 7).when(_any(q, THREE_CUES), 3).otherwise(0),
    )


def merged(given: Column, question: Column) -> Column:
    """A given contract with what the question adds: lists joined, given limits first, demands of either."""
    own = inferred(question)
    either = lambda name: F.coalesce(given[name], F.lit(False)) | own[name]
    return contract(
        F.concat(given["concepts"], own["concepts"]),
        F.concat(given["forbidden"], own["forbidden"]),
        F.coalesce(given["least_chars"], own["least_chars"]),
        F.coalesce(given["most_chars"], own["most_chars"]),
        given["cite"],
        either("direct"),
        either("assume"),
        F.greatest(F.coalesce(given["actions"], F.lit(0)), own["actions"]),
    )


def structured(answer: Column, terms: Column) -> Column:
    """The answer with copied alternatives cut to the first one and, where actions are asked for, inline steps on lines of their own."""
    many = F.filter(terms["concepts"], lambda c: F.contains(c, F.lit("|")) & (F.element_at(_alternatives_or_blank(c), 1) != ""))
    plain = F.aggregate(many, F.coalesce(answer, F.lit("")), lambda text, c: F.replace(text, c, F.element_at(_alternatives_or_blank(c), 1)))
    return _let(lambda plain, actions: F.when((actions > 0) & _any(plain, INLINE_STEP_MARKS), F.regexp_replace(plain, INLINE_STEP, "$1\n$2 ")).otherwise(plain), plain=plain, actions=terms["actions"])


def _alternatives_or_blank(expression: Column) -> Column:
    return F.transform(F.split(expression, "[|]"), _trimmed)


def observed_actions(answer: Column) -> Column:
    """The largest of: numbers 1 to n without a gap, bullet lines, days of the week that are named.

    A pattern is tried only on a text that holds a mark which each of its matches holds.
    """
    tens = F.sequence(F.lit(1), F.lit(10))
    unbroken = lambda seen: F.aggregate(tens, F.lit(0), lambda n, _: F.when(F.array_contains(seen, (n + 1).cast("string")), n + 1).otherwise(n))
    ordinals = F.when(~F.contains(answer, F.lit("1")), 0).otherwise(_let(unbroken, seen=F.regexp_extract_all(answer, F.lit(NUMBERED), 1)))
    bullets = F.when(~_any(answer, BULLET_MARKS), 0).otherwise(F.size(F.regexp_extract_all(answer, F.lit(BULLETS), 0)))
    days = reduce(lambda a, b: a + b, [_any(answer, names).cast("int") for names in DAYS])
    return F.greatest(ordinals, bullets, days)


def covered(answer: Column, expression: Column, actions: Column) -> Column:
    """An alternative or a known alias is in the answer, or the count or day that the concept names."""
    ways = _alternatives(expression)
    aliases = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), _strings(v))])
    one_of = lambda words: F.arrays_overlap(ways, _strings(words))
    phrases = F.concat(ways, F.coalesce(F.try_element_at(aliases, expression), _strings([])))
    first, last = one_of(FIRST_DAY_WORDS), one_of(LAST_DAY_WORDS)
    return F.exists(phrases, lambda p: F.contains(answer, p)) | (one_of(THREE_WORDS) & (actions >= 3)) | (first & _any(answer, DAYS[0])) | (~first & last & _any(answer, DAYS[6]))


def _requirement(name, text) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(name).alias("id"), as_column(text).alias("requirement"))


def _numbered(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad((i + 1).cast("string"), 2, "0"))


def missing(terms: Column, answer: Column, context: Column) -> Column:
    """What the answer misses, in the order of the contract, as (id, requirement); empty where it passes.

    Null answers and contexts are empty texts. Sources in the context demand a citation even where the contract does not.
    """
    text = lambda terms, answer, context: _let(_found, terms=terms, text=structured(answer, terms), context=F.coalesce(context, F.lit("")))
    return _let(text, terms=terms, answer=answer, context=context)


def _found(terms: Column, text: Column, context: Column) -> Column:
    return _let(_listed, terms=terms, text=text, context=context, actions=observed_actions(text), n=F.length(text))


def _listed(terms: Column, text: Column, context: Column, actions: Column, n: Column) -> Column:
    sources, cite = F.contains(context, F.lit("[来源 ")), F.coalesce(terms["cite"], F.lit(False))
    concepts = F.transform(terms["concepts"], lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    phrases = F.transform(terms["forbidden"], lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    when = lambda condition, name, requirement: F.array(F.when(condition, _requirement(name, requirement)))
    count = lambda name, before, after: F.concat(F.lit(before), terms[name].cast("string"), F.lit(after))
    found = F.concat(
        when(n < terms["least_chars"], "length-minimum", count("least_chars", "答案不少于 ", " 字符")),
        when(n > terms["most_chars"], "length-maximum", count("most_chars", "答案不超过 ", " 字符")),
        when(cite & ~sources, "citation-evidence", "没有可满足引用契约的知识证据"),
        when(sources & ~citations_satisfied(text, context), "citation-format", "使用有效的 [来源 n] 单编号引用"),
        F.transform(F.filter(concepts, lambda x: ~covered(text, x["c"], actions)), lambda x: _requirement(_numbered("concept-", x["i"]), F.concat(F.lit("覆盖概念："), x["c"]))),
        F.transform(F.filter(phrases, lambda x: F.contains(text, x["p"])), lambda x: _requirement(_numbered("forbidden-", x["i"]), F.concat(F.lit("删除禁用短语："), x["p"]))),
        when(terms["direct"] & _any(text, FOLLOW_UPS), "no-follow-up", "直接回答，不向用户追问"),
        when((terms["actions"] > 0) & (actions < terms["actions"]), "action-items", count("actions", "至少提供 ", " 个行动项")),
        when(terms["assume"] & ~_any(text, ASSUMPTION_MARKS), "assumptions", "明确标注合理假设或信息边界"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def audited(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Per requirement id: rows that missed it before, and of those how many no longer do or still do.

    ``before`` and ``after`` are columns of :func:`missing`. A row counts once an id; rows that passed before are not looked at.
    """
    ids = lambda name: F.array_distinct(F.transform(F.col(name), lambda x: x["id"]))
    # Outer, since a plain explode filters by the size of its input first and so works the check out twice.
    each = rows.select(F.explode_outer(ids(before)).alias("id"), ids(after).alias("_left")).where("id IS NOT NULL")
    left = F.array_contains("_left", F.col("id")).cast("long")
    return each.groupBy("id").agg(F.count("*").alias("n_before"), F.sum(1 - left).alias("n_resolved"), F.sum(left).alias("n_remaining"))
