"""Text expressions: normal forms, n-grams, token sets, coverage, citations, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAN = r"\p{IsHan}"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


#: White space in the sense of Unicode and of ASCII's four separators. No-break blanks are stripped, but a text of them is not blank.
WHITE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NO_BREAK = r"\x85\u00a0\u2007\u202f"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends, line breaks and wide blanks among it; ``trim`` takes blanks only."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def says(text: Column) -> Column:
    """Whether a text holds anything but white space; no-break blanks are something. Null says nothing."""
    return F.coalesce(text.rlike(f"[^{WHITE}]|[{_NO_BREAK}]"), F.lit(False))


def compact(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only gram, an empty one has none."""
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets count 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(both / F.size(F.array_union(a, b)))


def retrieval_terms(text: Column) -> Column:
    """Words of two or more ASCII letters or digits, and Han bigrams (a single Han character stands alone)."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]{2,}"), 0)
    runs = F.regexp_extract_all(low, F.lit(f"{_HAN}+"), 0)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(latin, pairs))


def weighted_coverage(query_terms: Column, text: Column) -> Column:
    """Share of the query's terms in the text; one-character terms weigh a quarter."""
    weight = lambda t: F.when(F.length(t) == 1, F.lit(0.25)).otherwise(F.lit(1.0))
    total = F.aggregate(query_terms, F.lit(0.0), lambda a, t: a + weight(t))
    hit = F.aggregate(query_terms, F.lit(0.0), lambda a, t: a + F.when(F.contains(text, t), weight(t)).otherwise(0.0))
    return F.when(total > 0, hit / total).otherwise(0.0)


def answer_units(text: Column) -> Column:
    """Han characters and ASCII words, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{_HAN}|[a-z0-9]+"), 0)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over distinct tokens of the smaller count."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def length_quality(text: Column, low: Column, high: Column) -> Column:
    """1 within [low, high] code points, falling off in proportion outside."""
    n = F.length(text)
    return F.when(n == 0, 0.0).when(n < low, n / low).when(n > high, high / n).otherwise(1.0)


def repeated_line_ratio(text: Column, shortest: int = 8) -> Column:
    """Share of lines of at least ``shortest`` characters that repeat an earlier one; 0 below two such lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.length(x) >= shortest)
    return F.when(F.size(lines) < 2, 0.0).otherwise((F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines))


def token_estimate(text: Column) -> Column:
    """Han characters plus a quarter of the other visible characters, at least 1; 0 for blank texts."""
    han = F.length(F.regexp_replace(text, f"[^{_HAN}]", ""))
    other = F.length(F.regexp_replace(text, rf"[\s{_HAN}]", ""))
    return F.when(F.length(F.regexp_replace(text, r"\s", "")) == 0, 0).otherwise(F.greatest(F.lit(1), han + F.ceil(other / 4))).cast("long")


def citations(text: Column) -> Column:
    """Distinct numbers of ``[来源 n]`` marks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[来源\s*([0-9]{1,6})\]"), 1), lambda x: x.cast("int")))


def citations_valid(answer: Column, sources: Column) -> Column:
    """Every cited number is among the sources and there is one; true where there are no sources."""
    cited = citations(answer)
    return (F.size(sources) == 0) | ((F.size(cited) > 0) & (F.size(F.array_except(cited, sources)) == 0))


def concept_coverage(text: Column, concepts: Column) -> Column:
    """Share of concepts with any alternative (split at a pipe) in the text; 1 without concepts."""
    hit = F.filter(concepts, lambda c: F.exists(F.split(c, "[|]"), lambda a: F.contains(F.lower(text), F.lower(F.trim(a)))))
    return F.when(F.size(concepts) == 0, 1.0).otherwise(F.size(hit) / F.size(concepts))


def any_phrase(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(text, p))


def action_items(text: Column) -> Column:
    """The largest of three counts: numbered lines, bullet lines, day marks."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    return F.greatest(count(r"(?m)^\s*[0-9]{1,2}[.、)]\s*\S"), count(r"(?m)^\s*[-*•]\s+\S"), count(r"第[0-9一二三四五六七八九十]+天"))


def table_lines(text: Column) -> Column:
    """Lines with two or more pipes."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, "[^|]", "")) >= 2))
