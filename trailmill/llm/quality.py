"""Quality rules with thresholds that adapt to each language and source.

Counts per document come from array expressions over its words, so no document leaves its row. Every (lang, source)
group is summarised by quantile sketches (``percentile_approx``: partial sketches are merged after the map side), and
its fences, q75 + spread * (q75 - q25) and below q25 for the word length, are joined back to the documents. No fence is
held in a fixed range. Rates are smoothed by one, (n + 1) / (words + 1), so that a measure which is zero in most
documents still has a spread, and the fence of a clean group lies at a few hits in a short text. A group of fewer than
``min_group`` documents takes the fences of its language, a small language those of the whole table.

Defined results: a null text has no words and fails the base rule; null ``lang`` or ``source`` is a group of its own;
repeated rows are judged one by one and alike; a measure equal to its fence passes; a very long text is counted whole;
an empty table gives no rows; ``judged`` adds one struct column, named by the caller, and leaves all others as they
are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.plans.shared_store import Store, small
from trailmill.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Base limits and the adaptive measures: upper fences, and lower ones too where ``both`` names the measure."""

    min_words: int = 50
    max_repeat_percent: int = 50
    measures: tuple[str, ...] = ("symbol_rate", "shout_rate", "dup_line_rate", "word_length")
    both: tuple[str, ...] = ("word_length",)
    spread: float = 6.0
    min_group: int = 50
    accuracy: int = 10000
    broadcast_groups: int = 50_000


def _let(value: Column, body) -> Column:
    """``value`` evaluated once and named inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 3, few: int = 24) -> Column:
    """Words covered by a window of ``width`` words that is found twice or more, the first one included.

    Window hashes are sorted as plain longs. Most texts repeat few windows, which are then looked up directly;
    beyond ``few`` different ones, (hash, place) pairs are sorted instead, so no text costs more than n log n.
    """

    def windows(w):
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return _let(hashed, lambda h: _let(F.sort_array(h), lambda s: _let(F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)), lambda again: counted(h, again))))

    def counted(h, again):
        looked_up = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda p: p.isNotNull())
        return F.when(F.size(again) == 0, 0).when(F.size(again) <= few, _let(looked_up, covered)).otherwise(paired(h))

    def paired(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: _let(F.sort_array(F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull())), covered))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) > width, windows(words)).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts and rates of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def counts(w):
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(w).alias("n_repeat_words"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        )

    def rates(m):
        return F.struct(
            *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols")],
            m["lines"]["dup"].alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"),
            ((m["n_symbols"] + 1) / (m["n_words"] + 1)).alias("symbol_rate"),
            ((m["n_shouts"] + 1) / (m["n_words"] + 1)).alias("shout_rate"),
            ((m["lines"]["dup"] + 1) / (m["lines"]["n"] + 1)).alias("dup_line_rate"),
            (m["word_chars"] / F.greatest(m["n_words"], F.lit(1))).alias("word_length"),
        )

    return _let(_let(words, counts), rates)


def _base_failed(rules: Rules, m: Column) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def fences(m: DataFrame, rules: Rules) -> DataFrame:
    """One row per (lang, source) with documents that pass the base rule: (lang, source, low, high), structs by measure.

    m: lang, source, m. The sketches of groups, languages and the table come from one aggregate over grouping sets.
    """
    fine = m.where(~_base_failed(rules, F.col("m"))).select("lang", "source", *[F.col("m")[n].alias(n) for n in rules.measures])
    sketches = [F.percentile_approx(n, [0.25, 0.75], rules.accuracy).alias(n) for n in rules.measures]
    every = fine.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("k"), F.struct(*sketches).alias("q"))
    group = every.where("level = 0").select("lang", "source", F.col("k").alias("k0"), F.col("q").alias("q0"))
    language = every.where("level = 1").select(F.col("lang").alias("of"), F.col("k").alias("k1"), F.col("q").alias("q1"))
    table_ = every.where("level = 3").select(F.col("q").alias("q3"))
    chosen = group.join(language, F.col("lang").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(table_))  # the last is one row
    q = F.when(F.col("k0") >= rules.min_group, F.col("q0")).when(F.col("k1") >= rules.min_group, F.col("q1")).otherwise(F.col("q3"))
    chosen = chosen.select("lang", "source", q.alias("q"))
    at = lambda n, k, sign: (F.col("q")[n][k] + sign * rules.spread * (F.col("q")[n][1] - F.col("q")[n][0])).alias(n)
    return chosen.select("lang", "source", F.struct(*[at(n, 0, -1) for n in rules.both]).alias("low"), F.struct(*[at(n, 1, 1) for n in rules.measures]).alias("high"))


def verdicts(m: DataFrame, rules: Rules, store: Store) -> DataFrame:
    """``m`` (lang, source, m and others, written before) with ``base_failed`` and ``kept``."""
    limits = store.put(fences(m, rules).withColumnsRenamed({"lang": "_of", "source": "_from"}))
    if small(limits, rules.broadcast_groups):
        limits = F.broadcast(limits)
    joined = m.join(limits, m["lang"].eqNullSafe(limits["_of"]) & m["source"].eqNullSafe(limits["_from"]), "left")
    over = F.lit(False)
    for n in rules.measures:
        over = over | F.coalesce(F.col("m")[n] > F.col("high")[n], F.lit(False))
    for n in rules.both:
        over = over | F.coalesce(F.col("m")[n] < F.col("low")[n], F.lit(False))
    failed = _base_failed(rules, F.col("m"))
    return joined.select(*m.columns, failed.alias("base_failed"), (~failed & ~over).alias("kept"))


def judged(df: DataFrame, name: str = "quality", rules: Rules | None = None, store: Store | None = None) -> DataFrame:
    """All rows and columns of ``df`` (text, lang, source) and a struct ``name``: the measures, ``base_failed`` and ``kept``."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    rules, store = rules or Rules(), store or Store(df.sparkSession, "quality")
    # Everything but the texts goes into one struct, so that no name can clash.
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"])
    rows = df.select(rest.alias("_doc"), "text", F.col("lang"), F.col("source"), measures(F.col("text")).alias("m"))
    out = verdicts(store.put(rows), rules, store)
    own = F.struct(*[F.col("m")[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *rules.measures)], "base_failed", "kept")
    return out.select(*[F.col("text") if c == "text" else F.col("_doc")[c].alias(c) for c in df.columns], own.alias(name))


def judged_counts(docs: DataFrame, rules: Rules, store: Store) -> DataFrame:
    """The digest of the query: the same judgement over a table of counts alone, without texts."""
    counts = docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m"))
    out = verdicts(store.put(counts), rules, store)
    m = F.col("m")
    return out.select("doc_id", *[m[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judged_counts(docs, Rules(), Store(spark, "quality"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i:i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
cover AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS n FROM again) GROUP BY rid),
m AS (
  SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) - length(translate(t, '!', '')) AS n_shouts, len(ls) AS n_lines
  FROM w LEFT JOIN cover USING (rid)),
r AS (
  SELECT *, CAST(n_symbols + 1 AS DOUBLE) / (n_words + 1) AS a, CAST(n_shouts + 1 AS DOUBLE) / (n_words + 1) AS b, CAST(n_dup_lines + 1 AS DOUBLE) / (n_lines + 1) AS c, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS e,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
q AS (
  SELECT lang, source, grouping(lang, source) AS level, count(*) AS k, quantile_disc(a, [0.25, 0.75]) AS a, quantile_disc(b, [0.25, 0.75]) AS b, quantile_disc(c, [0.25, 0.75]) AS c, quantile_disc(e, [0.25, 0.75]) AS e
  FROM r WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
f AS (
  SELECT g.lang, g.source, CASE WHEN g.k >= 50 THEN g.a WHEN l.k >= 50 THEN l.a ELSE t.a END AS fa, CASE WHEN g.k >= 50 THEN g.b WHEN l.k >= 50 THEN l.b ELSE t.b END AS fb,
    CASE WHEN g.k >= 50 THEN g.c WHEN l.k >= 50 THEN l.c ELSE t.c END AS fc, CASE WHEN g.k >= 50 THEN g.e WHEN l.k >= 50 THEN l.e ELSE t.e END AS fe
  FROM q g JOIN q l ON g.lang IS NOT DISTINCT FROM l.lang JOIN q t ON true WHERE g.level = 0 AND l.level = 1 AND t.level = 3)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(a > fa[2] + 6 * (fa[2] - fa[1]) OR b > fb[2] + 6 * (fb[2] - fb[1]) OR c > fc[2] + 6 * (fc[2] - fc[1]) OR e > fe[2] + 6 * (fe[2] - fe[1]) OR e < fe[1] - 6 * (fe[2] - fe[1]), false) AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
