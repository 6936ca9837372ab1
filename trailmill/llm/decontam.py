"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed slots that keep their value beside the type (``num__12``), everything else
is lower case without marks. A document leaks an item if both hold a window of ``WIDTH`` tokens with the same
template whose slots are also consistent: equal values in the one are equal in the other, different values
different. A window that matches with other values is a re-parameterised question, and evidence only if it holds
``LITERALS`` plain words at least; one with the item's own values is a copy, whatever it is made of.

The corpus is read once against the hashes of narrow item windows: a document window of ``NARROW`` tokens at every
``STEP``-th place is enough, since any shared run of ``WIDTH = NARROW + STEP - 1`` tokens holds one. Documents that
hit are cut into tokens once, and those are compared window by window on the full template. An item of fewer than
``WIDTH`` tokens is found where it stands whole: its first tokens (``LITERALS``, or all if there are fewer) find
documents, a window of its own length decides. So no item with a token is lost, and one of a single word is found
wherever that word stands.

Defined results: null and empty texts leak nothing, and items without a token are found nowhere; repeated rows of a
document or an item, or a null id, count once per id; an item that stands several times in a document is one row; slots
with equal values are alike whatever the value; a very long text is read whole; an empty table on either side gives no
rows and ``clean`` keeps all; other columns are not read by ``leaks``, so no name can clash, and ``clean`` leaves them
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.plans.shared_store import Store, small
from trailmill.sources.tables import table

NARROW, STEP, LITERALS = 8, 6, 5
WIDTH = NARROW + STEP - 1
#: Largest side, in rows, that is broadcast; beyond it the joins are shuffled.
BROADCAST_ROWS = 200_000
UNITS = "kg|mg|lbs|lb|oz|km|cm|mm|mi|ft|ml|kwh|mph|hz|usd|eur|gbp|percent|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|meter|miles|mile|liters|liter|grams|gram|dollars|euros"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_NAME = r" (?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)"
_CAPITAL = r"^[^\p{L}\p{N}_]*\p{Lu}\p{Ll}+(?![\p{L}\p{N}_])"
_TOKEN = r"num__[0-9.,:/]+|[\p{L}\p{N}_]+"


def _let(value: Column, body) -> Column:
    """``value`` evaluated once and named inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _slotted(text: Column) -> Column:
    def numbers(named: Column) -> Column:
        units = F.regexp_replace(named, rf"\b({_NUMBER}) ?({UNITS})\b", "num__$1 unit__$2")
        return F.when(named.rlike("[0-9]"), F.regexp_replace(units, rf"\b({_NUMBER})\b", "num__$1 ")).otherwise(named)

    return _let(F.lower(F.regexp_replace(text, _NAME, " name__$1")), numbers)


def tokens(text: Column) -> Column:
    """Tokens with their slot values."""
    return F.regexp_extract_all(_slotted(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0)


def _templates(text: Column) -> Column:
    bare = lambda x: F.when(F.contains(x, F.lit("__")), F.regexp_replace(x, r"(name|num|unit)__[\p{L}\p{N}.,:/]+", "$1__")).otherwise(x)
    return F.regexp_extract_all(_let(_slotted(F.coalesce(text, F.lit(""))), bare), F.lit(r"[\p{L}\p{N}_]+"), 0)


def _hashes(toks: Column, step: int, width: int = NARROW) -> Column:
    one = lambda w: F.when(
        F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width, F.lit(step)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    ).otherwise(F.array().cast("array<bigint>"))
    return _let(toks, one)


_SLOT = "^(name|num|unit)__"


def windows(df: DataFrame, *key: str, width: int = WIDTH) -> DataFrame:
    """(*key, at, template, slots, literal, plain): every window of ``width`` of the tokens ``w``. template: hash of its typed tokens; slots: first
    place of each slot's value; literal: the values; plain: how many tokens are no slots. Types are found once per text, not per window."""

    def cut(w):
        typed = F.transform(w, lambda x: F.when(x.rlike(_SLOT), F.regexp_extract(x, _SLOT, 0)).otherwise(x))
        places = F.sequence(F.lit(0), F.size(w) - width)
        return _let(typed, lambda t: F.transform(places, lambda i: F.struct((i + 1).alias("at"), F.xxhash64(*[F.get(t, i + k) for k in range(width)]).alias("template"), held(w, i).alias("v"))))

    def held(w, i):
        return F.filter(F.slice(w, i + 1, width), lambda x: x.rlike(_SLOT))

    def bare(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct((i + 1).alias("at"), F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("template"), F.array().cast("array<string>").alias("v")))

    slots = lambda w: F.exists(w, lambda x: F.contains(x, F.lit("__")))
    every = F.when(F.size("w") >= width, F.when(slots(F.col("w")), cut(F.col("w"))).otherwise(bare(F.col("w"))))
    out = df.select(*key, F.explode(every).alias("s")).select(*key, "s.*")
    slot = F.array_join(F.transform("v", lambda y: F.array_position(F.col("v"), y)), ",").alias("slots")
    return out.select(*key, "at", "template", slot, F.array_join("v", " ").alias("literal"), (F.lit(width) - F.size("v")).alias("plain"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def leaks(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame:
    """(doc_id, item_id, n_windows, reparameterised): shared windows of the item; whether none of them has the item's own values."""
    items = benchmark.select("item_id", "text", tokens(F.col("text")).alias("w"), _templates(F.col("text")).alias("t")).withColumns({"n": F.size("w"), "inside": F.lit(False)}).where("n > 0")
    # Inside a sentence a capital makes a name, so an item of one window is also looked for with its first word as one, of its own value.
    first = lambda c, word: F.concat(F.array(word), F.slice(c, 2, WIDTH))
    named = items.where((F.col("n") <= WIDTH) & F.col("text").rlike(_CAPITAL)).withColumns({"w": first("w", F.concat(F.lit("name__"), F.get("w", F.lit(0)))), "t": first("t", F.lit("name__")), "inside": F.lit(True)})
    items = store.put(items.unionAll(named).drop("text"))
    long, short = items.where(F.col("n") >= WIDTH), items.where(F.col("n") < WIDTH)
    widths = sorted(r.n for r in short.select("n").distinct().collect())  # WIDTH - 1 values at most
    starts = sorted({min(n, LITERALS) for n in widths})
    begin = [short.where(F.least("n", F.lit(LITERALS)) == n).select(F.get(_hashes(F.col("t"), 1, n), F.lit(0)).alias("h")) for n in starts]
    wanted = long.select(F.explode(_hashes(F.col("t"), 1)).alias("h"))
    for more in begin:
        wanted = wanted.unionAll(more)
    wanted = store.put(wanted.distinct())
    seen = _let(_templates(F.col("text")), lambda t: F.concat(_hashes(t, STEP), *[_hashes(t, 1, n) for n in starts]))
    hit = docs.select("doc_id", F.explode(seen).alias("h")).join(_sized(wanted), "h", "left_semi")
    hit = store.put(hit.select(F.col("doc_id").alias("_id")).distinct())
    again = docs.select("doc_id", "text").join(_sized(hit), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = store.put(again.select("doc_id", tokens(F.col("text")).alias("w")))
    both = None
    for width in (WIDTH, *widths):
        mine = windows(again, "doc_id", width=width).drop("at")
        theirs = store.put(windows(long if width == WIDTH else short.where(F.col("n") == width), "item_id", "inside", width=width).drop("plain"))
        met = mine.join(_sized(theirs.withColumnRenamed("literal", "own")), ["template", "slots"]).where(((F.col("plain") >= LITERALS) & ~F.col("inside")) | (F.col("literal") == F.col("own")))
        met = met.select("doc_id", "item_id", "at", "literal", "own")
        both = met if both is None else both.unionByName(met)
    return both.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("n_windows"), (~F.bool_or(F.col("literal") == F.col("own"))).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame:
    """The rows of ``docs`` whose document leaks no item, with all their columns."""
    bad = store.put(leaks(docs, benchmark, store).select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(_sized(bad), docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark"), Store(spark, "decontam"))


def _oracle() -> str:
    name = r"([\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)"
    named = lambda x: rf"regexp_replace({x}, '{name}', '\1name__\2', 'g')"
    # k: the width of a window, WIDTH or the length of a short item.
    slots = lambda t: (
        f"SELECT id, inside, k, i AS at, k - len(v) AS plain, array_to_string(list_transform(x, lambda y: CASE WHEN regexp_matches(y, '^(name|num|unit)__') THEN regexp_extract(y, '^(name|num|unit)__') ELSE y END), ' ') AS template, "
        f"array_to_string(list_transform(v, lambda y: list_position(v, y)), ',') AS slots, array_to_string(v, ' ') AS literal "
        f"FROM (SELECT id, inside, k, i, x, list_filter(x, lambda y: regexp_matches(y, '^(name|num|unit)__')) AS v FROM (SELECT id, inside, k, i, w[i:i + k - 1] AS x FROM (SELECT id, inside, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM {t})))"
    )
    toks = lambda x: rf"regexp_extract_all(regexp_replace(regexp_replace(lower({named(named(x))}), '\b({_NUMBER}) ?({UNITS})\b', 'num__\1 unit__\2', 'g'), '\b({_NUMBER})\b', 'num__\1 ', 'g'), '{_TOKEN}')"
    return rf"""
WITH b0 AS (SELECT item_id AS id, {toks("coalesce(text, '')")} AS w, text FROM benchmark), 
b1 AS (SELECT id, w, false AS inside FROM b0 UNION ALL SELECT id, list_prepend('name__' || w[1], w[2:]), true FROM b0 WHERE len(w) <= {WIDTH} AND regexp_matches(text, '^[^\p{{L}}\p{{N}}_]*\p{{Lu}}\p{{Ll}}+([^\p{{L}}\p{{N}}_]|$)')),
b AS (SELECT id, w, inside, least(len(w), {WIDTH}) AS k FROM b1 WHERE len(w) >= 1),
d0 AS (SELECT doc_id AS id, {toks("coalesce(text, '')")} AS w FROM documents), d AS (SELECT id, w, false AS inside, k FROM d0 CROSS JOIN (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
dw AS ({slots("d")}), bw AS ({slots("b")})
SELECT dw.id AS doc_id, bw.id AS item_id, count(DISTINCT bw.at) AS n_windows, NOT bool_or(dw.literal = bw.literal) AS reparameterised
FROM dw JOIN bw USING (k, template, slots) WHERE (dw.plain >= {LITERALS} AND NOT bw.inside) OR dw.literal = bw.literal GROUP BY 1, 2
"""


ORACLE_SQL = _oracle()
