"""Secret scans with multipart credential linking.

Base kinds are reported as they stand. Weak parts (account names, loosely named keys, bare high-entropy tokens,
endpoints) are reported only if a complementary part lies within ``scope`` code points of them: a secret for a
name or an endpoint, a name or an endpoint for a weak secret. That is an interval join by nearest neighbour: the
parts of a document are ordered once in each direction and carry the nearest complementary end so far, so no
pairs are formed however many parts a document has.

Positions are code points: the texts between matches (``split``) and the matches themselves alternate, and places are
running sums, taken in blocks so that the work grows in proportion to the matches of a text.

Defined results: a null text has no spans; repeated rows are scanned one by one; spans that begin alike are listed by
kind, then end; a part that has complements on both sides is reported once; very long texts are scanned whole;
``scanned`` adds one struct column, named by the caller, and leaves all others as they are, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table

SCOPE = 200
MARK = "[SECRET]"
#: kind: (class, pattern, group to test, least length of that group, patterns that the match must hold). In the order in which ties are listed.
KINDS = {
    "assign": ("secret", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ()),
    "access": ("name", r"AKIA[A-Z0-9]+", 0, 20, ()),
    "hex": ("secret", r"[0-9a-f]+", 0, 24, ()),
    "account": ("name", r"""(?i:username|user|login|account|client_?id|access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 1, 3, ()),
    "key": ("secret", r"""(?i:pwd|passphrase|credential|auth|private_?key|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 4, ()),
    "opaque": ("secret", r"[A-Za-z0-9+/_=-]+", 0, 32, ("[0-9]", "[a-z]", "[A-Z]")),
    "endpoint": ("place", r"""(?i:https?|ftp|ssh|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@%&=+-]+|(?i:hostname|host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+""", 0, 5, ()),
}
BASE = ("assign", "access", "hex")
WEAK = tuple(k for k in KINDS if k not in BASE)
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _cheap(kind: str) -> str:
    """A pattern that every passing match holds, to leave clean texts early."""
    _, pattern, group, least, _ = KINDS[kind]
    return f"{pattern[:-1]}{{{least},}}" if not group and pattern.endswith("]+") and "|" not in pattern and kind != "access" else pattern


def _let(value: Column, body) -> Column:
    """``value`` evaluated once and named inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op, block: int = 128) -> Column:
    """For each value (longs of zero and more) ``op`` over all values before it, 0 for the first: in blocks, then over the blocks."""
    zero = F.lit(0).cast("long")
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    scan = lambda v, first: F.aggregate(v, F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda a: a["out"])

    def blocked(v):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, block))
        return _let(cut, lambda c: _let(scan(F.transform(c, lambda x: F.aggregate(x, zero, op)), zero), lambda firsts: F.flatten(F.transform(c, lambda x, k: scan(x, F.get(firsts, k))))))

    return _let(values, lambda v: F.when(F.size(v) <= block, scan(v, zero)).otherwise(blocked(v)))


def spans(text: Column, kind: str) -> Column:
    """Passing matches of one kind: array of (start, rank, end)."""
    _, pattern, group, least, holds = KINDS[kind]
    rank = list(KINDS).index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    tested = F.regexp_extract_all(text, F.lit(pattern), group) if group else matches
    length = lambda x: F.length(x).cast("long")
    rows = F.arrays_zip(F.transform(F.split(text, pattern, -1), length).alias("gap"), F.transform(matches, length).alias("size"), F.transform(tested, F.length).alias("least"), matches.alias("m"))

    def found(r):
        def one(before):
            def span(x, i):
                ok = x["least"] >= least
                for h in holds:
                    ok = ok & x["m"].rlike(h)
                start = F.get(before, i) + x["gap"]
                return F.when(ok, F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).cast("int").alias("end")))

            return F.filter(F.transform(r, span), lambda x: x.isNotNull())

        return _let(running(F.transform(r, lambda x: x["gap"] + x["size"]), lambda a, x: a + x), one)

    real = F.filter(rows, lambda x: x["m"].isNotNull())
    return F.when(text.rlike(_cheap(kind)), _let(real, found).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _linkable(spans_: Column) -> Column:
    ranks = lambda *classes: [i for i, k in enumerate(KINDS) if KINDS[k][0] in classes]
    return F.exists(spans_, lambda s: s["rank"].isin(ranks("secret"))) & F.exists(spans_, lambda s: s["rank"].isin(ranks("name", "place")))


def scanned(df: DataFrame, store: Store, name: str = "secrets", text: str = "text", scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """The columns of ``df`` (without the text if not ``keep_text``) and a struct ``name``: base and spans, arrays of (start, rank, end), sorted."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [c for c in df.columns if c != text]
    # All other columns go into one struct, so that no name can clash.
    own = [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("_doc"), *([F.col(f"`{text}`").alias("_text")] if keep_text else [])]
    kept = ["_doc", "_text"][: len(own)]
    found = df.select(*own, F.sort_array(F.concat(*[spans(t, k) for k in BASE])).alias("_base"), F.concat(*[spans(t, k) for k in WEAK]).alias("_weak"))
    found = found.withColumn("_all", F.concat("_base", "_weak")).withColumn("_link", (F.size("_weak") > 0) & _linkable(F.col("_all")))
    found = store.put(found.withColumn("_row", F.monotonically_increasing_id()))
    alone = found.where(~F.col("_link")).select(*kept, "_base", F.col("_base").alias("_spans"))
    both = found.where("_link")

    parts = both.select("_row", F.explode("_all").alias("s")).select("_row", "s.*").distinct()
    secret = F.col("rank").isin([i for i, k in enumerate(KINDS) if KINDS[k][0] == "secret"])
    weak = F.col("rank") >= len(BASE)
    after = Window.partitionBy("_row").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("end"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda other: F.coalesce(F.col("start") - F.max(F.when(other, F.col("end"))).over(after) <= scope, F.lit(False)) | F.coalesce(F.min(F.when(other, F.col("start"))).over(before) - F.col("end") <= scope, F.lit(False))
    linked = parts.withColumn("_s", near(secret)).withColumn("_n", near(~secret)).where(weak & F.when(secret, F.col("_n")).otherwise(F.col("_s")))
    linked = linked.groupBy("_row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("_more"))
    joined = both.join(linked, "_row", "left").select(*kept, "_base", F.sort_array(F.concat("_base", F.coalesce("_more", F.array().cast(_SPAN)))).alias("_spans"))
    out = alone.unionByName(joined)
    columns = [F.col("_text").alias(c) if c == text else F.col("_doc")[c].alias(c) for c in df.columns if keep_text or c != text]
    return out.select(*columns, F.struct(F.col("_base").alias("base"), F.col("_spans").alias("spans")).alias(name))


def written(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans_: Column, block: int = 1024) -> Column:
    """``text`` with every stretch that spans cover replaced by one mark. The text is cut into blocks once, so that no cut counts characters from its start."""

    def cut(b, start, end):
        i, j = F.floor(start / block).cast("int"), F.floor(end / block).cast("int")
        rest = lambda x: F.pmod(x, F.lit(block)).cast("int")
        within = F.substring(F.get(b, i), rest(start) + 1, (end - start).cast("int"))
        across = F.concat(F.substring(F.get(b, i), rest(start) + 1, F.lit(block)), F.array_join(F.slice(b, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(b, j), F.lit(1), rest(end)), F.lit("")))
        return F.when(start >= end, "").when(i == j, within).otherwise(across)

    def whole(b):
        ends = F.transform(spans_, lambda s: s["end"].cast("long"))

        def joined(reach):
            piece = lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(cut(b, F.get(reach, i), s["start"].cast("long")), F.lit(MARK))).otherwise("")
            return F.concat(F.array_join(F.transform(spans_, piece), ""), cut(b, F.array_max(ends), F.length(text).cast("long")))

        return _let(running(ends, lambda a, x: F.greatest(a, x)), joined)

    return F.when(F.size(spans_) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), 0), whole)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scanned(docs, Store(spark, "secrets"), keep_text=False)
    base, every = F.col("secrets.base"), F.col("secrets.spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["rank"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(every).alias("spans"))


def _oracle() -> str:
    quoted = {k: v[1].replace("'", "''") for k, v in KINDS.items()}
    found = []
    for i, (k, (_, _, group, least, holds)) in enumerate(KINDS.items()):
        p = quoted[k]
        tests = "".join(f" AND regexp_matches(m, '{h}')" for h in holds)
        found.append(
            f"SELECT rid, {i} AS rank, '{k}' AS kind, s AS start, s + len(m) AS fin FROM (SELECT rid, m, v, sum(len(gap)) OVER (PARTITION BY rid ORDER BY i) + coalesce(sum(len(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s "
            f"FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS gaps FROM d))) WHERE len(v) >= {least}{tests}"
        )
    secret = ", ".join(str(i) for i, k in enumerate(KINDS) if KINDS[k][0] == "secret")
    union = "\nUNION ALL\n".join(found)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
n AS (SELECT *, rank IN ({secret}) AS secret FROM f),
near AS (
  SELECT *, coalesce(start - max(CASE WHEN secret THEN fin END) OVER a <= {SCOPE}, false) OR coalesce(min(CASE WHEN secret THEN start END) OVER b - fin <= {SCOPE}, false) AS by_secret,
    coalesce(start - max(CASE WHEN NOT secret THEN fin END) OVER a <= {SCOPE}, false) OR coalesce(min(CASE WHEN NOT secret THEN start END) OVER b - fin <= {SCOPE}, false) AS by_other
  FROM n WINDOW a AS (PARTITION BY rid ORDER BY start, fin, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY rid ORDER BY start DESC, fin DESC, rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(fin AS BIGINT) AS VARCHAR) AS w FROM near WHERE rank < {len(BASE)} OR CASE WHEN secret THEN by_other ELSE by_secret END),
g AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(w, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(w, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


ORACLE_SQL = _oracle()
