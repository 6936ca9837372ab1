"""Audit of how far the sources of a language diverge: every source against every other, and the terms that set it apart.

Terms are counted once, in the tasks that read the texts; a task passes on one row for each language and term, with its
sources' counts, so that rare terms are dropped before anything is counted by source. A language's kept terms are dealt by hash into shards and numbered there, its sources into blocks; a cell is one block's count vectors
over one shard, so that no task ever holds a whole vocabulary or all sources. The pairs are evaluated by systolic
rotation: the cells stay where they are (one partitioning, kept on the executors' disks), and in each round of a round-robin
tournament a compressed copy of every block's vectors travels to the cell of the block that it meets. A meeting is
evaluated once for both directions, since the divergence is symmetric; the shards' parts are then added up. Terms are
ranked in bounded heaps, one for each source and task, and the heaps merged.

All arithmetic is exact: probabilities are scaled integers made by long division (exact up to 9e15 counted terms a language), so
results do not depend on how the work was dealt.

Defined results: null text, language and source are ''; a source without terms takes part with the smoothed probabilities alone;
a language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; repeated
documents count again; ties go to the smaller item in UTF-8; an empty table gives no rows; other columns are not read,
so no name can clash; a very long text is read in one piece, like any other.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmill.llm.words import numbered, pieces
from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Counts that a cell may hold: sources of a block times terms of a shard.
CELL = 1 << 21
#: Counts that a task holds before it passes them on, and bytes of text that it looks at together.
HELD_ROWS, AT_ONCE = 300_000, 4_000_000

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PARTIAL = "lang string, term string, docs long, sources array<string>, counts array<bigint>"


def probability(count: np.ndarray, total: np.ndarray | int, kept: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), in steps of 1000 so that no product leaves 64 bits."""
    under = np.maximum(np.asarray(total, np.int64) + 2 * np.asarray(kept, np.int64), 1)
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, under)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, under)
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PARTIAL`` of a split; the row with the empty term says which sources occur."""
    keys = ["lang", "source", "term"]

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*keys, "n", "docs"])

    def sent(found: pa.Table) -> list[pa.RecordBatch]:
        found = found.group_by(["lang", "term"]).aggregate([("docs", "sum"), ("source", "list"), ("n", "list")])
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        found = found.rename_columns([f.split()[0] for f in PARTIAL.split(", ")])
        return found.cast(pa.schema(list(zip(found.column_names, types, strict=True)))).combine_chunks().to_batches(max_chunksize=16_384)

    held: list[pa.Table] = []
    n_held = 0
    for b in batches:
        groups = pa.table({"lang": b.column(1), "source": b.column(2), "row": np.arange(b.num_rows)})
        number = groups.group_by(["lang", "source"]).aggregate([("row", "min"), ("row", "count")])
        of_row = groups.join(number.append_column("group", pa.array(np.arange(len(number)))), ["lang", "source"]).sort_by("row")["group"].to_numpy()
        named = lambda g, term, n, docs: pa.table({"lang": number["lang"].take(pa.array(g)), "source": number["source"].take(pa.array(g)), "term": term.cast(pa.large_string()), "n": n, "docs": docs})  # noqa: E731, B023
        held.append(named(np.arange(len(number)), pa.array([""] * len(number)), np.zeros(len(number), np.int64), number["row_count"]))
        for first, texts in pieces(b.column(0), AT_ONCE):
            codes, words, starts = numbered(texts, lower=True, between=_BETWEEN)
            if not len(codes):
                continue
            doc = np.repeat(np.arange(len(texts)), np.diff(starts))
            group, width = of_row[first : first + len(texts)], len(words)
            each, times = np.unique(doc * width + codes, return_counts=True)
            keyed = group[each // width] * width + each % width
            order = np.argsort(keyed, kind="stable")
            keyed, times = keyed[order], times[order]
            edge = np.flatnonzero(np.diff(keyed, prepend=-1))
            held.append(named(keyed[edge] // width, words.take(pa.array(keyed[edge] % width)), np.add.reduceat(times, edge), np.diff(edge, append=len(keyed))))
            n_held += len(edge)
            if n_held >= HELD_ROWS:
                held = [summed(held)]
                n_held = len(held[0])
                if 2 * n_held >= HELD_ROWS:
                    yield from sent(held[0])
                    held, n_held = [], 0
    if held:
        yield from sent(summed(held))


def counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n: occurrences of each term in ``min_docs`` of its language's documents, and a row with the empty term for each source."""
    named = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    found = named.mapInArrow(_counted, PARTIAL).withColumn("_in", F.sum("docs").over(Window.partitionBy("lang", "term")))
    each = found.where((F.col("_in") >= min_docs) | (F.col("term") == "")).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    return each.groupBy("lang", F.col("x.sources").alias("source"), "term").agg(F.sum("x.counts").alias("n"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count vectors as compressed numbers and counts."""
    for b in batches:
        vectors = []
        for v in b.column("vector"):
            held = v.values
            if held is None or not len(held):
                vectors.append(b"")
                continue
            place, n = held.field("place").to_numpy(), held.field("n").to_numpy()
            order = np.argsort(place)
            vectors.append(zlib.compress(np.diff(place[order], prepend=0).astype("<i4").tobytes() + n[order].astype("<i8").tobytes(), 1))
        yield b.set_column(b.schema.get_field_index("vector"), "vector", pa.array(vectors, pa.binary()))


def _dense(cell: pa.Table) -> np.ndarray:
    """Probabilities of a cell: sources by terms."""
    width = cell["shard_terms"][0].as_py()
    n = np.zeros((len(cell), width), np.int64)
    for row, packed in zip(n, cell["vector"], strict=True):
        if packed := packed.as_py():
            raw = zlib.decompress(packed)
            some = len(raw) // 12
            row[np.cumsum(np.frombuffer(raw, "<i4", some))] = np.frombuffer(raw, "<i8", some, 4 * some)
    total, kept = (cell[c].to_numpy()[:, None] for c in ("total", "kept"))
    return probability(n, total, kept)


MET = "lang string, source string, item string, value long"


def _meeting(stays: pa.Table, comes: pa.Table) -> pa.Table:
    """Both directions of each pair of a resident and a visiting source; of a block that meets itself, of each two of its own."""
    rows: list[tuple] = []
    if len(stays) and len(comes):
        here, there = _dense(stays), _dense(comes)
        mine, yours, lang = stays["source"].to_pylist(), comes["source"].to_pylist(), stays["lang"][0].as_py()
        own = stays["block"][0].as_py() == comes["home"][0].as_py()
        for k, other in enumerate(there):
            value = divergence(here, other).sum(axis=1).tolist()
            for i, x in enumerate(value):
                if not own:
                    rows += [(lang, mine[i], yours[k], x), (lang, yours[k], mine[i], x)]
                elif mine[i] < yours[k]:
                    rows += [(lang, mine[i], yours[k], x), (lang, yours[k], mine[i], x)]
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({"lang": pa.array(cols[0], pa.string()), "source": pa.array(cols[1], pa.string()), "item": pa.array(cols[2], pa.string()), "value": pa.array(cols[3], pa.int64())})


def rotated(vectors: DataFrame, blocks: int, store: Store) -> DataFrame:
    """``MET``, in parts by shard. vectors: lang, shard, block, blocks, source, total, kept, shard_terms, vector. In round r, blocks i and j of
    a language meet where i + j = r modulo its number of blocks, so every two meet once; which of them stays alternates."""
    key = ["lang", "shard", "block"]
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = vectors.repartition(partitions, *key).persist(StorageLevel.DISK_ONLY)
    rounds = []
    try:
        for r in range(blocks):
            goes_to = F.pmod(F.lit(r) - F.col("block"), F.col("blocks")).cast("int")
            stays = ((goes_to + F.col("block")) % 2 == 0) == (goes_to < F.col("block"))
            away = vectors.where(F.lit(r) < F.col("blocks")).withColumns({"home": F.col("block"), "to": goes_to}).where((F.col("to") == F.col("block")) | stays)
            away = away.drop("block").withColumnRenamed("to", "block")
            met = resident.groupBy(*key).cogroup(away.groupBy(*key)).applyInArrow(_meeting, MET)
            rounds.append(store.put(met))
    finally:
        resident.unpersist()
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out


def _heaps(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[int, bytes]]] = {}
        for b in batches:
            n, whole, total, whole_total, kept = (b.column(c).to_numpy() for c in ("n", "whole", "total", "whole_total", "kept"))
            p, q = probability(n, total, kept), probability(whole, whole_total, kept)
            value = np.where(p > q, divergence(p, q), -1)
            groups = pa.table({"lang": b.column("lang"), "source": b.column("source"), "row": np.arange(len(n))})
            for g in groups.group_by(["lang", "source"]).aggregate([("row", "list")]).to_batches():
                for lang, source, rows in zip(g.column("lang").to_pylist(), g.column("source").to_pylist(), g.column("row_list"), strict=True):
                    rows = rows.values.to_numpy()
                    best = held.get((lang, source), [])
                    rows = rows[value[rows] >= (-best[-1][0] if len(best) == top else 0)]
                    if len(rows) > 4 * top:  # all that can still be among the first
                        rows = rows[value[rows] >= np.partition(value[rows], -top)[-top]]
                    if len(rows):
                        terms = b.column("term").take(pa.array(rows)).cast(pa.binary()).to_pylist()
                        held[lang, source] = heapq.nsmallest(top, [*best, *zip((-value[rows]).tolist(), terms, strict=True)])
        if held:
            out = [(lang, source, term.decode(), -x) for (lang, source), best in held.items() for x, term in best]
            lang, source, item, value = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    return run


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _parts(whole: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(whole / size)).cast("int")


def audited(docs: DataFrame, store: Store, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, cell: int = CELL) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank. What goes to the driver is one number, the most blocks of a language."""
    counted = store.put(counts(docs, min_docs))
    found = counted.where("term <> ''")
    kept = store.put(found.groupBy("lang", "term").agg(F.sum("n").alias("whole")))
    sources = counted.where("term = ''").groupBy("lang").agg(F.count("*").alias("sources"))
    # As many blocks as a block has sources, about; shards so small that a cell stays within its bound.
    langs = sources.join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("whole_total")), "lang", "left").na.fill(0)
    langs = langs.withColumn("blocks", F.ceil(F.sqrt("sources")).cast("int"))
    langs = store.put(langs.withColumn("shards", _parts(F.col("kept") * F.col("blocks"), F.lit(cell))).drop("sources"))
    number = Window.partitionBy("lang", "shard").orderBy("term")
    terms = kept.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    terms = store.put(terms.withColumn("place", F.row_number().over(number) - 1).select("lang", "term", "shard", "place", "whole"))
    cells = store.put(found.join(terms, ["lang", "term"]))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = store.put(counted.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0).join(langs, "lang"))

    vectors = cells.groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("place", "n")).alias("vector"))
    widths = terms.groupBy("lang", "shard").agg(F.count("*").alias("shard_terms"))
    everywhere = groups.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), "block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")})
    full = everywhere.join(vectors, ["lang", "source", "shard"], "left").join(widths, ["lang", "shard"], "left").na.fill(0, ["shard_terms"])
    full = full.select("lang", "source", "shard", "block", "blocks", "total", "kept", "shard_terms", "vector")
    packed = ", ".join(f"{f.name} {'binary' if f.name == 'vector' else f.dataType.simpleString()}" for f in full.schema)
    vectors = store.put(full.mapInArrow(_packed, packed))
    blocks = langs.agg(F.max("blocks").alias("b")).first()["b"] or 0
    if not blocks:
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    pairs = rotated(vectors, blocks, store).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    told = cells.join(groups.select("lang", "source", "total", "whole_total", "kept"), ["lang", "source"])
    apart = told.select("lang", "source", "term", "n", "whole", "total", "whole_total", "kept").mapInArrow(_heaps(top), MET)
    return _ranked(pairs, "pair").unionAll(_ranked(apart, "term").where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), Store(spark, "divergence"))


ORACLE_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT lang, source, d, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce((SELECT sum(n) FROM counted c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v)::HUGEINT AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q FROM kept k JOIN langs l USING (lang)),
apart AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM apart QUALIFY rank <= 10)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
