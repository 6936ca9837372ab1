"""Removal of passages that recur: windows of ``WINDOW`` words whose word sequence starts anywhere else.

1. Every window is tied to one phrase inside it, the ``GRAM``-word phrase with the least hash (the leftmost of
   equals). Equal windows choose the same phrase at the same place, so a window can recur only if its phrase does.
   Runs of windows with one phrase form a fragment; per document only about one phrase in fourteen words is kept.
2. Phrases are counted over all documents (partial counts first). A document without a recurring phrase cannot hold a
   recurring window; all others go on.
3. Their fragments meet by phrase, each different content once with its count, so that copies cost no more than one. A
   shard confirms the windows that recur among its phrases, compiles them to Aho-Corasick automata (a word is one
   character, at most ``WINDOWS_AT_ONCE`` windows an automaton) and streams all fragments of these phrases through them:
   every occurrence is located by an automaton.
   Phrases with more different contents than ``shard_rows`` do not fit a task; their windows are counted one by one in
   the cluster, which is exact too.
4. The located windows return to their documents, which drop the covered words.

Windows are judged on the input. Defined results: null and empty texts have no words; a document shorter than a
window keeps all of its words; repeated rows are different places, so each loses what the other holds; of equal phrase
hashes the leftmost counts; a very long text is cut into fragments like any other; an empty table gives no rows; columns
other than key and text are not read, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.words import numbered, pieces
from trailmill.plans.shared_store import Store, small
from trailmill.sources.tables import table

ORACLE_SQL = None
WINDOW, GRAM = 35, 8
_SPAN = WINDOW - GRAM + 1
WINDOWS_AT_ONCE = 8000


def fragments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, phrase hash) of the runs of windows that share a phrase."""
    number, words, begin = numbered(texts)
    n, grams = len(number) - WINDOW + 1, len(number) - GRAM + 1
    if n < 1:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x) for x in words.to_pylist()), np.uint64, len(words))[number]
    h = np.zeros(grams, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + grams]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # The leftmost least hash of every _SPAN neighbours, by doubling.
    least, at, reach = h, np.arange(grams), 1
    while reach < _SPAN:
        step = min(reach, _SPAN - reach)
        other = least[step:] < least[: len(least) - step]
        at = np.where(other, at[step:], at[: len(at) - step])
        least = np.where(other, least[step:], least[: len(least) - step])
        reach += step
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))[:n]
    place = np.flatnonzero(np.arange(n) + WINDOW <= begin[owner + 1])  # windows that end in their text
    phrase = at[place]
    edge = np.flatnonzero(np.append(True, phrase[1:] != phrase[:-1])) if len(place) else np.empty(0, np.int64)
    owner = owner[place[edge]]
    return owner, place[edge] - begin[owner], np.diff(np.append(edge, len(place))), h[phrase[edge]].view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.column(0).to_numpy()
        for k, texts in pieces(b.column(1)):
            owner, first, size, h = fragments(texts)
            yield pa.RecordBatch.from_arrays([pa.array(rows[k + owner]), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h)], names=["row", "first", "n", "phrase"])


def _cut(batches: Iterator[pa.RecordBatch], remembered: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(row, first, n, phrase, content, words): the words only where this task has not sent them lately."""
    sent: set[bytes] = set()
    for b in batches:
        rows, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())
        out: list[tuple] = []
        for k, found in enumerate(b.column(2).to_pylist()):
            words = (texts[k].as_py() or b"").split()
            for x in found:
                frag = b" ".join(words[x["first"] : x["first"] + x["n"] + WINDOW - 1])
                content = xxhash.xxh3_128_digest(frag)
                new = content not in sent
                if new:
                    if len(sent) >= remembered:
                        sent.clear()
                    sent.add(content)
                out.append((rows[k], x["first"], x["n"], x["phrase"], content, frag if new else None))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


_CUT = "row long, first int, n int, phrase long, content binary, words binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "first", "n", "phrase", "content", "words"])


def _windows(frag: bytes) -> list[bytes]:
    ends = np.cumsum([len(w) + 1 for w in frag.split(b" ")])
    starts = np.concatenate(([0], ends[:-WINDOW]))
    return [frag[a:b] for a, b in zip(starts.tolist(), (ends[WINDOW - 1 :] - 1).tolist(), strict=True)]


def located(group: list[tuple[int, bytes, int, bytes]]) -> Iterator[tuple[int, bytes, int]]:
    """Of (phrase, content, count, words): which windows of each fragment recur, as a bit mask, where any does.

    All fragments of a phrase must be in ``group``; several phrases may be.
    """
    import ahocorasick

    split = [frag.split(b" ") for *_, frag in group]
    letter = {w: chr(k + 1 if k < 0xD7FF else k + 0x801) for k, w in enumerate(set().union(*split))}  # no surrogates
    fragments_ = ["".join(map(letter.__getitem__, words)) for words in split]
    del split
    count: Counter[str] = Counter()
    for (_, _, n, _), x in zip(group, fragments_, strict=True):
        windows = [x[k : k + WINDOW] for k in range(len(x) - WINDOW + 1)]
        count.update(windows)
        if n > 1:
            count.update(windows)
    confirmed = [w for w, n in count.items() if n > 1]
    del count
    masks = [0] * len(group)
    for k in range(0, len(confirmed), WINDOWS_AT_ONCE):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in confirmed[k : k + WINDOWS_AT_ONCE]:
            automaton.add_word(w)
        automaton.make_automaton()
        for j, x in enumerate(fragments_):
            for end, _ in automaton.iter(x):
                masks[j] |= 1 << end - (WINDOW - 1)
    for (p, c, _, _), mask in zip(group, masks, strict=True):
        if mask:
            yield p, c, mask


def _shard(batches: Iterator[pa.RecordBatch], rows_at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    """Input sorted by phrase; a group of rows is closed only where the phrase changes."""
    held: list[tuple] = []

    def out(rows):
        found = list(located(rows))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int32())], names=["phrase", "content", "mask"])

    for b in batches:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= rows_at_once and x[0] != held[-1][0]:
                yield out(held)
                held = []
            held.append(x)
    if held:
        yield out(held)


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        phrase, content, n, words = (c.to_pylist() for c in b.columns)
        rows = [(p, c, k, x, o, xxhash.xxh3_128_digest(w)) for p, c, k, x in zip(phrase, content, n, words, strict=True) for o, w in enumerate(_windows(x))]
        for k in range(0, len(rows), 20_000):
            cols = list(zip(*rows[k : k + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], names=["phrase", "content", "n", "at", "window"])


def _rest(has_found: bool, with_text: bool):
    """(key, n_words, n_removed, kept_sha256, kept) of documents, with the recurring windows as third column or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            found = b.column(2).to_pylist() if has_found else [None] * b.num_rows
            for text, xs in zip(_texts(b.column(1)), found, strict=True):
                words = text.split()
                kept = words
                if xs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for x in xs:
                        mask = x["mask"]
                        while mask:
                            o = (mask & -mask).bit_length() - 1
                            cover[x["first"] + o] += 1
                            cover[x["first"] + o + WINDOW] -= 1
                            mask &= mask - 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3] if with_text else [None] * b.num_rows, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, store: Store, key: str = "doc_id", shard_rows: int = 20_000, broadcast_rows: int = 500_000, with_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept) of every row of ``docs``; kept is null if not ``with_text``."""
    kind = docs.schema[key].dataType.simpleString()
    d = store.put(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col("text")))
    phrases = store.put(d.select("row", "text").mapInArrow(_phrases, "row long, first int, n int, phrase long"))
    again = store.put(phrases.groupBy("phrase").agg(F.count("*").alias("c")).where("c > 1").select("phrase"))
    again = F.broadcast(again) if small(again, broadcast_rows) else again
    live = store.put(phrases.join(again, "phrase", "left_semi").groupBy("row").agg(F.collect_list(F.struct("first", "n", "phrase")).alias("found")))
    rows = live.select("row")
    rows = F.broadcast(rows) if small(rows, broadcast_rows) else rows

    mine = d.join(rows, "row", "left_semi").select("row", "text")
    cut = store.put(mine.join(live, "row").select("row", "text", "found").mapInArrow(_cut, _CUT))
    contents = store.put(cut.groupBy("phrase", "content").agg(F.count("*").alias("c"), F.max("words").alias("words")))
    large = store.put(contents.groupBy("phrase").agg(F.count("*").alias("kinds")).where(F.col("kinds") > shard_rows).select("phrase"))
    hot = F.broadcast(large) if small(large, broadcast_rows) else large
    near = contents.join(hot, "phrase", "left_anti").select("phrase", "content", "c", "words").repartition("phrase").sortWithinPartitions("phrase")
    masks = near.mapInArrow(_shard, "phrase long, content binary, mask int")
    if large.limit(1).count():
        single = store.put(contents.join(hot, "phrase", "left_semi").select("phrase", "content", "c", "words").mapInArrow(_single_windows, "phrase long, content binary, n long, at int, window binary"))
        twice = single.groupBy("window").agg(F.sum("n").alias("c")).where("c > 1").select("window")
        masks = masks.unionByName(single.join(twice, "window").groupBy("phrase", "content").agg(F.sum(F.expr("shiftleft(1, at)")).cast("int").alias("mask")))
    places = cut.select("row", "first", "phrase", "content").join(masks, ["phrase", "content"]).select("row", "first", "mask")
    gone = places.groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("gone"))

    shape = f"key {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
    untouched = d.join(rows, "row", "left_anti").select("key", "text").mapInArrow(_rest(False, with_text), shape)
    touched = d.join(rows, "row", "left_semi").join(gone, "row", "left").select("key", "text", "gone").mapInArrow(_rest(True, with_text), shape)
    return untouched.unionByName(touched).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, Store(spark, "substrings"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
