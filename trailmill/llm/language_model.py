"""Document scores of a gated recurrent language model with class-factored output.

log10 P(text) = sum over tokens of log10 P(class | tokens before) + log10 P(word | class). A GRU in numpy predicts the
class; frequent words are classes of their own, other words fall to classes by their ending, and within a class a
word has its add-one share of the corpus counts, unseen words included. The state is carried from window to window,
so a document's score covers all of it from an empty state at its start.

1. Word counts over all training documents: counted in tasks, summed in one shuffle.
2. A start is fitted on the driver on a sample bounded by ``WARM_TOKENS``; then every task trains on all training
   documents of its partition by truncated backpropagation, and the weights are averaged by tokens seen.
3. Scoring streams all documents in lanes. The ``TOP_WORDS`` most frequent words (a fixed bound) are broadcast; the
   other words of a document go through a join with the full counts, so nothing is cut off.

Defined results: null and empty texts are one end token; a null id counts as training; repeated rows are scored one
by one; of words with equal counts the lesser one comes first among the frequent; very long texts are read whole; with
no training documents N and V are zero and classes are equally likely; an empty table gives no rows; columns other than
key and text are not read, so no name can clash.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.words import numbered, pieces
from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table

ORACLE_SQL = None
HIDDEN, OWN_CLASS, ENDINGS = 16, 40, 24
CLASSES = OWN_CLASS + ENDINGS
TOP_WORDS, WARM_TOKENS = 200_000, 400_000
#: Bounds of the sample that the first weights are fitted on; all training documents follow.
WARM_ROWS, WARM_CHARS = 2000, 10_000
STEPS, LANES = 16, 512
#: Documents up to these lengths share lanes, so that a long one does not leave the lanes of short ones idle.
LENGTHS, BUFFER = (512, 4096), 1_200_000
END = b""  # no word is empty


def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


class Gru:
    """Class model: p[t] = softmax(h[t] Wo + bo), h[t + 1] = GRU(h[t], class t). float32 weights in one vector."""

    shapes = {"wx": (CLASSES, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wo": (HIDDEN, CLASSES), "bo": (CLASSES,)}

    def __init__(self, weights: np.ndarray | None = None, seed: int = 7):
        size = sum(math.prod(s) for s in self.shapes.values())
        if weights is None:
            weights = np.random.default_rng(seed).normal(0, 0.2, size)
            weights[-CLASSES:] = 0
        self.weights = np.array(weights, np.float32)
        self.m, self.v, self.n = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def parts(self, of: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = math.prod(shape)
            out[name] = of[at : at + n].reshape(shape)
            at += n
        return out

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """x: (steps, lanes) classes, -1 for none. fresh: whether a document starts there. Returns states before each step, the last state, and what backward needs."""
        w = self.parts(self.weights)
        wx, u, k = w["wx"], w["u"], HIDDEN
        states, held = np.empty((*x.shape, k), np.float32), []
        for t in range(len(x)):
            if fresh[t].any():
                h = h * (~fresh[t])[:, None]
            states[t] = h
            a, b = wx[x[t]], h @ u
            gate = np.tanh((a[:, : 2 * k] + b[:, : 2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = gate[:, :k], gate[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            if keep:
                held.append((z, r, c, b[:, 2 * k :]))
            h = h + z * (c - h)
        return states, h, held

    def log_probs(self, states: np.ndarray, x: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class in x."""
        w = self.parts(self.weights)
        logits = states.reshape(-1, HIDDEN) @ w["wo"]
        logits += w["bo"]
        top = logits.max(1)
        logits -= top[:, None]
        own = logits[np.arange(len(logits)), x.ravel()]
        return ((own - np.log(np.exp(logits, out=logits).sum(1))) / np.float32(math.log(10))).reshape(x.shape)

    def learn(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step of Adam over one window; returns the state after it, through which no gradient flows."""
        states, after, held = self.forward(x, fresh, h, True)
        w, k = self.parts(self.weights), HIDDEN
        grad = np.zeros_like(self.weights)
        g = self.parts(grad)
        seen = (x.ravel() >= 0).astype(np.float32)
        if not seen.any():
            return after
        flat = states.reshape(-1, k)
        # In place: such a matrix is larger than a core's cache.
        p = flat @ w["wo"]
        p += w["bo"]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        share = seen / np.float32(seen.sum())
        p *= (share / p.sum(1))[:, None]
        at = (np.arange(len(p)), x.ravel())
        p[at] -= share
        hot = np.zeros_like(p)
        hot[at] = seen
        g["wo"][:], g["bo"][:] = flat.T @ p, p.sum(0)
        d_states = (p @ w["wo"].T).reshape(states.shape)
        d, gates = np.zeros_like(after), np.empty((*x.shape, 3 * k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            z, r, c, b = held[t]
            h0 = states[t]
            da = gates[t]
            da[:, 2 * k :] = d * z * (1 - c * c)
            da[:, :k] = d * (c - h0) * z * (1 - z)
            da[:, k : 2 * k] = da[:, 2 * k :] * b * r * (1 - r)
            du = da.copy()
            du[:, 2 * k :] *= r
            g["u"][:] += h0.T @ du
            d = d * (1 - z) + du @ w["u"].T + d_states[t]
            if fresh[t].any():
                d *= (~fresh[t])[:, None]
        g["wx"][:] = hot.T @ gates.reshape(-1, 3 * k)
        size = float(np.sqrt((grad * grad).sum()))
        if size > 1:
            grad /= size
        self.n += 1
        self.m += np.float32(0.1) * (grad - self.m)
        self.v += np.float32(0.01) * (grad * grad - self.v)
        self.weights -= np.float32(rate) * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.99**self.n)) + np.float32(1e-6))
        return after


def lanes(lengths: list[int], most: int = LANES) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest first; about as many lanes as the longest one allows."""
    n = max(1, min(most, len(lengths), sum(lengths) // max(1, max(lengths, default=1)) + 1))
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        size, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (size + lengths[d], k))
    return sorted(out, key=lambda ds: -sum(lengths[d] for d in ds))


def windows(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(classes, starts, document) of (steps, lanes), -1 where a lane has ended. Lanes that have ended are left out."""
    dealt = lanes([len(d) for d in docs])
    size = [sum(len(docs[d]) for d in ds) for ds in dealt]
    total = max(size, default=0)
    x, owner = np.full((total, len(dealt)), -1, np.int32), np.full((total, len(dealt)), -1, np.int32)
    fresh = np.zeros((total, len(dealt)), bool)
    for k, ds in enumerate(dealt):
        at = 0
        for d in ds:
            n = len(docs[d])
            x[at : at + n, k], owner[at : at + n, k] = docs[d], d
            fresh[at, k] = True
            at += n
    for t in range(0, total, STEPS):
        live = sum(s > t for s in size)
        yield x[t : t + STEPS, :live], fresh[t : t + STEPS, :live], owner[t : t + STEPS, :live]


def train(model: Gru, docs: list[np.ndarray], rate: float) -> int:
    h, n = None, 0
    for x, fresh, _ in windows(docs):
        h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
        h = model.learn(x, fresh, h, rate)
        n += int((x >= 0).sum())
    return n


def class_scores(model: Gru, docs: list[np.ndarray]) -> np.ndarray:
    """Sum of log10 class probabilities of each document."""
    out, h = np.zeros(len(docs)), None
    for x, fresh, owner in windows(docs):
        h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
        states, h, _ = model.forward(x, fresh, h, False)
        ok = x >= 0
        out += np.bincount(owner[ok], model.log_probs(states, x)[ok], len(docs))
    return out


def _texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch], distinct: int = 300_000) -> Iterator[pa.RecordBatch]:
    count: Counter[bytes] = Counter()

    def out():
        words = list(count)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([count[w] for w in words], pa.int64()), pa.array([ending(w) for w in words], pa.int32())], names=["word", "c", "ending"])

    for b in batches:
        keys = b.column(0).to_pylist()
        for first, texts in pieces(b.column(1)):
            mine = [t for key, t in zip(keys[first : first + len(texts)], texts, strict=True) if not held_out(key)]
            if not mine:
                continue
            number, words, _ = numbered(mine, lower=True)
            count.update(dict(zip(words.to_pylist(), np.bincount(number, minlength=len(words)).tolist(), strict=True)))
            count[END] += len(mine)
            if len(count) > distinct:
                yield out()
                count.clear()
    if count:
        yield out()


class Words:
    """The frequent words: class, log10(count + 1), and whether the word is a class of its own. Other words by their ending."""

    def __init__(self, top: list[tuple[bytes, int]], totals: np.ndarray):
        self.number = {w: k for k, (w, _) in enumerate(top)}
        self.log_count = np.log10(np.array([c for _, c in top] or [0]) + 1.0)
        own = np.arange(len(top)) < OWN_CLASS
        self.own = np.append(own, False)
        self.classes = np.array([k if k < OWN_CLASS else OWN_CLASS + ending(w) for k, (w, _) in enumerate(top)], np.int32)
        self.log_total = totals  # of each ending class

    def classed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, classes) of words; number -1 for words that are not frequent."""
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = self.classes[ids] if len(self.classes) else np.zeros(len(ids), np.int32)
        for k in np.flatnonzero(ids < 0).tolist():
            out[k] = OWN_CLASS + ending(words[k])
        return ids, out

    def _placed(self, texts: list[bytes]):
        """(places of the tokens among the words, where texts begin, words with the end, their numbers, their classes)"""
        number, words, begin = numbered(texts, lower=True)
        words = [*words.to_pylist(), END]
        return number, begin, words, *self.classed(words)

    def class_lists(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The classes of the tokens of each text: all that training needs."""
        number, begin, _, _, classes = self._placed(texts)
        known, last = classes[number], classes[-1]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield np.append(known[a:b], last)

    def texts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[bytes, int]]]:
        """(numbers, classes, words without a number) of the tokens of each text; each different word is looked up once, and words
        without a number are counted for all texts at once."""
        number, begin, words, ids, classes = self._placed(texts)
        own, known = ids[number], classes[number]
        rest = np.flatnonzero(own < 0)
        owner = np.repeat(np.arange(len(texts)), np.diff(begin))[rest]
        pairs, n = np.unique(owner * len(words) + number[rest], return_counts=True)
        edges = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(words)).tolist()
        which, n = (pairs % len(words)).tolist(), n.tolist()
        for d, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            c, e = edges[d], edges[d + 1]
            rare = {words[k]: m for k, m in zip(which[c:e], n[c:e], strict=True)}
            if ids[-1] < 0:
                rare[END] = 1
            yield np.append(own[a:b], ids[-1]), np.append(known[a:b], classes[-1]), rare


def _class_of(n: int) -> int:
    return sum(n > x for x in LENGTHS)


def _train_partition(words, start: np.ndarray, rate: float, buffer: int = BUFFER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Gru(start), 0
        held: list[list[np.ndarray]] = [[] for _ in range(len(LENGTHS) + 1)]
        size = [0] * len(held)
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, texts in pieces(b.column(1)):
                mine = [t for key, t in zip(keys[first : first + len(texts)], texts, strict=True) if not held_out(key)]
                for classes in words.value.class_lists(mine):
                    c = _class_of(len(classes))
                    held[c].append(classes)
                    size[c] += len(classes)
                    if size[c] >= buffer:
                        seen += train(model, held[c], rate)
                        held[c], size[c] = [], 0
        for docs in held:
            if docs:
                seen += train(model, docs, rate)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(model.weights))), pa.array(model.weights.astype(np.float64) * seen), pa.array(np.full(len(model.weights), float(seen)))], names=["at", "w", "n"])

    return run


def _score_partition(words, weights: np.ndarray, buffer: int = BUFFER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = Gru(weights), words.value
        n = len(LENGTHS) + 1
        rows: list[list[tuple]] = [[] for _ in range(n)]
        docs: list[list[np.ndarray]] = [[] for _ in range(n)]
        size = [0] * n

        def out(c: int) -> pa.RecordBatch:
            scores = class_scores(model, docs[c])
            cols = list(zip(*rows[c], strict=True))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))]
            arrays = [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]
            rows[c], docs[c], size[c] = [], [], 0
            return pa.RecordBatch.from_arrays([*arrays, pa.array(scores)], names=["row", "held_out", "n_tokens", "known", "base", "within", "rare", "classes"])

        for b in batches:
            row_ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, texts in pieces(b.column(2)):
                for row, key, (ids, classes, rare) in zip(row_ids[first : first + len(texts)], keys[first : first + len(texts)], w.texts(texts), strict=True):
                    found = ids[ids >= 0]
                    own = w.own[found]
                    logs = w.log_count[found]
                    spread = classes[classes >= OWN_CLASS] - OWN_CLASS
                    within = float(logs[~own].sum() - w.log_total[spread].sum())
                    c = _class_of(len(classes))
                    rows[c].append((row, held_out(key), len(ids), len(found), float(logs.sum()), within, [{"word": x, "n": m} for x, m in rare.items()]))
                    docs[c].append(classes)
                    size[c] += len(classes)
                    if size[c] >= buffer:
                        yield out(c)
        for c in range(n):
            if rows[c]:
                yield out(c)

    return run


_SCORED = "row long, held_out boolean, n_tokens long, known long, base double, within double, rare array<struct<word: binary, n: long>>, classes double"


def fit(docs: DataFrame, counts: DataFrame, key: str) -> tuple[Words, np.ndarray, int, int]:
    """(words, weights, N, V). docs: key, text. counts: word, c, ending over the training documents."""
    spark = docs.sparkSession
    by_ending = {r["ending"]: (r["n"], r["v"]) for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = sum(x[0] for x in by_ending.values()), sum(x[1] for x in by_ending.values())
    most = counts.orderBy(F.desc("c"), "word").limit(TOP_WORDS).select("word", "c").toArrow()
    top = list(zip(most.column("word").to_pylist(), most.column("c").to_pylist(), strict=True))
    top.sort(key=lambda x: x[0] != END)  # the end token is a class of its own
    totals = np.zeros(ENDINGS)
    for e, (cn, cv) in by_ending.items():
        own = [c for w, c in top[:OWN_CLASS] if ending(w) == e]
        totals[e] = cn - sum(own) + cv - len(own)
    words = Words(top, np.log10(totals + 1))

    share = min(1.0, WARM_TOKENS / max(n, 1))
    sample = docs.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)).where(F.length("text") <= WARM_CHARS).limit(WARM_ROWS).select(key, "text").toArrow()
    warm, size = [], 0
    mine = [t for k, t in zip(sample.column(0).to_pylist(), _texts(sample.column(1)), strict=True) if not held_out(k)]
    del sample
    for classes in words.class_lists(mine):
        if size < 2 * WARM_TOKENS:
            warm.append(classes)
            size += len(classes)
    model = Gru()
    for rate in (0.02, 0.01):
        train(model, warm, rate)
    shared = spark.sparkContext.broadcast(words)
    parts = docs.select(key, "text").mapInArrow(_train_partition(shared, model.weights, 0.002), "at long, w double, n double")
    mean = parts.groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    weights = model.weights
    if mean:
        weights = np.empty(len(mean), np.float32)
        for r in mean:
            weights[r["at"]] = r["w"]
    return words, weights, n, v


def scored(docs: DataFrame, store: Store, key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (key, text)."""
    spark = docs.sparkSession
    texts = docs.select(key, "text")
    counts = store.put(texts.mapInArrow(_counted, "word binary, c long, ending int").groupBy("word", "ending").agg(F.sum("c").alias("c")))
    words, weights, n, v = fit(texts, counts, key)
    shared = spark.sparkContext.broadcast(words)
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), "text")
    run = _score_partition(shared, weights)
    keyed = store.put(numbered.mapInArrow(_with_key(run, docs.schema[key].dataType), f"{_SCORED}, key {docs.schema[key].dataType.simpleString()}"))
    rare = keyed.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    log = F.log10(F.coalesce("c", F.lit(0)) + 1)
    sums = rare.join(counts.select("word", "c"), "word", "left").groupBy("row").agg(F.sum(F.col("n") * log).alias("r"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"))
    out = keyed.drop("rare").join(sums, "row", "left")
    r = F.coalesce("r", F.lit(0.0))
    return out.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + r - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("classes") + F.col("within") + r).alias("score"),
    )


def _with_key(run, kind):
    """The partition scorer with the key column passed along by row."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, object] = {}

        def noted():
            for b in batches:
                keys.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                yield b

        kind_ = None
        for out in run(noted()):
            mine = [keys.pop(r) for r in out.column(0).to_pylist()]
            kind_ = kind_ or _arrow(kind)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(mine, kind_)], names=[*out.schema.names, "key"])

    return keyed


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), Store(spark, "language-model"))
