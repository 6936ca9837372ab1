"""Encoding with a byte-level BPE vocabulary, and decoding, with tree concatenation for long unsplit text.

A text is cut where the vocabulary's pattern splits it whatever stands around: before white space that follows a character
which is surely none. What lies between two cuts is a unit; Arrow numbers a batch's different units and only those not
remembered go to the library. A unit longer than ``UNSPLIT`` bytes is split by the library's own pattern, and what that leaves
unsplit is a run, which only merges can cut. A run is encoded by halves: its leaves are encoded on their own, and
two neighbours are joined by encoding a window of tokens around the join anew. The window grows until its first token is the
left side's and its last token the right side's. Then the concatenation is the encoding of the whole: a sequence is one
exactly if each two neighbouring tokens are one (merges go by rank, so pieces between which no merge happens do not
influence each other), and every two neighbours stand together in one of the three encodings.

Texts whose runs are longer than a leaf leave their task: the leaves are dealt over the cluster and encoded in parallel, then
each document's parts meet again in order, are joined as a tree and digested. A document is one row of the table, so this
is never more than one row of text in a task.

Defined results: null and empty texts have no tokens; strings of added tokens in a text are those tokens, as in the
library; repeated rows and null keys are coded one by one; bytes that are not UTF-8 after decoding become U+FFFD; an
empty table gives no rows; columns other than key and text are not read, so no name can clash.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.packing import Memory
from trailmill.llm.words import bytes_of, pieces, strings
from trailmill.plans.shared_store import Store
from trailmill.sources.tables import table

ORACLE_SQL = None
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a unit that the library still gets whole; bytes of a leaf of a run.
UNSPLIT, LEAF = 16_384, 262_144
WINDOW = 8

#: Bytes to the characters that byte-level vocabularies write for them.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTERS = [0] * 256
for _b in _SHOWN:
    _CHARACTERS[_b] = _b
for _n, _b in enumerate(b for b in range(256) if b not in _SHOWN):
    _CHARACTERS[_b] = 256 + _n
_BYTE_OF = {chr(c): b for b, c in enumerate(_CHARACTERS)}
_WRITTEN = {chr(b): chr(c) for b, c in enumerate(_CHARACTERS)}
_TO_WRITTEN = str.maketrans(_WRITTEN)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Places of blanks after characters that are surely no white space: ASCII marks, letters and digits, and characters of
    two bytes from U+00C0, three from U+4000 or four."""
    at = np.flatnonzero(_BLANK[data])
    at = at[at >= 1]
    before = [np.where(at >= k, data[at - k], 0) for k in range(1, 5)]
    tail = [(b >= 0x80) & (b < 0xC0) for b in before]
    fine = (before[0] > 0x20) & (before[0] < 0x7F)
    fine |= tail[0] & (before[1] >= 0xC3) & (before[1] <= 0xDF)
    fine |= tail[0] & tail[1] & (before[2] >= 0xE4) & (before[2] <= 0xEF)
    fine |= tail[0] & tail[1] & tail[2] & (before[3] >= 0xF0)
    return at[fine]


def _stretches(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches (start, size) of ``flat`` one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Codec:
    """A vocabulary's encoder and decoder, with a bounded memory of units."""

    def __init__(self, path: str, remembered: int = 600_000, unsplit: int = UNSPLIT, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            says = json.load(f)
        cut = says.get("pre_tokenizer") or {}
        if says.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("a byte-level vocabulary without normal form and prefix is needed")
        self.whole = Tokenizer.from_str(json.dumps(says | {"truncation": None, "padding": None}))
        self.merges = Tokenizer.from_str(json.dumps(says | {"truncation": None, "padding": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))
        self.added = {x["content"]: x["id"] for x in says["added_tokens"]}
        self.remembered, self.unsplit, self.leaf = remembered, unsplit, leaf
        shown = {k: w for w, k in says["model"]["vocab"].items()}
        self.written = [shown.get(k, "") for k in range(max([*shown, *self.added.values()]) + 1)]
        raw = [bytes(_BYTE_OF[c] for c in w) for w in self.written]
        for content, k in self.added.items():
            raw[k] = content.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self._forget()

    def _forget(self) -> None:
        self.units = Memory()
        self.units.ids = np.empty(0, np.uint32)

    def _merged(self, written: str) -> np.ndarray:
        return np.array(self.merges.encode(written, add_special_tokens=False).ids, np.uint32)

    def leaf_ids(self, data: bytes) -> np.ndarray:
        """A stretch of a run on its own; it may begin and end within a character."""
        return self._merged(data.decode("latin-1").translate(_TO_WRITTEN))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two neighbouring stretches of one run, from the encodings of each."""
        before = after = WINDOW
        while True:
            i, j = max(0, len(left) - before), min(len(right), after)
            around = [*left[i:].tolist(), *right[:j].tolist()]
            if not around:
                return np.concatenate([left, right])
            ids = self._merged("".join([self.written[k] for k in around]))
            left_agrees, right_agrees = i == 0 or ids[0] == left[i], j == len(right) or ids[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return np.concatenate([left[:i], ids, right[j:]])
            before, after = before * (1 if left_agrees else 2), after * (1 if right_agrees else 2)

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """The encodings of a run's leaves, joined as a tree."""
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0] if parts else np.empty(0, np.uint32)

    def runs(self, unit: bytes) -> Iterator[tuple[np.ndarray | None, bytes]]:
        """(ids, b'') of what the pattern splits and (None, bytes) of each run, of a unit in turn."""
        text, at = unit.decode("utf-8", "replace"), 0
        while at < len(text):
            first = min(((text.find(x, at), x) for x in self.added if text.find(x, at) >= 0), default=(len(text), ""))
            stretch, short = text[at : first[0]], []
            for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(stretch) if stretch else []:
                if b - a < self.unsplit // 4 or len(part := stretch[a:b].encode()) <= self.unsplit:
                    short.append(stretch[a:b].encode().decode("latin-1").translate(_TO_WRITTEN))
                    continue
                yield self._all(short), b""
                short = []
                yield None, part
            if first[1]:
                yield np.append(self._all(short), np.uint32(self.added[first[1]])), b""
            elif short:
                yield self._all(short), b""
            at = first[0] + len(first[1])

    def _all(self, written: list[str]) -> np.ndarray:
        return np.array([k for e in self.merges.encode_batch_fast(written, add_special_tokens=False) for k in e.ids], np.uint32)

    def _leaves(self, run: bytes) -> list[bytes]:
        """A run by halves, until each is at most a leaf."""
        if len(run) <= self.leaf:
            return [run]
        half = len(run) // 2
        return self._leaves(run[:half]) + self._leaves(run[half:])

    def _long(self, unit: bytes) -> list[tuple[np.ndarray | None, list[bytes]]]:
        """A long unit's parts: ids, or the leaves of a run that is to be encoded in parallel."""
        out: list[tuple[np.ndarray | None, list[bytes]]] = []
        for ids, run in self.runs(unit):
            if ids is None:
                leaves = self._leaves(run)
                if len(leaves) == 1:
                    half = len(run) // 2
                    out.append((self.join(self.leaf_ids(run[:half]), self.leaf_ids(run[half:])), []))
                else:
                    out.append((None, leaves))
            else:
                out.append((ids, []))
        return out

    def encode(self, texts: list[bytes]) -> list[list[tuple[np.ndarray | None, list[bytes]]]]:
        """The parts of each text; all but those with runs longer than a leaf have one part, their ids."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0, *map(len, texts)])
        places = np.union1d(sure_cuts(data), starts)
        units = strings(places, data).dictionary_encode()
        known = units.dictionary
        _, sizes = bytes_of(known)
        long = sizes > self.unsplit
        number = self.units.find(known)
        if (new := (number < 0) & ~long).any():
            if len(self.units.keys) + int(new.sum()) > self.remembered:
                self._forget()
                new = ~long
            number[new] = len(self.units.keys) + np.arange(int(new.sum()))
            learnt = known.filter(pa.array(new))
            names = [x.decode("utf-8", "replace") for x in learnt.to_pylist()]
            found = [e.ids for k in range(0, len(names), 4096) for e in self.whole.encode_batch_fast(names[k : k + 4096], add_special_tokens=False)]
            self.units.add(learnt, np.array([k for x in found for k in x], np.uint32), np.array([len(x) for x in found], np.int64))
        code = units.indices.to_numpy()
        apart = np.flatnonzero(long[code]) if long.any() else np.empty(0, np.int64)
        wide = dict.fromkeys(code[apart].tolist())
        for k in wide:
            wide[k] = self._long(known[k].as_py())
        held = np.where(long[code], 0, number[code]) if len(apart) else number[code]
        if len(apart) and not len(self.units.keys):
            ids, n = np.empty(0, np.uint32), np.zeros(len(code), np.int64)
        else:
            n = np.where(long[code], 0, self.units.size[held]) if len(apart) else self.units.size[held]
            ids = _stretches(self.units.ids, self.units.start[held], n)
        upto = np.concatenate(([0], np.cumsum(n)))
        edge = np.searchsorted(places[:-1], starts)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            parts, at = [], a
            for k in apart[np.searchsorted(apart, a) : np.searchsorted(apart, b)].tolist():
                parts += [(ids[upto[at] : upto[k]], []), *wide[int(code[k])]]
                at = k + 1
            parts.append((ids[upto[at] : upto[b]], []))
            out.append(parts if any(x is None for x, _ in parts) else [(np.concatenate([x for x, _ in parts]) if len(parts) > 1 else parts[0][0], [])])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' text."""
        return _stretches(self.bytes, self.start[ids], self.size[ids]).tobytes().decode("utf-8", "replace").encode()


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, unsplit: int = UNSPLIT, leaf: int = LEAF) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (path, unsplit, leaf)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, unsplit=unsplit, leaf=leaf)
    return _CODECS[key]


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(coder: Codec, ids: np.ndarray) -> tuple[int, str, str, list, str]:
    text = coder.decode(ids)
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest(), ids, text


def coded(df: DataFrame, vocabulary: str, store: Store, key: str = "doc_id", text: str = "text", with_ids: bool = False, unsplit: int = UNSPLIT, leaf: int = LEAF) -> DataFrame:
    """key, n_tokens and the SHA-256 of ids and of the decoded text; with ``ids`` (array of int) and ``decoded`` if ``with_ids``."""
    kind = df.select(key).schema[0].dataType.simpleString()
    out = f"key {kind}, {_DIGESTS}" + (", ids array<int>, decoded string" if with_ids else "")
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
    width = 5 if with_ids else 3
    names = list(types)[:width]

    def columns(rows: list[tuple]) -> list[pa.Array]:
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        if with_ids:
            cols[3:5] = [[None if x is None else x.astype(np.int32) for x in cols[3]], [None if x is None else x.decode() for x in cols[4]]]
        return [pa.array(c, t) for c, t in zip(cols[:width], list(types.values())[:width], strict=True)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of the texts that are done, and the parts of the others: ids (run -1) or a leaf of a run."""
        from pyspark import TaskContext

        coder, context, n = codec(vocabulary, unsplit, leaf), TaskContext.get(), 0
        base = (context.partitionId() if context else 0) << 40
        for b in batches:
            for at, texts in pieces(b.column(1)):
                keys, rows, parted = [], [], []
                for i, parts in enumerate(coder.encode(texts)):
                    n += 1
                    if len(parts) == 1:
                        keys.append((at + i, None, None, None, None))
                        rows.append(_digested(coder, parts[0][0]))
                        continue
                    place = 0
                    for run, (ids, leaves) in enumerate(parts):
                        for payload in leaves if ids is None else [ids.astype("<u4").tobytes()]:
                            parted.append((at + i, base | n, place, run if ids is None else -1, payload))
                            place += 1
                whole = [*keys, *parted]
                rows += [(None,) * 5] * len(parted)
                index, row, place, run, payload = zip(*whole, strict=True)
                more = [pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(run, pa.int32()), pa.array(payload, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index)), *columns(rows), *more], names=["key", *names, "row", "place", "run", "payload"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, unsplit, leaf)
        for b in batches:
            ids = [coder.leaf_ids(x).astype("<u4").tobytes() for x in b.column("payload").to_pylist()]
            yield b.set_column(b.schema.get_field_index("payload"), "payload", pa.array(ids, pa.binary()))

    def together(parts: pa.Table) -> pa.Table:
        coder, held, run_of, open_ = codec(vocabulary, unsplit, leaf), [], -1, []
        parts = parts.sort_by("place")
        for run, payload in zip(parts["run"].to_pylist(), parts["payload"].to_pylist(), strict=True):
            if run != run_of and open_:
                held.append(coder.joined(open_))
                open_ = []
            run_of = run
            (held if run < 0 else open_).append(np.frombuffer(payload, "<u4"))
        if open_:
            held.append(coder.joined(open_))
        return pa.table([parts["key"].combine_chunks()[:1], *columns([_digested(coder, np.concatenate(held))])], names=["key", *names])

    passed = f"{out}, row long, place int, run int, payload binary"
    seen = store.put(df.select(F.col(key).alias("key"), text).mapInArrow(first, passed))
    apart = seen.where("row IS NOT NULL").select("key", "row", "place", "run", "payload")
    encoded = apart.where("run >= 0").repartition("row", "place").mapInArrow(leaves, apart.schema)
    grouped = apart.where("run < 0").unionAll(encoded).groupBy("row").applyInArrow(together, out)
    return seen.where("row IS NULL").select("key", *names).unionAll(grouped).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), Store(spark, "bpe"))
