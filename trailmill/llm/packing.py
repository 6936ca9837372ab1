"""Sequence packing by minimum bin slack.

Tokens stream through a task in windows of documents. Each document is cut into full sequences and one rest; the
rests of a window wait as a multiset of lengths. A sequence is seeded with the longest rest, and a bitset
subset-sum (bit n of an integer: total n can be reached) finds the multiset of other lengths that comes closest to
capacity; the layers of the bitset are walked back to the count of each length. What slack is then left is filled
by cutting the next longest rest, whose remainder waits on. Rests that no sequence has taken pass to the next
window, and at the end of a task the last open tokens go to sequences whose lengths are powers of two, which need
no padding. No rows are exchanged, memory is that of one window, and a lost task is simply run again.

Defined results: null and empty texts are one piece, the end token; repeated rows are packed one by one; a very long
text is encoded in pieces and may fill many sequences; among equal lengths the last that came is taken first (which
one has no effect on padding); an empty table gives no rows; columns other than key and text are not read, so no name
can clash; ``sequence_id`` is unique over all tasks (task number in the upper bits) and not gapless.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from trailmill.llm.words import bytes_of, numbered, strings
from trailmill.sources.tables import table

ORACLE_SQL = None
VOCABULARY = "word_bpe_49k.json"
END = 2
CAPACITY = 4096
WINDOW_TOKENS = 2_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: What a vocabulary's file must say for its words to be cut here; any other goes through the library as it stands.
_NORMAL = ("NFC", "Replace", "Lowercase")
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes to the characters that byte-level vocabularies write for them.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHARACTER = np.zeros(256, "<u2")
_AS_CHARACTER[_SHOWN] = _SHOWN
_AS_CHARACTER[[x for x in range(256) if x not in _SHOWN]] = np.arange(256, 256 + 256 - len(_SHOWN))
_AS_CHARACTER[32] = 32


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches (start, size) of ``flat`` one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Memory:
    """Ids of binary keys: the keys in one Arrow array, their ids in one flat array."""

    def __init__(self):
        self.keys = pa.array([], pa.large_binary())
        self.ids, self.start, self.size = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, keys: pa.Array) -> np.ndarray:
        """The number of each key, -1 if it is not held."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype(np.int64)

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ids, self.start, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.start, begin]), np.concatenate([self.size, sizes])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of entries in turn."""
        size = self.size[numbers]
        return _ragged(self.ids, self.start[numbers], size), size


class Encoder:
    """Ids of a vocabulary whose pre-tokenizer never joins text over white space, with a bounded memory of words.

    A batch of texts is cut at white space in one pass over its bytes; Arrow numbers its different words, and only
    those not remembered are learnt. Words of ASCII and Latin-1 letters, digits and marks are lower-cased and cut here
    and their parts go to the vocabulary's merges alone; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = 600_000, at_once: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            says = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(says))
        self.remembered, self.at_once = remembered, at_once
        normal, cut = says.get("normalizer") or {}, says.get("pre_tokenizer") or {}
        steps = tuple(x.get("type") for x in normal.get("normalizers", ()))
        cuts = cut.get("pretokenizers", ())
        known = steps == _NORMAL and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _CUT} and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and says["model"].get("end_of_word_suffix") == "</w>"
        self.merges = None
        if known:
            self.merges = Tokenizer.from_str(json.dumps(says | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
            self.last = np.zeros(max(says["model"]["vocab"].values()) + 1, bool)
            self.last[[k for w, k in says["model"]["vocab"].items() if w.endswith("</w>")]] = True
        self.words, self.parts = Memory(), Memory()

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.to_pylist()
        found = [np.array(e.ids, np.uint16) for k in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[k : k + 4096]], add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint16), *found]), np.array([len(x) for x in found], np.int64)

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for k in range(0, len(parts), 8192):
            some = parts.slice(k, 8192)
            data, size = bytes_of(some)
            spaced = np.full(len(data) + len(size), 32, np.uint8)
            spaced[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
            shown = _AS_CHARACTER[spaced].tobytes().decode("utf-16-le")
            ids.append(np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint16))
            ends = np.flatnonzero(self.last[ids[-1]])
            if len(ends) != len(some) or ends[-1] != len(ids[-1]) - 1:
                raise ValueError("the vocabulary does not end every part with one token")
            sizes.append(np.diff(ends, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _cut(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of ASCII and Latin-1 letters, digits and marks without apostrophes."""
        data, begin = data.copy(), np.cumsum(size) - size
        data[(data >= 65) & (data <= 90)] += 32
        data[1:][(data[:-1] == 0xC3) & (data[1:] <= 0x9E)] += 32
        kind = np.where((data >= 97) & (data <= 122) | (data >= 0x80), 1, np.where((data >= 48) & (data <= 57), 2, 3))
        first = (kind == 2) | np.append(True, kind[1:] != kind[:-1])
        first[begin] = True
        places = np.append(np.flatnonzero(first), len(data))
        parts = strings(places, data).dictionary_encode()
        number = self.parts.find(parts.dictionary)
        if (new := number < 0).any():
            if len(self.parts.keys) + int(new.sum()) > self.remembered:
                self.parts, new = Memory(), np.ones(len(new), bool)
            number[new] = len(self.parts.keys) + np.arange(int(new.sum()))
            learnt = parts.dictionary.filter(pa.array(new))
            self.parts.add(learnt, *self._merged(learnt))
        ids, sizes = self.parts.of(number[parts.indices.to_numpy()])
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.append(np.searchsorted(places, begin), len(sizes))]
        return ids, np.diff(upto)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """The numbers that the new words get."""
        data, size = bytes_of(new)
        begin = np.cumsum(size) - size
        after = np.append(data[1:], np.uint8(0))
        after[begin[1:] - 1] = 0
        fine = (data > 32) & (data < 127) & (data != 0x27) & ~((data == 0x3C) & (after == 0x7C))
        lead = (data == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        fine |= lead
        fine[1:] |= lead[:-1] & (data[1:] >= 0x80)
        plain = np.logical_and.reduceat(fine, begin) if self.merges is not None else np.zeros(len(new), bool)
        number = np.empty(len(new), np.int64)
        for mine, learn in ((plain, lambda: self._cut(data[np.repeat(plain, size)], size[plain])), (~plain, lambda: self._whole(new.filter(pa.array(~plain))))):
            if n := int(mine.sum()):
                number[mine] = len(self.words.keys) + np.arange(n)
                self.words.add(new.filter(pa.array(mine)), *learn())
        return number

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        codes, words, starts = numbered(texts)
        if not len(codes):
            return [np.empty(0, np.uint32) for _ in texts]
        number = self.words.find(words)
        if (new := number < 0).any():
            if len(self.words.keys) + int(new.sum()) > self.remembered:
                self.words, new = Memory(), np.ones(len(new), bool)
            number[new] = self._learn(words.filter(pa.array(new)))
        ids, sizes = self.words.of(number[codes])
        upto = np.concatenate(([0], np.cumsum(sizes)))[starts]
        ids = ids.astype("<u4")
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text; a text above the size of a batch is cut at white space, so that memory follows the batch."""
        held: list[tuple[bytes, bool]] = []  # pieces, and whether a piece ends its text
        n, open_ = 0, []

        def flushed() -> Iterator[np.ndarray]:
            nonlocal n, open_
            for ids, (_, ends) in zip(self._batch([x for x, _ in held]), held, strict=True):
                if ends and not open_:
                    yield ids
                else:
                    open_.append(ids.copy())
                    if ends:
                        yield np.concatenate(open_)
                        open_ = []
            held.clear()
            n = 0

        for text in texts:
            at = 0
            while len(text) - at > self.at_once and (cut := _SPACE.search(text, at + self.at_once)):
                held.append((text[at : cut.end()], False))
                at = cut.end()
                yield from flushed()
            held.append((text[at:] if at else text, True))
            n += len(text) - at
            if n >= self.at_once:
                yield from flushed()
        if held:
            yield from flushed()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def closest_fill(lengths: Iterable[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` closest without passing it. ``lengths``: descending, at most ``room``.

    Bit n of ``reach`` says that total n can be made. A length joins in lots of 1, 2, 4, ... up to its count; each
    lot's bitset is kept, and walking the lots back from the best total gives the counts.
    """
    reach, full = 1, (1 << room + 1) - 1
    lots: list[tuple[int, int, int]] = []
    for n in lengths:
        left, lot = min(count(n), room // n), 1
        while left:
            take = min(lot, left)
            lots.append((n, take, reach))
            reach |= reach << n * take & full
            left -= take
            lot *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(lots):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + take
            total -= n * take
    return used


class Packer:
    """Rests by length; ``close`` fills sequences until fewer than ``keep`` tokens wait."""

    def __init__(self, capacity: int, emit: Callable[[list[tuple]], None]):
        self.capacity, self.emit = capacity, emit
        self.rests: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.waiting = 0

    def add(self, rest: tuple) -> None:
        """rest: (document, start, length)."""
        n = rest[2]
        if n not in self.rests:
            self.rests[n] = []
            insort(self.lengths, n)
        self.rests[n].append(rest)
        self.waiting += n

    def _take(self, n: int) -> tuple:
        rest = self.rests[n].pop()
        if not self.rests[n]:
            del self.rests[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.waiting -= n
        return rest

    def close(self, keep: int) -> None:
        while self.waiting >= max(keep, self.capacity):
            held = [self._take(self.lengths[-1])]
            room = self.capacity - held[0][2]
            if room:
                fit = self.lengths[: bisect_right(self.lengths, room)]
                used = closest_fill(reversed(fit), lambda n: len(self.rests[n]), room)
                for n, k in used.items():
                    held += [self._take(n) for _ in range(k)]
                room -= sum(n * k for n, k in used.items())
            if room:
                doc, start, n = self._take(self.lengths[-1])
                held.append((doc, start, room))
                self.add((doc, start + room, n - room))
            self.emit(held)

    def finish(self) -> None:
        """The last tokens, in sequences whose lengths are powers of two."""
        self.close(self.capacity)
        left = [self._take(self.lengths[-1]) for _ in range(sum(map(len, self.rests.values())))]
        size = 1 << max(0, sum(x[2] for x in left).bit_length() - 1)
        while left:
            total = sum(x[2] for x in left)
            while size > total:
                size //= 2
            held, room = [], size
            while room:
                doc, start, n = left.pop(0)
                held.append((doc, start, min(n, room)))
                if n > room:
                    left.insert(0, (doc, start + room, n - room))
                room -= min(n, room)
            self.emit(held)


def packed(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece, as ``PIECES``; with ``ids`` (array of int) if ``with_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        rows: list[tuple] = []
        held: dict[int, np.ndarray] = {}
        names: dict[int, tuple] = {}
        open_: dict[int, int] = {}
        n_sequences = n_docs = 0

        def emit(pieces: list[tuple]) -> None:
            nonlocal n_sequences
            offset = 0
            for doc, start, n in pieces:
                ids = held[doc][start : start + n]
                rows.append((names[doc][0], start, n, zlib.crc32(ids), names[doc][1], base | n_sequences, offset, ids if with_ids else None))
                offset += n
                open_[doc] -= n
                if not open_[doc]:
                    del held[doc], names[doc], open_[doc]
            n_sequences += 1

        def drained() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            out = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(out, names=[*(f.split()[0] for f in PIECES.split(", ")), *["ids"] * with_ids])

        encode = encoder(vocabulary).encode
        packer = Packer(capacity, emit)
        for b in batches:
            keys = b.column(0).to_pylist()
            for k in range(0, b.num_rows, 2048):
                texts = [t or b"" for t in b.column(1).slice(k, 2048).cast(pa.large_binary()).to_pylist()]
                for key_, ids in zip(keys[k : k + 2048], encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(END))
                    doc, n = n_docs, len(ids)
                    n_docs += 1
                    held[doc], names[doc], open_[doc] = ids, (key_, n), n
                    full = n // capacity * capacity
                    for start in range(0, full, capacity):
                        emit([(doc, start, capacity)])
                    if n > full:
                        packer.add((doc, full, n - full))
                    if packer.waiting >= window_tokens:
                        packer.close(window_tokens // 16)
                if len(rows) >= 10_000:
                    yield drained()
        packer.finish()
        if rows:
            yield drained()

    return df.select(key, text).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
