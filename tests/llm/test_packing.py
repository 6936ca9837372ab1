import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trailmill.llm import packing as K

PATH = public_tokenizers.path(K.VOCABULARY)


def check(rows, texts, capacity):
    plain = Tokenizer.from_file(PATH)
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, K.END], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist()
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for spans, total in [(x, len(ids[d])) for d, x in pieces.items()] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at == capacity or at & at - 1 == 0


def test_exact_round_trip_without_padding(docs, texts):
    for capacity, window in ((4096, 10_000), (64, 200)):
        check(K.packed(docs, PATH, capacity=capacity, window_tokens=window, with_ids=True).collect(), texts, capacity)


def test_equal_lengths_are_cut_to_fit():
    out = []
    p = K.Packer(100, out.append)
    for d in range(50):
        p.add((d, 0, 61))
    p.finish()
    assert sum(n for s in out for _, _, n in s) == 50 * 61
    assert sum(sum(n for _, _, n in s) != 100 for s in out) <= 7


def test_fill_is_the_closest_possible():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 90))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = K.closest_fill(sorted((n for n in counts if n <= room), reverse=True), counts.__getitem__, room)
        assert all(k <= counts[n] for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def test_forgetting_words_changes_nothing(texts):
    small, large = K.Encoder(PATH, remembered=50), K.Encoder(PATH)
    raw = [(t or "").encode() for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(small.encode(raw), large.encode(raw)))


def test_empty_table(empty):
    assert K.packed(empty, PATH).count() == 0
