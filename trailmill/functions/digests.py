"""The leading word of SHA-256 for many short messages at once, in numpy: one message at a time costs more in calls than in hashing."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
_FIRST = np.array([int(math.sqrt(p) % 1 * 2**32) for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([int(math.cbrt(p) % 1 * 2**32) for p in _PRIMES], np.uint32)
#: Bits to rotate by; the last of the schedule's are shifts.
_TURNS = {name: tuple((np.uint32(k), np.uint32(32 - k)) for k in turns) for name, turns in {"a": (2, 13, 22), "e": (6, 11, 25), "low": (7, 18, 3), "high": (17, 19, 10)}.items()}
#: Bytes of a message that fit one block with their end mark and length.
_ONE_BLOCK = 55


def _mixed(x: np.ndarray, name: str, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The exclusive or of three rotations of x (for the schedule's: of two and a shift)."""
    for k, (right, left) in enumerate(_TURNS[name]):
        np.right_shift(x, right, out=spare if k else out)
        if k:
            np.bitwise_xor(out, spare, out=out)
        if k < 2 or name in ("a", "e"):
            np.left_shift(x, left, out=spare)
            np.bitwise_xor(out, spare, out=out)
    return out


def _leading(w: np.ndarray) -> np.ndarray:
    """The first word of the digests of one block each. w: 16 rows of words, which are overwritten."""
    a, b, c, d, e, f, g, h = (np.full(w.shape[1], v, np.uint32) for v in _FIRST)
    t, spare = np.empty_like(a), np.empty_like(a)
    bc = b ^ c
    for i in range(64):
        x = w[i % 16]
        if i >= 16:
            x += _mixed(w[(i - 15) % 16], "low", t, spare)
            x += _mixed(w[(i - 2) % 16], "high", t, spare)
            x += w[(i - 7) % 16]
        h += x
        h += _ROUND[i]
        h += _mixed(e, "e", t, spare)
        np.bitwise_xor(f, g, out=t)
        t &= e
        t ^= g
        h += t
        d += h
        h += _mixed(a, "a", t, spare)
        # The majority of a, b and c, by the last round's a ^ b.
        np.bitwise_xor(a, b, out=t)
        bc &= t
        bc ^= b
        h += bc
        bc, t = t, bc
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return a + _FIRST[0]


def leading_words(seed: str, b: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The first 32 bits of SHA-256 of "seed|b|i" for whole numbers from 0."""
    out, start = np.empty(len(b), np.uint32), f"{seed}|".encode()
    lengths = [np.searchsorted(10 ** np.arange(1, 19), x, "right") + 1 for x in (b, i)]
    kinds = lengths[0] * 32 + lengths[1]
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        size = len(start) + kind // 32 + 1 + kind % 32
        if size > _ONE_BLOCK:
            out[at] = [int.from_bytes(hashlib.sha256(b"%s%d|%d" % (start, x, y)).digest()[:4]) for x, y in zip(b[at].tolist(), i[at].tolist(), strict=True)]
            continue
        w, place = np.zeros((16, len(at)), np.uint32), len(start)
        fixed = bytearray(64)
        fixed[:place], fixed[place + kind // 32], fixed[size], fixed[62:] = start, 0x7C, 0x80, (8 * size).to_bytes(2)
        w |= np.frombuffer(fixed, ">u4").astype(np.uint32)[:, None]
        for numbers, length in ((b, kind // 32), (i, kind % 32)):
            # Division of 32 bits is the faster one.
            rest = numbers[at].astype(np.uint32 if length < 10 else np.uint64)
            for k in range(place + length - 1, place - 1, -1):
                tens = rest // 10
                w[k // 4] |= (rest - tens * 10 + 48).astype(np.uint32) << np.uint32(24 - k % 4 * 8)
                rest = tens
            place += length + 1
        out[at] = _leading(w)
    return out
