"""Jumps to any word of ``random.Random(seed)``.

The generator's next state is a linear function over GF(2) of the last, so the state after k words is x^k modulo its characteristic
polynomial, with the state's own next words in place of the powers of x. Polynomials are whole numbers, whose bits are the coefficients.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

_DEGREE, _STATE = 19937, 624


@cache
def _polynomial() -> int:
    """Of least degree, by Berlekamp and Massey from the last bits of as many words as it takes."""
    made = random.Random(1)
    now, last, length, gap, bits = 1, 1, 0, 1, 0
    for n in range(2 * _DEGREE):
        bits = bits << 1 | made.getrandbits(1 << 5) & 1
        if (now & bits).bit_count() & 1:
            if 2 * length <= n:
                now, last, length, gap = now ^ last << gap, now, n + 1 - length, 0
            else:
                now ^= last << gap
        gap += 1
    return int(f"{now:0{length + 1}b}"[::-1], 2)


@cache
def _power(k: int) -> int:
    """x^k modulo the polynomial."""
    p, out = _polynomial(), 1
    low = [e for e in range(_DEGREE) if p >> e & 1]
    for bit in f"{k:b}":
        # A square has the same bits, twice as far apart.
        out = int("0".join(f"{out:b}"), 2) << int(bit)
        while high := out >> _DEGREE:
            out &= (1 << _DEGREE) - 1
            for e in low:
                out ^= high << e
    return out


def at(seed: int, start: int) -> np.random.MT19937:
    """A generator whose first word is number ``start`` (from 0) of ``random.Random(seed)``."""
    *key, place = random.Random(seed).getstate()[1]
    made = np.random.MT19937()

    def put(state, pos):
        made.state = {"bit_generator": "MT19937", "state": {"key": state, "pos": pos}}

    put(np.array(key, np.uint32), place)
    if start >= 64 * _STATE:
        # The state as a run of words: those to come are the next states' words.
        run = [made.state["state"]["key"]]
        while len(run) * _STATE < _DEGREE + _STATE:
            made.random_raw(_STATE)
            run.append(made.state["state"]["key"])
        run, state = np.concatenate(run), np.zeros(_STATE, np.uint32)
        for e in np.flatnonzero(np.frombuffer(f"{_power(start):b}"[::-1].encode(), np.uint8) == 0x31).tolist():
            state ^= run[e : e + _STATE]
        put(state, place)
    elif start:
        made.random_raw(start)
    return made
