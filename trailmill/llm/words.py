"""White-space words of many texts at once, numbered by Arrow without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def strings(places: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``, from their places and the end."""
    return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, sizes) of binary values."""
    places = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[places[0] : places[-1]], np.diff(places)


def numbered(texts: list[bytes], lower: bool = False, between: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word, the different words, where each text's words begin and the end). Words end at ASCII white space,
    or at any byte that ``between`` (256 truths, the blank's among them) marks; ``lower``: A-Z as a-z."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = (joined == 32) | ((joined - np.uint8(9)) <= 4) if between is None else between[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    data = joined[~space]
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    words = strings(np.concatenate(([0], np.cumsum(size))), data).dictionary_encode()
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words.indices.to_numpy().astype(np.int64), words.dictionary, np.searchsorted(begin, starts)


def pieces(column: pa.Array, at_once: int = 8_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a text column, null as empty, about ``at_once`` bytes at a time and one text at least."""
    column = column.cast(pa.large_binary())
    held: list[bytes] = []
    first = size = 0
    for k in range(len(column)):
        held.append(column[k].as_py() or b"")
        size += len(held[-1])
        if size >= at_once:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held
