"""Words of whole Arrow columns of text and their 64-bit hashes, with numpy over the column's bytes.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) within a text; A-Z are lower-cased. A word's
hash is a polynomial of its bytes modulo 2**64, so that hashes of all words come from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of words hashed at once; tables of powers have this length, or that of a longer word.
SPAN = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)

_spaces = np.zeros(256, bool)
_spaces[[0x20, *range(0x09, 0x0E)]] = True
_kinds = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and all beyond ASCII, 2 marks
_kinds[_spaces] = 0
_kinds[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_values = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_values[0x41:0x5B] = _values[0x61:0x7B]
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SPAN)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_places(data: np.ndarray, at: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts, and n + 1 bounds: text i has the words bounds[i] to bounds[i + 1]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _spaces[data]
    kind = _kinds[data] if marks else space
    change = np.empty(n + 1, bool)  # no word goes on across position i
    change[1:n] = kind[1:] != kind[:-1]
    change[0] = change[n] = True
    change[at] = True
    starts = np.flatnonzero(~space & change[:-1])
    return starts, np.flatnonzero(~space & change[1:]) + 1, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and n + 1 bounds: text i has the words bounds[i] to bounds[i + 1].

    With `marks`, runs of marks and runs of letters and digits are words of their own.
    """
    starts, ends, bounds = word_places(data, at, marks)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), bounds
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            s = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, s + SPAN, "right")))
            e = ends[j - 1]
            up, down = _tables(int(e - s))
            run = np.empty(e - s + 1, np.uint64)
            run[0] = 0
            np.cumsum(_values[data[s:e]] * up[: e - s], out=run[1:])
            hashes[i:j] = mix((run[ends[i:j] - s] - run[starts[i:j] - s]) * down[starts[i:j] - s])
            i = j
    return hashes, bounds


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each word with the next one."""
    with np.errstate(over="ignore"):
        return mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, one row at least, to bound the memory of what is made from it."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > most and i > first:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < batch.num_rows:
        yield batch.slice(first)
