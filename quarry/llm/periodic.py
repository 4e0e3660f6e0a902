"""Periodic runs of words: all maximal repetitions of each text, from its Lyndon arrays, in linear time.

A run with smallest period p holds, in one of the two orders of the alphabet, a longest Lyndon word [l, r) of length p, where
r is the next smaller suffix of l. Both arrays come from one stack of suffixes each, and how far two suffixes match is never
found out twice: what an earlier match covers is read off its copy, and only words beyond its end are compared. The same
holds for matches to the left. Words are compared by their rank in sorted order alone; there are no hashes and no suffix structures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import textscan
from quarry.llm.common import others, uncollected

#: Bytes of a word that are its rank by themselves, with its length; longer words are sorted.
SHORT = 7

Run = tuple[int, int, int]  # start, length, period


def next_smaller(t: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix l of t[:-1] the next smaller suffix r (or n), and how many symbols both begin with. t ends with a
    symbol below all others."""
    n = len(t) - 1
    nss, right, pss, back = [n] * n, [0] * n, [-1] * n, [0] * n  # back: symbols in common with the previous smaller suffix
    reach = mirror = shift = 0  # the match that ends last: t[mirror:reach] == t[mirror - shift:reach - shift]
    for r in range(1, n):
        c = t[r]
        top, e = r - 1, 0
        first = True
        while top >= 0:
            if r + e < reach and top >= mirror:
                x, y = top - shift, r - shift
                popped = nss[x] == y
                known = right[x] if popped else back[y]
                if known < reach - r:
                    e = known
                else:
                    a, b = reach - r + top, reach
                    while t[a] == t[b]:
                        a += 1
                        b += 1
                    e, popped = b - r, t[b] < t[a]
                    if b > reach:
                        reach, mirror, shift = b, r, r - top
            elif not first and below != e:
                popped = below > e
                if not popped:
                    e = below
            elif e == 0 and t[top] != c:
                popped = c < t[top]
            else:
                a, b = top + e, r + e
                while t[a] == t[b]:
                    a += 1
                    b += 1
                e, popped = b - r, t[b] < t[a]
                if b > reach:
                    reach, mirror, shift = b, r, r - top
            if not popped:
                break
            nss[top], right[top] = r, e
            below, first = back[top], False
            top = pss[top]
        if top >= 0:
            pss[r], back[r] = top, e
    return nss, right


def left_extensions(t: list[int], nss: list[int]) -> list[int]:
    """For each l how many symbols before it are those before nss[l]."""
    n = len(nss)
    left, reach, shift = [0] * n, n, 0  # t[reach:l] == t[reach + shift:l + shift] for the last l that set it
    for low in range(n - 1, -1, -1):
        r, k = nss[low], 0
        if low > reach:
            k = left[low + shift]
            if k < low - reach:
                left[low] = k
                continue
            k = low - reach
        a, b = low - 1 - k, r - 1 - k
        while a >= 0 and t[a] == t[b]:
            a -= 1
            b -= 1
        left[low] = low - 1 - a
        if a + 1 < reach:
            reach, shift = a + 1, r - low
    return left


def runs(symbols: list[int], least: int = 2, exponent: int = 2) -> list[Run]:
    """All runs (start, length, period) of the symbols (integers of 0 and more), by start and period: stretches with that
    smallest period, of `least` symbols and `exponent` (2 or more) periods at least, that no neighbour extends."""
    n, found = len(symbols), set()
    high = max(symbols, default=0)
    for t in ([*symbols, -1], [*(high - x for x in symbols), -1]):
        nss, right = next_smaller(t)
        # the first root of a run begins less than a period after it, so this much of it lies beyond the root
        roots = [low for low in range(n) if right[low] and right[low] > (exponent - 2) * (nss[low] - low)]
        if not roots:
            continue
        left = left_extensions(t, nss)
        for low in roots:
            p = nss[low] - low
            length = p + left[low] + right[low]
            if length >= least and length >= exponent * p:
                found.add((low - left[low], length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def repeated(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) > 0


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words data[start:end], in a total order: words of up to SHORT bytes by these, longer ones after them, sorted."""
    sizes = ends - starts
    key = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    for k in range(SHORT):
        key = (key << np.uint64(8)) | np.where(k < sizes, padded[starts + k], 0).astype(np.uint64)
    key = key | (sizes.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        whole = data.tobytes()
        words = [whole[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        new = np.fromiter((words[a] != words[b] for a, b in zip(order[1:], order, strict=False)), bool, max(0, len(order) - 1))
        key[long[order]] = np.concatenate([[0], np.cumsum(new)]).astype(np.uint64) | np.uint64(255 << 56)
    order = np.argsort(key, kind="stable")
    out = np.empty(len(key), np.int64)
    sorted_key = key[order]
    out[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]).astype(np.int64)) if len(key) else 0
    return out


def _pass(batches: Iterator[pa.RecordBatch], at: int, least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for whole in batches:
        for batch in textscan.pieces(whole, at):
            data, bounds = textscan.text_bytes(batch.column(at))
            starts, ends, first = textscan.word_places(data, bounds)
            number = ranks(data, starts, ends)
            texts, every, counts = [], [], np.diff(first)
            raw = data.tobytes()
            with uncollected():
                for i in range(batch.num_rows):
                    found = runs(number[first[i] : first[i + 1]].tolist(), least, exponent)
                    words = raw[bounds[i] : bounds[i + 1]].split()
                    if found:
                        gone = repeated(len(words), found).tolist()
                        words = [w for w, g in zip(words, gone, strict=True) if not g]
                    texts.append(b" ".join(words))
                    every.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            made = [pa.array(counts, pa.int64()), pa.array(every, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), *FOUND])


FOUND = ("n_words", "runs", "collapsed")


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """docs without text, with n_words, `runs` (array of start, length, period in words, by start and period) and `collapsed`,
    the text's words joined by one space without those that lie in a run after its first period.

    Words are runs of characters other than ASCII white space, compared as they are. A null text is empty: no words, no runs
    and an empty collapsed text. Each text is read whole in the task that has it, in memory and time linear in its length,
    and nothing is shuffled. Repeated rows come out alike, an empty table gives no rows, and other columns pass through, but
    for those named like the results (in any case).
    """
    rows = docs.select(*others(docs, FOUND))
    at = rows.columns.index("text")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    more = ["n_words bigint", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]
    return rows.mapInArrow(lambda batches: _pass(batches, at, least, exponent), ", ".join(names + more))
