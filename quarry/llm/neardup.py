"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has SYMBOLS symbols of 16 bits, each from the minimum of one hash over its shingles; symbols of
two documents agree with the chance of their sets' similarity. The distance of two signatures is the number of unequal
symbols. A signature is split into CHUNKS chunks of WIDTH symbols. If two differ in LIMIT = 2 * CHUNKS - 1 symbols at
most, some chunk has one error at most (pigeonhole), so for each chunk and each of its places the other WIDTH - 1
symbols are a key: equal keys are all candidates, and no pair within LIMIT is missed. At similarity 0.8 the distance
is 12.8 on average with a deviation of 3.2, and above 31 for some 8 pairs in 100 millions: such a pair is no link, as
candidates beyond LIMIT are left out, those of the exact test below included. The others are confirmed on the full sets.

Keys can be shared by a third of all documents, so no task sees a key's documents together and not all their pairs are
made. Rows of a key are compared with one of them, its centre, the one that shares most keys with others; what is
linked makes one component, and only keys whose documents are still in several components go on. After STARS such
rounds the candidates left across components are compared in full, if they pass an exact test first: sets in a fixed
order of all shingles, the rarest first, can only be similar if they share one of their first n - ceil(0.8 n) + 1, and if
what follows the first one shared is long enough to hold the needed intersection. So documents that only have a very
common passage in common, or copies with many edits of their own, don't make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import cut, others, settings
from quarry.llm.components import components

SYMBOLS, WIDTH = 64, 4
CHUNKS = SYMBOLS // WIDTH
LIMIT = 2 * CHUNKS - 1
STARS = 2
#: Counters of shingles, by hash, for the order of the exact test. Equal counts are ordered by the hash, so any size gives right results.
COUNTERS = 1 << 17
#: At most so many ids, or pairs of ids, are broadcast to pick texts and sets; beyond that the join is shuffled.
PICKED = 1_000_000
#: Texts and sets, which can be large, that a Python worker gets at once.
TEXTS, SETS = 1000, 32

OUT = ("n_shingles", "component_id", "kept")
_seeds = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, with n + 1 bounds; of fewer words, the one run of all of them."""
    hashes, bounds = textscan.words(*textscan.text_bytes(column))
    counts = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.uint64), bounds
    mult = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        run = np.full(len(hashes), np.uint64(width))
        start = np.arange(len(hashes)) - np.repeat(bounds[:-1], counts)  # place in its text
        left = np.repeat(counts, counts) - start  # words from here to the text's end
        for k in range(width):
            there = np.flatnonzero(left > k)
            run[there] = textscan.mix(run[there] * mult + hashes[there + k])
    keep = (left >= width) | (start == 0)
    sums = np.concatenate([[0], np.cumsum(keep)])
    return run[keep], sums[bounds]


def sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted, and new bounds."""
    parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a > 1:
            x = np.sort(hashes[a:b])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:
            x = hashes[a:b]
        parts.append(x)
        sizes[i] = len(x)
    return np.concatenate(parts) if parts else hashes, np.concatenate([[0], np.cumsum(sizes)])


def signatures(members: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols for each non-empty set, as rows of 16-bit integers."""
    full = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(full), SYMBOLS), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(SYMBOLS):
            low = np.minimum.reduceat(members * _seeds[k], full) if len(full) else np.zeros(0, np.uint64)
            out[:, k] = textscan.mix(low) >> np.uint64(48)
    return out


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textscan.pieces(whole, 1, 1 << 20):
            members, bounds = sets(*shingle_hashes(batch.column(1), width))
            n = np.diff(bounds)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan.mix(members + np.uint64(s)))]) for s in (1, 2)]
                f1, f2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
            rows = iter(signatures(members, bounds))
            symbols = [next(rows).tobytes() if x else None for x in n.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(f1), pa.array(f2), pa.array(symbols, pa.binary())], names=["doc_id", "h", "n", "f1", "f2", "symbols"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class (rep, n, symbols), a row for each key: 48 bits of symbols under the number of the chunk and the place left out."""
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            batch = whole.slice(i, 4096)
            s = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.int64)
            out = np.empty((len(s), CHUNKS, WIDTH), np.int64)
            for place in range(WIDTH):
                rest = [x for x in range(WIDTH) if x != place]
                label = np.arange(CHUNKS)[None, :] * WIDTH + place
                out[:, :, place] = (label << 48) | (s[:, :, rest[0]] << 32) | (s[:, :, rest[1]] << 16) | s[:, :, rest[2]]
            times = CHUNKS * WIDTH
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), times)), pa.array(np.repeat(batch.column(1).to_numpy(), times))], names=["key", "rep", "n"])


def _members(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textscan.pieces(whole, 1, 1 << 20):
            members, bounds = sets(*shingle_hashes(batch.column(1), width))
            raw = [members[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["rep", "members"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, symbols of a, symbols of b) the pairs (a, b) within LIMIT."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
        near = (x != y).sum(axis=1) <= LIMIT
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = 100 * common >= percent * (len(both) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for x in batch.column(1):
            total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "count"])


def _rarest(held: DataFrame, percent: int) -> DataFrame:
    """held (rep, members, component) as (shingle, last, other, place, rep, n, component): of each set the rarest shingles, of which
    similar sets share one, each with the two before it."""
    sums = held.select("rep", "members").mapInArrow(_counts, "counter int, count bigint").groupBy("counter").agg(F.sum("count").alias("count"))
    with settings(held.sparkSession, batch=str(SETS)):
        sums = sums.toArrow()  # COUNTERS rows at most
    table = np.zeros(COUNTERS, np.int64)
    table[sums["counter"].to_numpy()] = sums["count"].to_numpy()
    shared = held.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                parts, last, other = [], [], []
                for x in batch.column(1):
                    h = np.frombuffer(x.as_buffer(), np.uint64)
                    order = np.lexsort((h, shared.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    rare = h[order[: len(h) - (percent * len(h) + 99) // 100 + 1]].view(np.int64)
                    parts.append(rare)
                    last.append(rare[[0, *range(len(rare) - 1)]])
                    other.append(rare[[0, 0, *range(len(rare) - 2)][: len(rare)]])
                times = [len(x) for x in parts]
                n = np.array([len(x.as_buffer()) // 8 for x in batch.column(1)], np.int64)
                columns = [np.concatenate(parts), np.concatenate(last), np.concatenate(other), np.concatenate([np.arange(t) for t in times]), *(np.repeat(c, times) for c in (batch.column(0).to_numpy(), n, batch.column(2).to_numpy()))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "last", "other", "place", "rep", "n", "component"])

    return held.select("rep", "members", "component").mapInArrow(rows, "shingle bigint, last bigint, other bigint, place bigint, rep bigint, n bigint, component bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) with n_shingles, component_id and kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct `width`-word shingles
    (of fewer words, the one sequence of all). component_id is the smallest doc_id reachable over links, kept says that it is
    the document's own. Null and blank texts have an empty set and no links. Rows with a null doc_id are kept, with no component;
    doc_ids are taken to be unique, and rows that share one share its component where it is the smallest of equal sets.
    An empty table gives no rows. Other columns pass through.
    """
    kept = others(docs, OUT)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("h"))
    signed = cut(hashed.mapInArrow(partial(_signed, width=width), "doc_id bigint, h bigint, n bigint, f1 bigint, f2 bigint, symbols binary"), batch=TEXTS)
    classes = cut(signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("symbols").alias("symbols")))
    found = classes.select("rep", F.col("rep").alias("component"))
    links = _links(texts, classes, width, percent)
    if links is not None:
        joined = components(links)
        found = classes.select("rep").join(joined, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    named = classes.select("n", "f1", "f2", F.col("rep").alias("r")).join(found, F.col("r") == F.col("rep")).select(F.col("n").alias("n2"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component")
    rows = signed.select("doc_id", "h", "n", "f1", "f2").join(named, (F.col("n") == F.col("n2")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    by = rows.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).dropDuplicates(["__id", "__h"])
    told = docs.select(*kept, F.xxhash64("text").alias("__of"))  # before the join, so that a text that isn't asked for isn't shuffled
    joined = told.join(by, (F.col("doc_id") == F.col("__id")) & (F.col("__of") == F.col("__h")), "left")
    return joined.select(*kept, "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(texts: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """All links (a, b) that the components of the classes need; None if no key is shared."""
    keyed = classes.select("rep", "n", "symbols").mapInArrow(_keys, "key bigint, rep bigint, n bigint")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select(F.col("key").alias("key2"), "size")
    at = cut(keyed.join(shared, F.col("key") == F.col("key2")).select("key", "rep", "n", "size"))
    need = cut(at.groupBy("rep").agg(F.sum("size").alias("degree")))
    n_need = need.count()
    if not n_need:
        return None
    wanted = need.select(F.col("rep").alias("id"))
    picked = texts.join(F.broadcast(wanted) if n_need <= PICKED else wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text")
    held = cut(picked.mapInArrow(partial(_members, width=width), "rep bigint, members binary"), batch=TEXTS)
    signs = cut(need.select(F.col("rep").alias("r")).join(classes.select("rep", "symbols"), F.col("r") == F.col("rep")).select("rep", "symbols"))
    ranked = cut(at.join(need.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("key", "rep", "n", "degree"))
    near = (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
    links = tested = None
    labels = None
    for star in range(STARS + 1):
        if labels is None:
            now = ranked.withColumn("component", F.col("rep"))
        else:
            now = ranked.join(labels.withColumnRenamed("node", "v"), F.col("rep") == F.col("v"), "left").select("key", "rep", "n", "degree", F.coalesce("component", "rep").alias("component"))
            # a key of two documents was done with its first star
            open_keys = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi and rows > 2").select(F.col("key").alias("k"))
            ranked = now = cut(now.join(open_keys, F.col("key") == F.col("k"), "left_semi"))
            ranked = ranked.drop("component")
        if star < STARS:
            turn = F.when(F.lit(star == 0), F.col("degree")).otherwise(F.abs(F.xxhash64("component", F.lit(star)) % 1_000_003))
            centres = now.groupBy("key").agg(F.max(F.struct(turn.alias("t"), F.col("degree"), (-F.col("rep")).alias("neg"), F.col("n").alias("m"), F.col("component").alias("c"))).alias("z")).select(F.col("key").alias("k"), (-F.col("z.neg")).alias("centre"), "z.m", "z.c")
            pairs = now.join(centres, F.col("key") == F.col("k")).where((F.col("component") != F.col("c")) & near).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        else:
            left = cut(now.select(F.col("rep").alias("r"), "component").distinct())
            left = F.broadcast(left) if left.count() <= PICKED else left
            left = cut(_rarest(held.join(left, F.col("rep") == F.col("r")).select("rep", "members", "component"), percent), batch=SETS)
            right = left.select(F.col("shingle").alias("k"), F.col("rep").alias("centre"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("component").alias("c"), F.col("last").alias("l2"), F.col("other").alias("o2"))
            # where one of the two shingles before is shared too, the pair comes from that one: the first shared is never left out
            later = (F.col("place") > 0) & (F.col("q") > 0) & (F.col("last").isin(F.col("l2"), F.col("o2")) | F.col("other").isin(F.col("l2"), F.col("o2")))
            enough = F.lit(100 + percent) * F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q")) >= F.lit(percent) * (F.col("n") + F.col("m"))
            pairs = left.join(right, (F.col("shingle") == F.col("k")) & (F.col("rep") < F.col("centre")) & (F.col("component") != F.col("c")) & near & enough & ~later).select(F.col("rep").alias("a"), F.col("centre").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.select(F.col("a").alias("a2"), F.col("b").alias("b2")), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left_anti")
        signed = (
            pairs.join(signs.select(F.col("rep").alias("ra"), F.col("symbols").alias("x")), F.col("a") == F.col("ra"))
            .join(signs.select(F.col("rep").alias("rb"), F.col("symbols").alias("y")), F.col("b") == F.col("rb"))
            .select("a", "b", "x", "y")
        )
        pairs = cut(signed.mapInArrow(_within, "a bigint, b bigint"))
        n_pairs = pairs.count()
        if not n_pairs:
            if star == STARS or now.isEmpty():
                break
            continue
        small = F.broadcast if n_pairs <= PICKED else (lambda rows: rows)
        one = held.join(small(pairs), F.col("rep") == F.col("b")).select("a", "b", F.col("members").alias("y"))
        other = held.join(small(pairs.select("a").distinct()), F.col("rep") == F.col("a")).select(F.col("rep").alias("ra"), F.col("members").alias("x"))
        both = one.join(other, F.col("a") == F.col("ra")).select("a", "b", "x", "y")
        new = cut(both.mapInArrow(partial(_linked, percent=percent), "a bigint, b bigint"), batch=SETS)
        links = new if links is None else cut(links.unionByName(new))
        if star == STARS:
            break
        tested = pairs if tested is None else cut(tested.unionByName(pairs))
        labels = cut(components(links))
    return links
