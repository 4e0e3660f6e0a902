"""Language-model scores by cross-entropy difference: a target and a background bigram model over one vocabulary.

A model gives p(w | h) = (c(h, w) + STRENGTH * p(w)) / (c(h) + STRENGTH) with p(w) = (c(w) + ADDED) / (N + ADDED * V), V
being the number of different words. A document's score is the mean over its words of the target's loss less the
background's, in nats: the lower, the more like the target. Counts come from every word of every document; when a
document is scored, its own are taken off first, so that no document is held against itself.

Words, contexts and pairs are counted under their full 64-bit hashes, in a shuffled table that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import cut, others

STRENGTH, ADDED = 8.0, 0.1
OUT = ("n_words", "target_loss", "background_loss", "lm_score")


#: Bytes of text whose n-grams are looked up at once, and bytes of text to one part of the table of counts.
CHUNK, PART = 8 << 20, 16 << 20
GRAMS = ("word", "context", "pair")


def grams(column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """64-bit hashes of all words of the texts, of the words before them (0 at a text's start) and of the pairs; and n + 1 bounds."""
    hashes, bounds = textscan.words(*textscan.text_bytes(column))
    before = np.zeros(len(hashes), np.uint64)
    before[1:] = hashes[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    with np.errstate(over="ignore"):
        pair = textscan.mix(before * np.uint64(0xD6E8FEB86659FD93) + hashes)
    return (hashes, before, pair), bounds


def losses(counts: list[np.ndarray], off: list[np.ndarray], words: np.ndarray, total: float, vocabulary: int) -> np.ndarray:
    """Losses from counts of words, contexts and pairs after `off` of each, and `words` of the total, are taken off."""
    word, context, pair = (np.maximum(c - o, 0) for c, o in zip(counts, off, strict=True))
    share = (word + ADDED) / (total - words + ADDED * vocabulary)
    return np.log(context + STRENGTH) - np.log(pair + STRENGTH * share)


def own_counts(bucket: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """How often each place's bucket, a number below `size`, occurs in its own text."""
    _, where, times = np.unique(text * np.int64(size) + bucket, return_inverse=True, return_counts=True)
    return times[where].astype(np.float64)


def _packed(*rows: np.ndarray) -> bytes:
    """Rows of 64-bit integers, of one length: byte by byte of their places, compressed."""
    flat = np.stack(rows).view(np.uint8).reshape(len(rows), -1, 8).transpose(0, 2, 1).tobytes()
    return len(rows[0]).to_bytes(8, "little") + (pa.compress(flat, codec="zstd", asbytes=True) if flat else b"")


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if n == 0:
        return np.zeros((rows, 0), np.int64)
    flat = np.frombuffer(pa.decompress(data[8:], 8 * n * rows, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(rows, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(rows, n)


def _chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in chunks of about CHUNK bytes of text: (chunk, bytes of text, the rows as a compressed Arrow stream)."""
    first, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def chunk() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in held:
                out.write_batch(b)
        values = [pa.array([first + number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=["chunk", "size", "rows"])

    for whole in batches:
        for batch in textscan.pieces(whole, at, CHUNK):
            more = int(textscan.text_bytes(batch.column(at))[1][-1])
            if held and size + more > CHUNK:
                yield chunk()
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += more
    if held:
        yield chunk()


def _rows(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all().combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    found = table.column(i)
    return found.chunk(0) if found.num_chunks else pa.array([], found.type)


def _limits(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of hashes begins in the sorted keys, and their number."""
    lows = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, lows), len(keys))


def _asked(batches: Iterator[pa.RecordBatch], parts: int, at: int, mark: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and part of the table one row: the chunk's different n-grams there, and how often they occur in it."""
    for batch in batches:
        for chunk, stream in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = _rows(stream.as_buffer())
            found, bounds = grams(_column(rows, at))
            mine = np.repeat(np.asarray(_column(rows, mark)), np.diff(bounds))
            values = []
            for f in found:
                keys, where = np.unique(f, return_inverse=True)
                every, target = np.bincount(where, minlength=len(keys)), np.bincount(where[mine], minlength=len(keys))
                ends = _limits(keys, parts)
                steps = [np.diff(keys[a:b], prepend=np.uint64(0)).view(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                values.append(pa.array([_packed(s, target[a:b], every[a:b]) for s, a, b in zip(steps, ends[:-1], ends[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([chunk] * parts, pa.int64()), *values], names=["part", "chunk", *GRAMS])


def _answered(asked: pa.Table) -> pa.Table:
    """One part of the table of counts: for each chunk the sums over all chunks of the n-grams that it asked for, in its order."""
    out, scalars = {"chunk": asked["chunk"], "part": asked["part"]}, {}
    for name in GRAMS:
        found = [_unpacked(x.as_py(), 3) for x in asked[name]]
        with np.errstate(over="ignore"):
            keys = np.concatenate([np.cumsum(f[0].view(np.uint64), dtype=np.uint64) for f in found])
        known, where = np.unique(keys, return_inverse=True)
        sums = [np.bincount(where, np.concatenate([f[i] for f in found]), len(known)).astype(np.int64) for i in (1, 2)]
        ends = np.concatenate([[0], np.cumsum([f.shape[1] for f in found])])
        out[name] = pa.array([_packed(*(s[where[a:b]] for s in sums)) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        if name == "word":
            scalars = {"vocabulary": len(known), "target": int(sums[0].sum()), "background": int(sums[1].sum())}
    return pa.table(out | {k: pa.array([v] * asked.num_rows, pa.int64()) for k, v in scalars.items()})


def _scored(chunk: pa.Table, answers: pa.Table, at: int, mark: int) -> pa.Table:
    """A chunk's rows with their scores, from its n-grams' counts and the sums over all parts, which each part's answer brings."""
    rows, answers = _rows(chunk["rows"][0].as_py()), answers.sort_by("part")
    found, bounds = grams(_column(rows, at))
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    mine, size = np.asarray(_column(rows, mark))[text], n[text]
    sums, off = [], []
    for name, f in zip(GRAMS, found, strict=True):
        keys, where = np.unique(f, return_inverse=True)
        sums.append(np.concatenate([_unpacked(x.as_py(), 2) for x in answers[name]], axis=1)[:, where])
        off.append(own_counts(where, text, max(1, len(keys))))
    vocabulary, means = sum(answers["vocabulary"].to_pylist()), []
    for i, (name, part) in enumerate([("target", mine), ("background", np.True_)]):
        each = losses([s[i] for s in sums], [o * part for o in off], size * part, sum(answers[name].to_pylist()), vocabulary)
        run = np.concatenate([[0.0], np.cumsum(each)])
        means.append((run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(n, 1))
    values = [pa.array(v, mask=n == 0) for v in (*means, means[0] - means[1])]
    rest = [i for i in range(rows.num_columns) if i not in (at, mark)]
    return pa.table([*(rows.column(i) for i in rest), pa.array(n), *values], names=[*(rows.schema.names[i] for i in rest), *OUT])


def scores(docs: DataFrame, is_target: Column) -> DataFrame:
    """docs (text, ...) without text, with n_words, the mean losses of the target model (of docs where is_target holds) and
    the background model (of all docs), and lm_score, their difference.

    Null and blank texts have no words and null losses. Other columns pass through. Every word and pair has counts of its
    own. Documents are gathered to chunks, and a chunk asks each part of the shuffled table of counts once for all its
    different n-grams, so an n-gram that every document has costs one entry a chunk. The number of parts follows the size
    of the texts, and so does all that is shuffled; nothing is collected or broadcast.
    """
    kept = others(docs, OUT)
    rows = docs.select(*kept, F.coalesce(is_target, F.lit(False)).alias("__target"))
    at, mark = kept.index("text"), len(kept)
    chunks = cut(rows.mapInArrow(partial(_chunks, at=at), "chunk bigint, size bigint, rows binary"))
    parts = max(1, -(-(chunks.agg(F.sum("size")).first()[0] or 0) // PART))
    binaries = ", ".join(f"{g} binary" for g in GRAMS)
    asked = chunks.select("chunk", "rows").mapInArrow(partial(_asked, parts=parts, at=at, mark=mark), f"part int, chunk bigint, {binaries}")
    answers = asked.groupBy("part").applyInArrow(_answered, f"chunk bigint, part int, {binaries}, vocabulary bigint, target bigint, background bigint")

    def scored(chunk: pa.Table, found: pa.Table) -> pa.Table:
        return _scored(chunk, found, at, mark)

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("text", "__target")]
    schema = ", ".join([*names, "n_words bigint, target_loss double, background_loss double, lm_score double"])
    return chunks.select("chunk", "rows").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema)
