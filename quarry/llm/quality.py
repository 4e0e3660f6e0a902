"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import others

#: Weights; n-grams are hashed to them. A model has this many, however large the corpus.
BUCKETS = 1 << 20
#: Labelled rows that training reads at most: those with the smallest hash of their id.
SAMPLE = 6000
#: How far back a word's repetition is looked for.
AGAIN = 8
#: A text's n-grams weigh this in all.
SCALE = 10.0

OUT = ("score", "predicted")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' n-grams, and n + 1 bounds. These are all words (marks are words of their own), all pairs of words, and
    for a word that stands up to AGAIN words before too, the gram that says how far, whatever the word."""
    hashes, bounds = textscan.words(*textscan.text_bytes(column), marks=True)
    if len(hashes) == 0:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    n = len(hashes)
    grams, keep = np.zeros((n, 3), np.uint64), np.ones((n, 3), bool)  # a word, its pair with the next one, its repetition
    grams[:, 0] = hashes
    grams[:-1, 1] = textscan.pairs(hashes)
    keep[bounds[1:][np.diff(bounds) > 0] - 1, 1] = False  # a text's last word has no next one
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for lag in range(AGAIN, 0, -1):
        again = np.flatnonzero((hashes[lag:] == hashes[:-lag]) & (text[lag:] == text[:-lag])) + lag
        grams[again, 2] = textscan.mix(np.array([lag], np.uint64))[0]
    keep[:, 2] = grams[:, 2] > 0
    counts = np.concatenate([[0], np.cumsum(keep.ravel())])
    return (grams[keep] & np.uint64(BUCKETS - 1)).astype(np.int64), counts[3 * bounds]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Sparse dot products through the logistic function: SCALE times the n-grams' shares of the text. Empty: the bias alone."""
        buckets, bounds = features(column)
        run = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        z = SCALE * (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(np.diff(bounds), 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], alpha: float = 10.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, epochs: int = 4) -> Model:
    """examples: (label, distinct buckets, values). One FTRL-proximal update for each in turn; without examples every score is 0.5."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the bias, with value 1

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(examples)):
            label, buckets, values = examples[k]
            i, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            old_z, old_n = z[i], n[i]
            w = weights(old_z, old_n)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0)))
            g = (p - label) * x
            new_n = old_n + g * g
            z[i] = old_z + g - (np.sqrt(new_n) - np.sqrt(old_n)) / alpha * w
            n[i] = new_n
    bias = float(weights(z[-1:], n[-1:])[0])
    return Model(weights(z[:-1], n[:-1]).astype(np.float32), bias)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textscan.pieces(whole, 2):
            buckets, bounds = features(batch.column(2))
            idx, val = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                i, c = np.unique(buckets[a:b], return_counts=True)
                idx.append(i.astype("<i4").tobytes())
                val.append((SCALE * c / max(b - a, 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["doc_id", "label", "idx", "val"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, target 0 or 1) where `learn`, a condition on doc_id, holds.

    At most `sample` labelled rows are read; the sample is the same in every run. Labels other than 0 and 1, null ids
    and ids without a document are left out; of several labels of an id all count.
    """
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__id"))  # at most `sample` pairs of numbers
    table = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(_examples, "doc_id bigint, label int, idx binary, val binary").toArrow()
    order = table.select(["doc_id", "label"]).append_column("row", pa.array(range(table.num_rows), pa.int64())).sort_by([("doc_id", "ascending"), ("label", "ascending"), ("row", "ascending")])
    parts = list(zip(*([x.as_buffer() for chunk in table[c].chunks for x in chunk] for c in ("idx", "val")), strict=True))  # views into the table
    return train([(y, np.frombuffer(parts[r][0], "<i4"), np.frombuffer(parts[r][1], "<f4")) for y, r in zip(order["label"].to_pylist(), order["row"].to_pylist(), strict=True)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with score, the chance of label 1, and predicted, 1 if that is at least 0.5.

    Whole texts are read. Null and empty texts get the model's bias. Rows stay where they are; other columns pass through.
    """
    rows = docs.select(*others(docs, OUT))
    at = rows.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # BUCKETS floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in textscan.pieces(whole, at):
                s = own.scores(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, *OUT])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(scored, f"{names}, score double, predicted int")


def held_out() -> Column:
    """Rows that are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
