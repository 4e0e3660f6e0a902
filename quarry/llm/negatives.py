"""Hard negatives by branch and bound over ball trees.

Rows are dealt to partitions, each of which has one ball tree: a node's rows lie in a ball around its centre, so their inner
products with a query lie within radius times the query's length of the centre's. Nodes are met from the highest upper bound
down; a node is left out if its products can't reach into the score window from above or below, or are all strictly beneath
the current kth score.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import cut
from quarry.llm.vecdedup import sound_vector

#: Rows of a partition, anchors that meet it at once, and rows of a leaf.
PARTITION, ANCHORS, LEAF = 8192, 4096, 128
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


@dataclass
class Query:
    """Rows wanted: those that `fits` (a mask over the tree's rows), with scores from low to high (None: no bound), the best k."""

    fits: np.ndarray
    k: int
    low: int | None = None
    high: int | None = None
    found: list[tuple[int, int, int]] = field(default_factory=list)  # a heap of (score, -id, row): the worst is first

    def floor(self) -> float:
        """A score below which no row is taken any more."""
        low = -np.inf if self.low is None else float(self.low)
        return max(low, float(self.found[0][0])) if len(self.found) == self.k else low

    def takes(self, item: tuple[int, int, int]) -> bool:
        if (self.low is not None and item[0] < self.low) or (self.high is not None and item[0] > self.high) or not self.fits[item[2]]:
            return False
        return len(self.found) < self.k or item[:2] > self.found[0][:2]

    def take(self, item: tuple[int, int, int]) -> None:
        if len(self.found) < self.k:
            heapq.heappush(self.found, item)
        else:
            heapq.heapreplace(self.found, item)


class BallTree:
    """Integer vectors and their ids, halved along the axis from a far row to the one farthest from it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.floats = ids, rows, rows.astype(np.float64)
        self.most = float(np.abs(self.floats).max(initial=0))
        self.exact = self.most**2 * max(1, rows.shape[1]) < EXACT  # sums of integers below 2**53 are exact in doubles
        self.leaves: dict[int, np.ndarray] = {}
        self.children: dict[int, tuple[int, int]] = {}
        centres, radii = [], []
        stack = [(np.arange(len(ids)), -1, 0)] if len(ids) else []
        while stack:
            some, parent, side = stack.pop()
            node = len(centres)
            if parent >= 0:
                both = self.children.get(parent, (-1, -1))
                self.children[parent] = (node, both[1]) if side == 0 else (both[0], node)
            points = self.floats[some]
            centre = points.mean(axis=0)
            away = np.sqrt(((points - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(float(away.max()))
            if len(some) <= LEAF:
                self.leaves[node] = some
                continue
            one = points[away.argmax()]
            other = points[((points - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(points @ (other - one), kind="stable")  # by rank, so that equal rows are halved too
            half = len(some) // 2
            stack += [(some[order[:half]], node, 0), (some[order[half:]], node, 1)]
        self.centres = np.array(centres).reshape(len(centres), rows.shape[1])
        self.radii = np.array(radii)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product that each node's rows can have with q, a little wider than rounding."""
        length = float(np.sqrt((q * q).sum()))
        middle, reach = self.centres @ q, self.radii * length
        slack = 1e-9 * (length * np.sqrt((self.centres**2).sum(axis=1)) + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def search(self, q: np.ndarray, queries: list[Query]) -> int:
        """Fills each query's `found` with its best rows, ties to the smaller id; how many rows were scored."""
        if not len(self.ids):
            return 0
        point = q.astype(np.float64)
        exact = self.exact and float(np.abs(point).max(initial=0)) * self.most * len(q) < EXACT
        lower, upper = self.bounds(point)
        lower, upper = lower.tolist(), upper.tolist()
        heap, scored = [(-upper[0], 0)], 0

        def wants(query: Query, node: int) -> bool:
            if (query.low is not None and upper[node] < query.low) or (query.high is not None and lower[node] > query.high):
                return False
            return len(query.found) < query.k or upper[node] >= query.found[0][0]

        while heap:
            node = heapq.heappop(heap)[1]
            asking = [x for x in queries if wants(x, node)]
            if not asking:
                continue
            if node not in self.leaves:
                for child in self.children[node]:
                    if any(wants(x, child) for x in asking):
                        heapq.heappush(heap, (-upper[child], child))
                continue
            some = self.leaves[node]
            scored += len(some)
            scores = self.floats[some] @ point if exact else self.rows[some].astype(object) @ q.astype(object)
            near = scores if exact else scores.astype(np.float64)  # only to leave out, so a little beyond each end
            low, high = min(x.floor() for x in asking), max(np.inf if x.high is None else float(x.high) for x in asking)
            for i in np.flatnonzero((near >= low - abs(low) * 1e-9) & (near <= high + abs(high) * 1e-9)).tolist():
                item = (int(scores[i]), -int(self.ids[some[i]]), int(some[i]))
                for x in asking:
                    if x.takes(item):
                        x.take(item)
        return scored


def window(positive: int) -> tuple[int, int] | None:
    """The scores s with 30 * positive <= 100 * s <= 90 * positive, from and to; none if there can't be any."""
    low, high = -((-30 * positive) // 100), (90 * positive) // 100
    return (low, high) if low <= high else None


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    x = np.floor(256.0 * np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), d))
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2.0**62 else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


def _held(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def _trees(rows: pd.DataFrame, asks: pd.DataFrame):
    """For each length of vectors (tree, labels of its rows, anchors, their vectors)."""
    for d, part in asks.groupby("d"):
        there = rows[rows["d"] == d]
        if len(there):
            yield BallTree(there["vec_id"].to_numpy(np.int64), _matrix(there["v"], int(d))), there["label"].to_numpy(), part, _matrix(part["v"], int(d))


def _positives(asks: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for tree, labels, part, vectors in _trees(rows, asks):
        for q, anchor, h, label in zip(vectors, part["vec_id"], part["h"], part["label"], strict=True):
            want = Query((labels == label) & (tree.ids != anchor), k)
            tree.search(q, [want])
            out += [(anchor, h, -i, _held(s)) for s, i, _ in want.found]
    return pd.DataFrame(out, columns=["anchor_id", "h", "positive_id", "score"])


def _negatives(asks: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for tree, labels, part, vectors in _trees(rows, asks):
        for q, anchor, h, label, ids, scores in zip(vectors, part["vec_id"], part["h"], part["label"], part["ids"], part["scores"], strict=True):
            fits, wants = (labels != label) & (tree.ids != anchor), []
            for positive, score in dict.fromkeys(zip(map(int, ids), map(int, scores), strict=True)):
                if span := window(score):
                    wants.append((positive, score, Query(fits, k, *span)))
            tree.search(q, [w for _, _, w in wants])
            out += [(anchor, h, positive, score, -i, _held(s)) for positive, score, w in wants for s, i, _ in w.found]
    return pd.DataFrame(out, columns=["anchor_id", "h", "positive_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, embedding, label).

    Scores are inner products of floor(256 * x). For each anchor its `positives` best other rows of its label, and for each of these
    the `negatives` best rows of other labels whose score is 0.3 to 0.9 times the positive's; ties to the smaller vec_id. Rows of an
    anchor's own id are neither. Rows with a null id, label or vector, or null or non-finite components, take no part;
    vectors of different lengths are not compared. Repeated rows count each time as candidates (a repeated positive is one) and as one
    anchor. Scores beyond 64 bits are held to its ends. An empty table gives no rows; other columns are not read.

    Rows are dealt to partitions by hash, equal rows and labels too. Each group is one partition's tree and ANCHORS anchors at most;
    what is best in each meets again in a ranking per anchor. Candidates are shuffled twice for each ANCHORS anchors.
    """
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound_vector(F.col("embedding"))
    base = vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"), is_anchor.alias("asks"))
    base = cut(base.withColumn("d", F.size("v")).withColumn("h", F.xxhash64("v", "label")).withColumn("r", F.monotonically_increasing_id()))
    sizes = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    parts, asking = max(1, -(-sizes["n"] // PARTITION)), max(1, -(-sizes["q"] // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = base.select("vec_id", "label", "d", "v", F.pmod(F.xxhash64("vec_id", "h", "r"), F.lit(parts)).cast("int").alias("part")).withColumn("ask", every(asking))
    rows = rows.toDF(*rows.columns)  # columns of its own, as both sides of the groups come from one table
    asks = cut(base.where("asks").dropDuplicates(["vec_id", "h"]).select("vec_id", "h", "label", "d", "v", F.pmod(F.xxhash64("vec_id", "h"), F.lit(asking)).cast("int").alias("ask")))
    keys = ["ask", "part"]

    def met(anchors: DataFrame, f, k: int, schema: str) -> DataFrame:
        return cut(anchors.withColumn("part", every(parts)).groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda a, b: f(a, b, k), schema))

    found = met(asks, _positives, positives, "anchor_id bigint, h bigint, positive_id bigint, score bigint")
    best = Window.partitionBy("anchor_id", "h").orderBy(F.col("score").desc(), "positive_id")
    known = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).groupBy("anchor_id", "h")
    known = known.agg(F.collect_list("positive_id").alias("ids"), F.collect_list("score").alias("scores")).withColumnRenamed("h", "g")  # `positives` each
    asks = asks.join(known, (F.col("vec_id") == F.col("anchor_id")) & (F.col("h") == F.col("g"))).drop("anchor_id", "g")
    schema = "anchor_id bigint, h bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = met(asks, _negatives, negatives, schema)
    best = Window.partitionBy("anchor_id", "h", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
