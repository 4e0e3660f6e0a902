"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import cut

#: Rows of a block of candidates and of queries. A task holds one of each.
CANDIDATES, QUERIES = 8192, 8192
#: How deep a query's longest walk along a list goes at first, and what it is multiplied by; queries that walk together.
FIRST_DEPTH, DEEPER, AT_ONCE = 16, 4, 256
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

Best = tuple[np.ndarray, np.ndarray]  # ids and scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> Best:
    """The k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k and scores.dtype != object:
        fit = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[fit], scores[fit]
    top = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x])), np.int64)
    return ids[top[:k]], scores[top[:k]]


def threshold_topk(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[Best], np.ndarray]:
    """For each query the (ids, scores) of its k best rows, ties to the smaller id, rows of its own id left out; and how many
    rows were scored for it. `floors` has for each query a score that k other rows are known to reach: rows below it may be
    left out of the results.

    Each dimension has one sorted list, which a query reads from the end where it finds its largest products: the upper end
    where it is positive, the lower end where it is negative. It goes down all lists at once, in each as deep as its
    component is large against its largest one. No row still unseen can score above the sum of the products with the lists'
    next values, so the query is closed when that sum is below its kth score, or its floor (an equal sum keeps it open, for
    ties), or when one list is read to its end. Each round goes DEEPER times as deep.

    AT_ONCE queries walk together: in a round each marks the rows that it meets for the first time, what any of them has met is
    scored in one product, and each query takes the scores of its own rows. Only rows that a query has met are ever among its best.
    """
    n, d = rows.shape
    best: list[Best] = [(np.zeros(0, np.int64), np.zeros(0, object))] * len(queries)
    scored = np.zeros(len(queries), np.int64)
    if n == 0 or len(queries) == 0:
        return best, scored
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1)
    kind = np.float64 if most < EXACT else object  # sums of integers below 2**53 are exact in doubles
    rows, queries = rows.astype(kind), queries.astype(kind)
    low = np.full(len(queries), -np.inf, kind) if floors is None else np.asarray(floors).astype(kind)

    def take(q: int, some: np.ndarray, scores: np.ndarray) -> None:
        best[q] = _best(np.concatenate([best[q][0], ids[some]]), np.concatenate([best[q][1].astype(kind), scores]), k)
        if len(best[q][0]) >= k:
            low[q] = max(low[q], best[q][1][k - 1])

    order = np.argsort(rows, axis=0, kind="stable")
    lists, order = np.take_along_axis(rows, order, axis=0), np.ascontiguousarray(order.T)
    size = np.abs(queries).astype(np.float64)
    size[size.max(axis=1, initial=0) == 0] = 1.0  # a zero query meets all rows
    share = size / size.max(axis=1, initial=0, keepdims=True) if d else np.ones((len(queries), 0))
    upper = (queries > 0).astype(bool)

    def unseen(some: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of the lists' next values at these depths, for some queries."""
        place = np.where(upper[some], n - 1 - ends, ends).clip(0, n - 1)
        return (queries[some] * lists[place, np.arange(d)]).sum(axis=1)

    for first in range(0, len(queries), AT_ONCE):
        open_ = np.arange(first, min(first + AT_ONCE, len(queries)))
        seen, depth, high = np.zeros((len(open_), n), bool), np.zeros((len(open_), d), np.int64), FIRST_DEPTH
        open_ = open_[(unseen(open_, depth) >= low[open_]).astype(bool)]
        while len(open_):
            ends = np.minimum(np.ceil(high * share[open_]), n).astype(np.int64)
            mine = open_ - first
            new = np.zeros((len(open_), n), bool)
            if not d:
                new[:] = True
            for row, q, starts, stops in zip(new, open_.tolist(), depth[mine].tolist(), ends.tolist(), strict=True):
                for j, (a, b) in enumerate(zip(starts, stops, strict=True)):
                    if a < b:
                        row[order[j, n - b : n - a] if upper[q, j] else order[j, a:b]] = True
            new &= ~seen[mine]
            seen[mine] |= new
            scored[open_] += new.sum(axis=1)
            met = np.flatnonzero(new.any(axis=0))
            scores = queries[open_] @ rows[met].T
            fit = new[:, met] & (scores >= low[open_][:, None]).astype(bool) & (ids[met] != query_ids[open_][:, None])
            for q, f, s in zip(open_.tolist(), fit, scores, strict=True):
                some = np.flatnonzero(f)
                if len(some):
                    take(q, met[some], s[some])
            depth[mine] = ends
            high *= DEEPER
            open_ = open_[(unseen(open_, ends) >= low[open_]).astype(bool) & (ends.max(axis=1, initial=0 if d else n) < n)]
    return best, scored


def _matrix(vectors: pd.Series, d: int) -> np.ndarray:
    x = np.floor(64.0 * np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), d))
    return x.astype(np.int64) if np.abs(x).max(initial=0) < 2.0**62 else np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)


def _cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for d, part in queries.groupby("d"):
        there = rows[rows["d"] == d]
        floors = None
        if "floor" in part:
            floors = np.array([-np.inf if pd.isna(x) else int(x) for x in part["floor"]], object)
        found, _ = threshold_topk(there["vec_id"].to_numpy(np.int64), _matrix(there["v"], int(d)), part["vec_id"].to_numpy(np.int64), _matrix(part["v"], int(d)), k, floors)
        for q, h, (ids, scores) in zip(part["vec_id"], part["h"], found, strict=True):
            out += [(q, h, int(i), max(-LONG - 1, min(LONG, int(s)))) for i, s in zip(ids, scores, strict=True)]
    return pd.DataFrame(out, columns=["query_id", "h", "vec_id", "score"])


def _cell_function(k: int):
    def cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _cell(queries, rows, k)

    return cell


def topk(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) where is_query holds, the k rows of
    other ids with the largest inner products of floor(64 * x), ties to the smaller vec_id; all of them if fewer.

    Rows with a null id or vector, or a null or non-finite component, take no part; vectors of different lengths are
    not compared. Repeated rows count as candidates each time and as one query. Scores beyond 64 bits are held to
    its ends. An empty table gives no rows; other columns are not read.

    Candidates and queries are dealt to blocks by hash, equal rows too. Each block of queries first meets one block of
    candidates, its home; the kth score there is a floor under the query's kth score of all, with which it starts in all
    other blocks. Each pair of blocks is one group, whose exact best by the threshold algorithm meet again in a ranking per
    query. Candidates are shuffled once for each QUERIES queries.
    """
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    base = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    base = cut(base.withColumn("d", F.size("v")).withColumn("h", F.xxhash64("v")).withColumn("r", F.monotonically_increasing_id()))
    sizes = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asking = max(1, -(-sizes["n"] // CANDIDATES)), max(1, -(-sizes["q"] // QUERIES))
    rows = base.withColumn("cb", F.pmod(F.xxhash64("vec_id", "h", "r"), F.lit(blocks)).cast("int")).select("cb", "vec_id", "h", "d", "v")
    rows = rows.toDF(*rows.columns)  # columns of its own, as both sides of the groups come from one table
    asks = base.where("asks").dropDuplicates(["vec_id", "h"]).withColumn("qb", F.pmod(F.xxhash64("vec_id", "h", F.lit(1)), F.lit(asking)).cast("int")).select("qb", "vec_id", "h", "d", "v")
    schema = "query_id bigint, h bigint, vec_id bigint, score bigint"
    home = F.col("qb") % blocks
    found = cut(asks.withColumn("cb", home).groupBy("cb").cogroup(rows.where(F.col("cb") < asking).groupBy("cb")).applyInPandas(_cell_function(k), schema))
    w = Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id")
    if blocks > 1:
        kth = found.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).select(F.col("query_id").alias("q"), F.col("h").alias("g"), F.col("score").alias("floor"))
        known = asks.join(kth, (F.col("vec_id") == F.col("q")) & (F.col("h") == F.col("g")), "left").select("qb", "vec_id", "h", "d", "v", "floor")
        known = known.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("cb") != home)
        there = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asking - 1)))).where(F.col("cb") != home)
        keys = ["qb", "cb"]
        found = found.unionByName(known.groupBy(keys).cogroup(there.groupBy(keys)).applyInPandas(_cell_function(k), schema))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
