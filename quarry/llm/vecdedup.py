"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors are laid on many random lines. On each line a pair collides if the one lies in a window around the other. Two vectors at
the largest distance that links collide on a line with a known probability, so their collisions have a known binomial
distribution; the count that a pair has to reach is its quantile, so that a linked pair misses it with a probability of MISS
at most. Pairs that reach it are verified by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, others, small_side
from quarry.llm.components import components

#: Lines; half a window, in standard deviations of a linked pair's difference on a line; the share of linked pairs that may be missed.
LINES, WINDOW, MISS = 32, 1.5, 1e-7
#: Different vectors of a block. A task holds two blocks.
BLOCK = 2048
FOUND = ("n_links", "component_id", "kept")


def calibrated(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count of collisions that a pair at the largest linked distance reaches but for a probability of `miss`."""
    p = erf(window / sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > miss:
            return count
    return lines


def distance(cosine: float) -> float:
    """How far apart unit vectors of this cosine are."""
    return sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9


def directions(d: int) -> np.ndarray:
    """LINES random lines in d dimensions (LINES, d), always the same."""
    return np.random.Generator(np.random.PCG64([17, d])).standard_normal((LINES, d))


def collisions(rows: np.ndarray, asks: np.ndarray, half: float, least: int, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each vector of `asks` the `rows` that collide with it on `least` lines or more. Both are projections (vectors, LINES);
    of the rows, those before first[query] are left out. Each line has its rows sorted, so a window is a stretch of them."""
    n, lines = rows.shape
    order = np.argsort(rows, axis=0, kind="stable").T.copy()
    low, high = np.empty((lines, len(asks)), np.int64), np.empty((lines, len(asks)), np.int64)
    for j in range(lines):
        line = rows[order[j], j]
        low[j], high[j] = np.searchsorted(line, asks[:, j] - half, "left"), np.searchsorted(line, asks[:, j] + half, "right")
    for q in range(len(asks)):
        met = np.concatenate([order[j, a:b] for j, (a, b) in enumerate(zip(low[:, q].tolist(), high[:, q].tolist(), strict=True))])
        counts = np.bincount(met, minlength=n)
        counts[: first[q]] = 0
        yield q, np.flatnonzero(counts >= least)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square is beyond a double."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit vector of b (q, rows of a linked with it); if both are the same block, each pair once."""
    lines = directions(a.shape[1])
    half = WINDOW * distance(cosine)
    first = np.arange(1, len(b) + 1) if same else np.zeros(len(b), np.int64)
    for q, near in collisions(a @ lines.T, b @ lines.T, half, calibrated(), first):
        near = near[a[near] @ b[q] >= cosine]
        if len(near):
            yield q, near


def _cell(part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one pair of blocks: (node, links, null) with its links in it, and (a, null, b), a forest of its links."""
    left, right = part[part["side"] == 0], part[part["side"] == 1]
    same = not part["apart"].iloc[0] and part["i"].iloc[0] == part["j"].iloc[0]
    if len(left) == 0 or (len(right) == 0 and not same):
        return pd.DataFrame({c: pd.array([], "Int64") for c in ("node", "links", "other")})
    if same:
        right = left
    a = unit(np.array([np.asarray(v, np.float64) for v in left["v"]]))
    b = a if same else unit(np.array([np.asarray(v, np.float64) for v in right["v"]]))
    a_node, b_node = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
    a_weight, b_weight = left["weight"].to_numpy(np.int64), right["weight"].to_numpy(np.int64)
    a_links, b_links = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    group = np.arange(len(a) + (0 if same else len(b)))  # of a's vectors, then of b's
    nodes = a_node if same else np.concatenate([a_node, b_node])
    edges = []
    for q, near in linked(a, b, same, cosine):
        b_links[q] += a_weight[near].sum()
        a_links[near] += b_weight[q]
        mine = q if same else len(a) + q
        joined = np.unique(group[np.append(near, mine)])
        if len(joined) > 1:
            edges += [(int(nodes[joined[0]]), int(nodes[g])) for g in joined[1:]]
            group[np.isin(group, joined)] = joined[0]
    if same:
        counts = list(zip(a_node.tolist(), (a_links + b_links).tolist(), strict=True))
    else:
        counts = [*zip(a_node.tolist(), a_links.tolist(), strict=True), *zip(b_node.tolist(), b_links.tolist(), strict=True)]
    out = [(x, n, None) for x, n in counts if n] + [(x, None, y) for x, y in edges]
    return pd.DataFrame({"node": pd.array([x[0] for x in out], "Int64"), "links": pd.array([x[1] for x in out], "Int64"), "other": pd.array([x[2] for x in out], "Int64")})


def sound_vector(v: Column) -> Column:
    """Not null, and all components finite numbers."""
    x_ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, x_ok), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vectors (vec_id, embedding, label, more columns) without embedding, with n_links (other rows of the same label and a cosine
    of `cosine` or more, in doubles), component_id (the smallest vec_id reachable by links, its own if there are none) and kept
    (vec_id = component_id).

    Rows with a null label or vec_id, a null or zero vector, or null or non-finite components link with nothing; a null vec_id
    has a null component_id and isn't kept. Vectors of different lengths are not linked. Equal rows and equal vectors count
    as rows of their own, though they are compared as one. An empty table gives no rows; other columns pass through,
    but for those named like the results.

    Equal vectors of a label are made one. Those of a label are dealt by their place on one more line of unit length, in
    cells as wide as linked vectors can be apart, so that they lie in the same or in neighbouring cells; large cells are
    blocks. Each pair of blocks that can hold links is one group of 2 * BLOCK vectors at most, which counts collisions and gives
    back a count a vector and a forest of links, never the pairs. Vectors that are spread evenly in many dimensions
    share few cells, so that the pairs of blocks of a label grow with the square of its different vectors.
    """
    rows = vectors.select(*others(vectors, FOUND))
    own = rows.withColumn("__v", F.col("embedding").cast("array<double>"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound_vector(F.col("__v")) & F.exists("__v", lambda x: x != 0)
    own = own.withColumn("__label", F.when(fit, F.col("label"))).withColumn("__v", F.when(fit, F.col("__v")))
    classes = own.where("__label is not null").groupBy("__label", "__v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    largest = F.array_max(F.transform("v", F.abs))
    sign = lambda i: F.pmod(F.xxhash64(i), F.lit(2)) * 2 - 1
    lying = F.aggregate(F.transform("v", lambda x, i: x / largest * sign(i)), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(F.transform("v", lambda x: x / largest * (x / largest)), F.lit(0.0), lambda s, x: s + x))
    place = lying / (length * F.sqrt(F.size("v").cast("double")))
    classes = classes.select(F.col("__label").alias("label"), F.col("__v").alias("v"), "least", "weight", F.monotonically_increasing_id().alias("node"))
    classes = cut(classes.withColumn("d", F.size("v")).withColumn("cell", F.floor(place / distance(cosine))))
    placed = classes.select("node", "v", "weight", "label", "d", "cell")
    keys = ["label", "d", "cell"]
    sizes = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    after = sizes.select("label", "d", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next"))
    before = sizes.select("label", "d", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("last"))
    sizes = cut(sizes.join(after, keys, "left").join(before, keys, "left"))  # one row a cell
    names = [f"__{k}" for k in keys]
    sizes = small_side(sizes.toDF(*names, "blocks", "next", "last"), rows=1_000_000)
    placed = placed.join(sizes, [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]).drop(*names)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def upto(n: Column, meet) -> Column:
        """One element for each of the blocks 0 to n - 1, made by meet(block)."""
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), meet)).otherwise(F.array())

    me, cell = F.col("block"), F.col("cell")
    pair = lambda c, i, j, apart, side: F.struct(c.alias("cell"), i.alias("i"), j.alias("j"), F.lit(apart).alias("apart"), F.lit(side).alias("side"))
    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: pair(cell, F.least(me, j), F.greatest(me, j), False, 0).withField("side", F.when(j < me, 1).otherwise(0)))
    meets = F.concat(inside, upto(F.coalesce("next", F.lit(0)), lambda j: pair(cell, me, j, True, 0)), upto(F.coalesce("last", F.lit(0)), lambda i: pair(cell - 1, i, me, True, 1)))
    dealt = placed.withColumn("block", block).withColumn("at", F.explode(meets)).select("label", "d", "at.*", "node", "weight", "v")
    found = cut(dealt.groupBy("label", "d", "cell", "i", "j", "apart").applyInPandas(lambda part: _cell(part, cosine), "node bigint, links bigint, other bigint"))

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("n"))
    parts = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("__n"), "component")
    known = classes.join(links.withColumnRenamed("node", "__m"), F.col("node") == F.col("__m"), "left").join(parts, F.col("node") == F.col("__n"), "left")
    known = cut(known.select("label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("__links"), F.coalesce("component", "node").alias("part")))
    lowest = known.groupBy("part").agg(F.min("least").alias("__component")).withColumnRenamed("part", "__part")
    known = known.join(lowest, F.col("part") == F.col("__part")).select(F.col("label").alias("__l"), F.col("v").alias("__w"), "__links", "__component")
    out = own.join(known, (F.col("__label") == F.col("__l")) & (F.col("__v") == F.col("__w")), "left")
    component = F.coalesce("__component", F.col("vec_id"))
    out = out.withColumns({"n_links": F.coalesce("__links", F.lit(0)).cast("long"), "component_id": component, "kept": F.coalesce(F.col("vec_id") == component, F.lit(False))})
    return out.select(*[c for c in rows.columns if c != "embedding"], *FOUND)
