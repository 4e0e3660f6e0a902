"""Near-duplicate vectors and hard negatives against brute force, and on odd rows."""

import os
from math import comb, erf, sqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives, queries, vecdedup

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def clustered(n, d, seed, labels=3):
    """Rows around few centres at all distances, with copies, ties, and everything that takes no part."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.standard_normal((6, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.13, 0.16, 1.0])
        rows.append((i, (v * rng.choice([1.0, 3.0, 1e-3])).astype(np.float32).tolist(), int(rng.integers(labels))))
    rows += [rows[5], rows[5], (n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [NAN] * d, 1), (n + 3, [INF] + [1.0] * (d - 1), 1), (n + 4, [None] + [1.0] * (d - 1), 1)]
    return [*rows, (n + 5, rows[7][1], None), (None, rows[8][1], 1), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1)]


def sound(r):
    return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])


def brute_links(rows, cosine):
    fit = [r for r in rows if sound(r) and any(r[1])]
    links, near = [0] * len(fit), [[] for _ in fit]
    for a, x in enumerate(fit):
        for b, y in enumerate(fit):
            if a != b and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / sqrt((u @ u) * (v @ v)) >= cosine:
                    links[a] += 1
                    near[a].append(b)
    out = []
    for a, x in enumerate(fit):
        seen, todo = {a}, [a]
        while todo:
            new = [y for y in near[todo.pop()] if y not in seen]
            seen.update(new)
            todo += new
        least = min(fit[y][0] for y in seen)
        out.append((x[0], links[a], least, least == x[0]))
    return out + [(r[0], 0, r[0], r[0] is not None) for r in rows if not (sound(r) and any(r[1]))]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vecdedup, "BLOCK", block)
    rows = clustered(240, 12, 2)
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"N_links": F.lit("x"), "kept": F.lit(1), "cell": F.lit("mine"), "v": F.lit(2)})
    got = vecdedup.near_vectors(docs).collect()
    assert set(got[0].asDict()) == {"vec_id", "label", "cell", "v", "n_links", "component_id", "kept"}
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted(brute_links(rows, 0.98), key=key)
    assert sum(r.n_links for r in got) > 200


def test_near_vectors_empty(spark):
    assert vecdedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in vecdedup.near_vectors(spark.createDataFrame([(1, None, None)], VECTORS)).select("vec_id", "n_links", "component_id", "kept").collect()] == [(1, 0, 1, True)]


def test_calibrated_count():
    t, p = vecdedup.calibrated(), erf(vecdedup.WINDOW / sqrt(2))
    tail = lambda t: sum(comb(vecdedup.LINES, i) * p**i * (1 - p) ** (vecdedup.LINES - i) for i in range(t))
    assert tail(t) <= vecdedup.MISS < tail(t + 1)
    rng = np.random.Generator(np.random.PCG64(0))
    u = vecdedup.unit(rng.standard_normal((4000, 64)))
    turn = rng.standard_normal((4000, 64))
    turn = vecdedup.unit(turn - (turn * u).sum(axis=1, keepdims=True) * u)
    v = 0.98 * u + sqrt(1 - 0.98**2) * turn  # all pairs exactly at the threshold
    lines = vecdedup.directions(64)
    met = (np.abs(u @ lines.T - v @ lines.T) <= vecdedup.WINDOW * vecdedup.distance(0.98)).sum(axis=1)
    assert (met >= t).all() and abs(met.mean() - vecdedup.LINES * p) < 1
    apart = (np.abs(u[:2000] @ lines.T - u[2000:] @ lines.T) <= vecdedup.WINDOW * vecdedup.distance(0.98)).sum(axis=1)
    assert (apart >= t).mean() < 0.01  # others are kept from verification


def test_collisions_are_those_of_all_pairs():
    rng = np.random.Generator(np.random.PCG64(1))
    a, b = rng.standard_normal((90, 8)), rng.standard_normal((40, 8))
    b[3] = a[4]
    first = rng.integers(0, 50, 40)
    for q, near in vecdedup.collisions(a, b, 0.7, 5, first):
        counts = (np.abs(a - b[q]) <= 0.7).sum(axis=1)
        assert near.tolist() == [i for i in range(90) if counts[i] >= 5 and i >= first[q]]


def brute_negatives(rows, positives, wanted):
    fit = [(r[0], np.floor(256 * np.array(r[1], float)), r[2]) for r in rows if sound(r)]
    out, done = [], set()
    for i, v, label in fit:
        if i % 100 or (i, tuple(v), label) in done:
            continue
        done.add((i, tuple(v), label))
        others = sorted((-int(v @ w), j, m) for j, w, m in fit if j != i and len(w) == len(v))
        for s, j in dict.fromkeys([(-s, j) for s, j, m in others if m == label][:positives]):
            some = [(-t, n) for t, n, m in others if m != label and 30 * s <= -100 * t <= 90 * s][:wanted]
            out += [(i, j, k + 1, n, s, t) for k, (t, n) in enumerate(some)]
    return out


@pytest.mark.parametrize("partition", [8192, 50])
def test_negatives_equal_brute_force(spark, monkeypatch, partition):
    monkeypatch.setattr(negatives, "PARTITION", partition)
    monkeypatch.setattr(negatives, "ANCHORS", 2 if partition == 50 else 4096)
    rows = clustered(420, 6, 4) + clustered(40, 6, 4)[:3] * 2
    docs = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit("x"), "score": F.lit(1), "part": F.lit(None)})
    got = [tuple(r) for r in negatives.hard_negatives(docs, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(brute_negatives(rows, 5, 10)) and len(got) > 20
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_window_of_scores():
    for s in range(-40, 400):
        fit = [x for x in range(-50, 400) if 30 * s <= 100 * x <= 90 * s]
        assert negatives.window(s) == ((fit[0], fit[-1]) if fit else None)


def test_trees_bound_and_prune(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 32)
    rng = np.random.Generator(np.random.PCG64(6))
    rows = (rng.standard_normal((30, 5))[rng.integers(0, 30, 3000)] * 400 + rng.standard_normal((3000, 5)) * 9).astype(np.int64)
    tree = negatives.BallTree(np.arange(3000), rows)
    assert sum(map(len, tree.leaves.values())) == 3000 and len(tree.children) == len(tree.leaves) - 1
    scored = 0
    for q in rows[:60]:
        low, high = tree.bounds(q.astype(float))
        for leaf, some in tree.leaves.items():
            scores = rows[some] @ q
            assert low[leaf] <= scores.min() and scores.max() <= high[leaf]
        scores, top = rows @ q, int((rows @ q).max())
        want = negatives.Query(np.ones(3000, bool), 10, top // 3, top // 2)
        scored += tree.search(q, [want])
        assert sorted((-s, -i) for s, i, _ in want.found) == sorted((-int(s), i) for i, s in enumerate(scores) if top // 3 <= s <= top // 2)[:10]
    assert scored < 0.5 * 60 * 3000  # windows and kth scores leave out most rows


def test_large_numbers(spark):
    rows = [(0, [1e30, 1.0], 1), (100, [2e30, 0.0], 1), (3, [1e30, 5.0], 2), (5, [3e-3, 1e-30], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0).collect()
    assert all(r.positive_score == (1 << 63) - 1 for r in got)
    assert vecdedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("vec_id = 0").first().n_links == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["op12_near_vectors", "op13_hard_negatives", "op10_topk"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
