"""The kept vector index against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import vector_index
from quarry.operators.search import cosine, nearest
from quarry.operators.vector_index import VectorIndex

ROWS = "id long, v array<float>"


def rows(n=600, d=18, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.standard_normal((12, d))
    v = centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, d))
    return [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark):
    data = rows()
    odd = [(10_000, None), (10_001, [0.0] * 18), (10_002, [float("nan")] * 18), (None, [1.0] * 18), (10_003, [1.0, 2.0]), (10_004, [None] + [1.0] * 17), (10_005, data[0][1])]
    df = spark.createDataFrame(data + odd, ROWS).withColumns({"cell": F.lit("x"), "KEY": F.lit(1), "code": F.lit(None)})
    return data, VectorIndex.build(df, "id", "v")


def asks(spark, data, step=20):
    return spark.createDataFrame([r for r in data if r[0] % step == 0], "query_id long, vector array<float>")


def brute(data, ids, k):
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return {i: [(-s, j) for s, j in sorted((-float(m[i] @ m[j]), data[j][0]) for j in range(len(data)))[:k]] for i in ids}


def test_every_row_is_indexed_once(built):
    data, index = built
    assert sorted(r["key"] for r in index.lists().select("key").collect()) == sorted([i for i, _ in data] + [10_005])


def test_recall_and_exhaustive_search(spark, built):
    data, index = built
    queries = asks(spark, data)
    assert index.shape.recall >= 0.95 and index.recall(queries) >= 0.9
    assert index.shape.probes < len(index.quantisers.centres)  # these vectors have cells, so not all are read
    got = index.search(queries, 7, probes=len(index.quantisers.centres), rerank=len(data) + 1).orderBy("query_id", "rank").collect()
    want = brute([*data, (10_005, data[0][1])], [i for i, _ in data if i % 20 == 0], 7)
    for q, best in want.items():
        mine = [(r["score"], r["key"]) for r in got if r["query_id"] == q]
        assert [k for _, k in mine] == [k for _, k in best] and np.allclose([s for s, _ in mine], [s for s, _ in best])
    exact = index.exact(queries, 7).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["key"]) for r in exact] == [(r["query_id"], r["rank"], r["key"]) for r in got]


def test_exact_way_agrees(spark, built):
    data, index = built
    df = spark.createDataFrame(data, ROWS)
    one = spark.createDataFrame([(40, data[40][1])], "query_id long, vector array<float>")
    want = [r["id"] for r in nearest(df, cosine(F.col("v"), data[40][1]), "id", 5).orderBy(F.col("score").desc(), "id").collect()]
    assert [r["key"] for r in index.search(one, 5, probes=99, rerank=9999).orderBy("rank").collect()] == want


def test_reopened_and_grown(spark, built):
    data, index = built
    again = VectorIndex.open(spark, index.folder)
    assert again.shape == index.shape
    queries = asks(spark, data, 100)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(again.search(queries)) == key(index.search(queries))
    more = spark.createDataFrame([(20_000 + i, v) for i, v in data if i % 100 == 0] + [(30_000, None)], ROWS)
    grown = VectorIndex.build(spark.createDataFrame(data, ROWS), "id", "v", cells=5)
    grown.add(more, "id", "v")
    best = grown.search(queries, 2).collect()
    assert {(r["query_id"], r["key"]) for r in best} >= {(i, 20_000 + i) for i, _ in data if i % 100 == 0}


def test_search_reads_probed_lists_and_few_vectors(spark, built, monkeypatch):
    data, index = built
    monkeypatch.setattr(vector_index, "BLOCK", 16)  # many blocks a list
    one = spark.createDataFrame([(40, data[40][1])], "query_id long, vector array<float>")
    found = index.search(one, 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell") or "PartitionFilters: [isnotnull(cell" in plan
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert any("vector" not in line.split("ReadSchema")[1] and "code" in line for line in scans)
    cells = {int(c) for c in index.quantisers.probe(np.array([data[40][1]]) / np.linalg.norm(data[40][1]), 2)[0]}
    inside = {r["key"] for r in index.lists().where(F.col("cell").isin(list(cells))).collect()}
    assert {r["key"] for r in found.collect()} <= inside


def test_odd_queries_and_empty_tables(spark, built):
    data, index = built
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (None, data[0][1]), (3, [0.0] * 18), (4, data[4][1]), (4, data[4][1])], "query_id long, vector array<float>")
    assert [(r["query_id"], r["rank"]) for r in index.search(odd, 2).orderBy("rank").collect()] == [(4, 1), (4, 2)]
    assert index.search(odd.where("false")).count() == 0 and index.recall(odd.where("false")) == 1.0
    none = VectorIndex.build(spark.createDataFrame([(1, None)], ROWS), "id", "v")
    assert none.search(odd).count() == 0 and VectorIndex.open(spark, none.folder).lists().count() == 0
    same = VectorIndex.build(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(50)], ROWS), "id", "v")
    assert [r["key"] for r in same.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, vector array<float>"), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_codes_stand_for_vectors():
    rng = np.random.Generator(np.random.PCG64(0))
    points = rng.standard_normal((500, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = vector_index.kmeans(points, 10, 1)
    rest = points - centres[vector_index.closest(points, centres)]
    q = vector_index.Quantisers(centres, [vector_index.kmeans(rest[:, a:b], 256, j) for j, (a, b) in enumerate(vector_index.bounds(32))])
    cells, codes = q.assign(points)
    made = centres[cells] + np.concatenate([book[codes[:, j]] for j, book in enumerate(q.books)], axis=1)
    assert ((made - points) ** 2).sum(axis=1).mean() < 0.05
    near = (points[:5] @ centres[cells].T) + sum(q.tables(points[:5])[:, j, :][:, codes[:, j]] for j in range(codes.shape[1]))
    assert np.allclose(near, points[:5] @ made.T, atol=1e-4)
    assert json.loads(json.dumps(centres.tolist()))


def test_searches_by_an_index(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry.operators.embed import HashEmbedder
    from quarry.operators.search import SearchQuery, index_key, indexed_search, search
    from quarry.operators.store import Store
    from quarry.plans import services

    data = rows(400, 8, seed=5)
    vectors = spark.createDataFrame([(f"e{i}", f"r{i}", "m" if i % 2 else "other", v) for i, v in data], "id string, code_record_id string, embedding_model string, embedding_vector array<float>")
    columns = "id string, repository_name string, branch string, commit_sha string, file_path string, line_start int, line_end int, symbol_name string, record_type string, summary string, code_snippet string, is_stale boolean"
    records = spark.createDataFrame([(f"r{i}", f"repo{i % 3}", "main", "c", f"{i}.cs", 1, 1, "s", "file_summary", "x", "code", i % 10 == 0) for i, _ in data], columns)
    index = VectorIndex.build(vectors.where("embedding_model = 'm'").select(index_key(F.col("id")).alias("key"), "embedding_vector"), "key", "embedding_vector", recall=1.0)
    show = lambda df: [(r["file_path"], round(r["score"], 9)) for r in df.collect()]
    for q in (SearchQuery(data[7][1], "m", k=5), SearchQuery(data[8][1], "m", ["repo1"], k=4), SearchQuery(data[9][1], "m", ["repo2"], "main", ["file_summary"], k=3, min_score=0.9), SearchQuery(data[3][1], "m", ["none"], k=3), SearchQuery(data[3][1], "m", k=300)):
        assert show(indexed_search(records, vectors, index, q)) == show(search(records, vectors, q))
    text = indexed_search(records, vectors, index, SearchQuery(data[7][1], "m", k=5))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in text.split("InMemoryRelation")[0]  # no vector is scored but those of the index
    # kept in a store, and opened again
    store, e, tree = Store(spark, str(tmp_path / "store")), HashEmbedder(), tmp_path / "tree"
    tree.mkdir()
    for i in range(6):
        (tree / f"A{i}.cs").write_text(f"namespace N; class Klass{i} {{ void Method{i}() {{ }} void Other{i}() {{ }} }}")
    services.scan(store, services.Repository(str(tree), "tree", "main", "abc"), e)
    assert services.store_index(store, e.model) is None
    built = services.build_index(store, e.model, recall=1.0)
    opened = services.store_index(store, e.model)
    assert opened.folder == built.folder and opened.lists().count() == store.table("code_embedding").count()
    by = services.ask(store, "class Klass3", e, SearchQuery((), k=4), opened).collect()
    assert [(h["symbol_name"], round(h["score"], 9)) for h in by] == [(h["symbol_name"], round(h["score"], 9)) for h in services.ask(store, "class Klass3", e, SearchQuery((), k=4)).collect()]


def test_queries_of_a_cell_meet_its_codes_in_slices(built, spark, monkeypatch):
    """A group's queries, each of which passes on as many rows as are reranked, don't grow with all of them, and the result is the same."""
    data, index = built
    queries, scored = asks(spark, data, 2), vector_index._scored

    def found():
        return sorted(map(tuple, index.search(queries, 5, probes=len(index.quantisers.centres), rerank=20).collect()))

    def watched(shared, rerank):
        inner = scored(shared, rerank)

        def checked(some, codes):
            assert len(some) <= 80
            return inner(some, codes)

        return checked

    whole = found()
    monkeypatch.setattr(vector_index, "_scored", watched)
    monkeypatch.setattr(vector_index, "TOGETHER", 40, raising=False)
    assert found() == whole and len(whole) == 5 * 300
