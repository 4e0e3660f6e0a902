"""A kept index of vectors for nearest neighbours by cosine: inverted lists of product-quantised codes, with an exact rerank.

A coarse quantiser (k-means, fitted on a bounded sample) has a centre for each cell. Every vector is in the list of its nearest
centre, with a code of SUBSPACES bytes for what the centre leaves of it. Lists are partitions of a Parquet table, so a
search reads the codes of the cells it probes and no others; the best by their codes are fetched and scored exactly.
An index is built once, can be opened again by its folder, and grows by `add`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.shared import broadcast_if_small, shared_folder, total

#: Vectors that the quantisers are fitted on at most, those with the smallest hash of their key; rounds of k-means.
SAMPLE, ROUNDS = 50_000, 12
#: Cells at most, bytes of a code at most and values of each byte. Centres and codebooks are all that is broadcast: (CELLS + VALUES) * d numbers at most.
CELLS, SUBSPACES, VALUES = 4096, 16, 256
#: Queries, of the indexed vectors, that `probes` and `rerank` are set by, and codes of a list that a task holds at once.
CALIBRATED, BLOCK = 200, 16_384
#: Queries whose scores a task holds at once.
ASKED = 256
#: Queries that meet a block of codes in one group, about: each passes on as many rows as are reranked.
TOGETHER = 2048


def kmeans(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of the points by Lloyd's rounds, as many as there are different points at most; always the same for the same points."""
    rng = np.random.Generator(np.random.PCG64(seed))
    different = np.unique(points, axis=0)
    centres = different[np.sort(rng.permutation(len(different))[:k])].copy()
    for _ in range(ROUNDS):
        near = closest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each point the number of its nearest centre."""
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(points), np.int64)
    for i in range(0, len(points), 4096):
        out[i : i + 4096] = (points[i : i + 4096] @ centres.T - half).argmax(axis=1)
    return out


def bounds(d: int) -> list[tuple[int, int]]:
    """The stretches of components that each byte of a code stands for."""
    parts = min(SUBSPACES, d)
    return [(d * i // parts, d * (i + 1) // parts) for i in range(parts)]


@dataclass(frozen=True)
class Quantisers:
    centres: np.ndarray
    books: list[np.ndarray]

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (rows, bytes) of unit vectors."""
        cells = closest(unit, self.centres)
        rest = unit - self.centres[cells]
        codes = [closest(rest[:, a:b], book).astype(np.uint8) for (a, b), book in zip(bounds(unit.shape[1]), self.books, strict=True)]
        return cells, np.stack(codes, axis=1)

    def probe(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The cells to read for each query (queries, probes), nearest first."""
        half = (self.centres * self.centres).sum(axis=1) / 2
        return np.argsort(half - unit @ self.centres.T, axis=1, kind="stable")[:, :probes]

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Products of each query with each value of each byte (queries, bytes, VALUES)."""
        out = np.zeros((len(unit), len(self.books), VALUES), np.float32)
        for j, ((a, b), book) in enumerate(zip(bounds(unit.shape[1]), self.books, strict=True)):
            out[:, j, : len(book)] = unit[:, a:b] @ book.T
        return out


def unit_vector(v: Column) -> Column:
    """The vector, in doubles, at length one; null for null and zero vectors, and for null or non-finite components."""
    wide = v.cast("array<double>")
    fit = F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0), F.lit(False))
    return F.when(fit, F.transform(F.array(wide), lambda w: F.transform(w, lambda x: x / F.sqrt(total(F.transform(w, lambda y: y * y)))))[0])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


@dataclass(frozen=True)
class Shape:
    """What a search reads by default: the cells and how many of the best by their codes are scored exactly, as calibrated."""

    d: int
    probes: int
    rerank: int
    recall: float


class VectorIndex:
    """(key, vector) rows by cosine. `key` is a 64-bit integer."""

    def __init__(self, spark: SparkSession, folder: str, shape: Shape, quantisers: Quantisers):
        self.spark, self.folder, self.shape, self.quantisers = spark, folder.rstrip("/"), shape, quantisers

    # -- building ------------------------------------------------------------------------------------------------

    @staticmethod
    def build(vectors: DataFrame, key: str, column: str, folder: str | None = None, cells: int | None = None, recall: float = 0.95, k: int = 10) -> VectorIndex:
        """Indexes every row of vectors whose vector can be scored and has the length that most have; others are left out.

        The quantisers are fitted on SAMPLE rows at most. `cells` is by default the square root of the rows. How many cells a search probes
        and how many rows it reranks are set so that CALIBRATED of the rows, asked for their k nearest, find a share of
        `recall` of them.
        """
        spark = vectors.sparkSession
        folder = folder or shared_folder(spark, "vector-index")
        rows = vectors.select(F.col(key).cast("long").alias("key"), unit_vector(F.col(column)).alias("vector")).where("key is not null and vector is not null")
        lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
        if lengths is None:
            index = VectorIndex(spark, folder, Shape(0, 1, 1, 1.0), Quantisers(np.zeros((1, 0)), []))
            index._write(rows.where("false"))
            index._keep()
            return index
        d, n = lengths["d"], lengths["n"]
        rows = rows.where(F.size("vector") == d)
        sample = rows.orderBy(F.xxhash64("key", F.lit(11)), "key").limit(SAMPLE)  # takes the least of each task
        points = _matrix(sample.toPandas()["vector"])
        centres = kmeans(points, min(CELLS, cells or max(1, round(n**0.5))), 1)
        rest = points - centres[closest(points, centres)]
        books = VectorIndex._books(spark, rest)
        index = VectorIndex(spark, folder, Shape(d, len(centres), n, 1.0), Quantisers(centres, books))
        index._write(rows)
        index = index._calibrated(k, recall)
        index._keep()
        return index

    @staticmethod
    def _books(spark: SparkSession, rest: np.ndarray) -> list[np.ndarray]:
        """A codebook for each byte, each fitted in a task of its own on the sample's part of it."""
        parts = pd.DataFrame({"byte": range(len(bounds(rest.shape[1]))), "points": [rest[:, a:b].ravel().tolist() for a, b in bounds(rest.shape[1])]})
        widths = [b - a for a, b in bounds(rest.shape[1])]

        def fitted(part: pd.DataFrame) -> pd.DataFrame:
            byte = int(part["byte"].iloc[0])
            book = kmeans(np.asarray(part["points"].iloc[0]).reshape(-1, widths[byte]), VALUES, 100 + byte)
            return pd.DataFrame({"byte": [byte], "book": [book.ravel().tolist()]})

        made = spark.createDataFrame(parts, "byte int, points array<double>").groupBy("byte").applyInPandas(fitted, "byte int, book array<double>").collect()
        return [np.array(r["book"]).reshape(-1, widths[r["byte"]]) for r in sorted(made, key=lambda r: r["byte"])]

    def _write(self, rows: DataFrame) -> None:
        shared = self.spark.sparkContext.broadcast(self.quantisers)

        def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    cells, codes = shared.value.assign(_matrix(f["vector"]))
                    yield pd.DataFrame({"cell": cells.astype(np.int32), "key": f["key"], "code": [c.tobytes() for c in codes], "vector": f["vector"]})

        made = rows.mapInPandas(assigned, "cell int, key bigint, code binary, vector array<double>")
        made.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/lists")  # a large cell is many tasks' work

    def _keep(self) -> None:
        kept = {**asdict(self.shape), "centres": self.quantisers.centres.tolist(), "books": [b.tolist() for b in self.quantisers.books]}
        self.spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/quantisers")

    @staticmethod
    def open(spark: SparkSession, folder: str) -> VectorIndex:
        """An index that was built before, in this session or another."""
        kept = json.loads(spark.read.text(f"{folder}/quantisers", wholetext=True).first()["value"])
        centres = np.array(kept.pop("centres"))
        centres, books = centres.reshape(len(centres), kept["d"]), [np.array(b) for b in kept.pop("books")]
        return VectorIndex(spark, folder, Shape(**kept), Quantisers(centres, books))

    def add(self, vectors: DataFrame, key: str, column: str) -> None:
        """Indexes more rows by the quantisers there are. A key that is there already is there twice."""
        rows = vectors.select(F.col(key).cast("long").alias("key"), unit_vector(F.col(column)).alias("vector"))
        self._write(rows.where(f"key is not null and vector is not null and size(vector) = {self.shape.d}"))

    # -- asking --------------------------------------------------------------------------------------------------

    def lists(self) -> DataFrame:
        """All rows (key, code, vector, cell)."""
        return self.spark.read.schema("key bigint, code binary, vector array<double>, cell int").parquet(f"{self.folder}/lists")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Queries (query_id, vector) as unit vectors of the index's length."""
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit_vector(F.col("vector")).alias("asked")).where(f"query_id is not null and size(asked) = {self.shape.d}")
        return asked.dropDuplicates(["query_id"])

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """(query_id, rank, key, score): the k nearest of each query (query_id, vector) that its probed cells hold, ties to the smaller key.

        With as many probes as cells and rerank as rows the result is exact. Queries without an id or a vector of the index's
        length find nothing; of queries with one id any one is taken. Each group of the search is a block of one list
        and a slice of the queries that probe it, so a group's rows don't grow with the queries.
        """
        probes, rerank = min(probes or self.shape.probes, len(self.quantisers.centres)), max(k, rerank or self.shape.rerank)
        shared = self.spark.sparkContext.broadcast(self.quantisers)

        def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    cells = shared.value.probe(_matrix(f["asked"]), probes)
                    at = np.repeat(np.arange(len(f)), cells.shape[1])
                    yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[at], "asked": f["asked"].to_numpy()[at], "cell": cells.ravel().astype(np.int32)})

        asked = self._asked(queries)
        probing = asked.mapInPandas(probed, "query_id bigint, asked array<double>, cell int").persist()
        wanted = {r["cell"]: r["count"] for r in probing.groupBy("cell").count().collect()}  # CELLS rows at most
        lists = self.lists().where(F.col("cell").isin(list(wanted)))
        sizes = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).withColumnRenamed("cell", "c")  # CELLS rows at most
        sizes = F.broadcast(sizes)
        every = probes == len(self.quantisers.centres) and rerank >= self.lists().count()  # then codes can leave nothing out, and vectors are scored at once
        slices = 1 if every else slices_of(wanted.values())  # without codes a query passes on k rows, and vectors are wide to be copied
        codes = lists.join(sizes, F.col("cell") == F.col("c")).select("cell", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "vector" if every else "code")
        codes = codes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        meets = probing.join(sizes, F.col("cell") == F.col("c")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", in_slice(slices).alias("slice"), "query_id", "asked")
        scores = _scored_exactly(k) if every else _scored(shared, rerank)
        found = meets.groupBy("cell", "block", "slice").cogroup(codes.groupBy("cell", "block", "slice")).applyInPandas(scores, "query_id bigint, cell int, key bigint, near double")
        best = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "key")
        if every:
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "key", F.col("near").alias("score"))
        near = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rerank).select("query_id", F.col("cell").alias("c"), F.col("key").alias("k"))
        near = broadcast_if_small(near.join(asked.withColumnRenamed("query_id", "q"), F.col("query_id") == F.col("q")).drop("q").persist(), rows=20_000)
        score = total(F.zip_with("vector", "asked", lambda a, b: a * b))
        exact = lists.join(near, (F.col("cell") == F.col("c")) & (F.col("key") == F.col("k"))).select("query_id", "key", score.alias("score"))
        top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
        return exact.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")

    def exact(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The same of all rows, by their vectors: what recall is measured against. Queries, which must be few, meet every row in blocks."""
        asked = self._asked(queries).toPandas()
        shared = self.spark.sparkContext.broadcast((asked["query_id"].to_numpy(), _matrix(asked["asked"]).reshape(len(asked), self.shape.d)))

        def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, unit = shared.value
            for f in frames:
                if len(f) and len(ids):
                    yield from _blocks(ids, unit, f["key"].to_numpy(), _matrix(f["vector"]).T, k, f["cell"].to_numpy())

        found = self.lists().select("key", "vector", "cell").mapInPandas(scored, "query_id bigint, cell int, key bigint, near double")
        top = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "key")
        return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "key", F.col("near").alias("score"), "cell")

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None) -> float:
        """The share of the k nearest that a search finds; a row as near as the kth counts as found."""
        return self._recall_of(queries, self.exact(queries, k).persist(), k, probes, rerank)

    def _recall_of(self, queries: DataFrame, exact: DataFrame, k: int, probes: int | None, rerank: int | None) -> float:
        floor = exact.groupBy(F.col("query_id").alias("q")).agg((F.min("score") - 1e-9).alias("kth"), F.count(F.lit(1)).alias("n"))
        found = self.search(queries, k, probes, rerank).join(F.broadcast(floor), F.col("query_id") == F.col("q")).agg(F.count_if(F.col("score") >= F.col("kth")).alias("x")).first()["x"]
        wanted = floor.agg(F.sum("n").alias("n")).first()["n"] or 0
        return 1.0 if not wanted else min(1.0, found / wanted)

    def _calibrated(self, k: int, recall: float) -> VectorIndex:
        """This index with the fewest probes and then the smallest rerank by which the calibrating queries reach the recall."""
        asks = self.lists().select(F.col("key").alias("query_id"), "vector").orderBy(F.xxhash64("query_id", F.lit(12)), "query_id").limit(CALIBRATED)
        asks = self.spark.createDataFrame(asks.toPandas(), "query_id bigint, vector array<double>")  # CALIBRATED rows
        exact = self.exact(asks, k).persist()
        true = exact.toPandas()  # k rows a query
        cells = self.quantisers.probe(_matrix(asks.toPandas()["vector"]), len(self.quantisers.centres))
        rank_of = {q: {int(c): r for r, c in enumerate(row)} for q, row in zip(asks.toPandas()["query_id"], cells, strict=True)}
        ranks = np.sort([rank_of[q][c] for q, c in zip(true["query_id"], true["cell"], strict=True)])
        aim = min(1.0, recall + (1 - recall) / 2)  # half of what may be lost is left to the codes
        probes = int(ranks[min(len(ranks), int(np.ceil(aim * len(ranks)))) - 1]) + 1
        rerank, rows, got = 4 * k, self.shape.rerank, 0.0
        while True:
            got = self._recall_of(asks, exact, k, probes, rerank)
            if got >= recall or rerank >= rows:
                break
            rerank *= 4
        while got < recall and probes < len(self.quantisers.centres):
            probes = min(2 * probes, len(self.quantisers.centres))
            got = self._recall_of(asks, exact, k, probes, rerank)
        return VectorIndex(self.spark, self.folder, replace(self.shape, probes=probes, rerank=min(rerank, max(rows, k)), recall=got), self.quantisers)


def slices_of(asking: Collection[int]) -> int:
    """In how many slices queries meet the codes, for the numbers of queries that probe each cell."""
    return max(1, -(-max(asking, default=1) // TOGETHER))


def in_slice(slices: int) -> Column:
    """The slice of a query."""
    return F.pmod(F.xxhash64("query_id", F.lit(13)), F.lit(slices)).cast("int")


def _best(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int, cells: np.ndarray) -> pd.DataFrame:
    """Of scores (queries, keys) each query's k best, ties to the smaller key."""
    out = []
    for q, row in zip(ids.tolist(), scores, strict=True):
        some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
        some = some[np.lexsort((keys[some], -row[some]))[:k]]
        out.append((np.full(len(some), q), cells[some], keys[some], row[some].astype(np.float64)))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "cell", "key", "near"), parts, strict=True)))


def _blocks(ids: np.ndarray, unit: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int, cells: np.ndarray) -> Iterator[pd.DataFrame]:
    """`_best` of the vectors (d, keys) for all queries, with the scores of ASKED of them at once, however many there are."""
    for i in range(0, len(ids), ASKED):
        yield _best(ids[i : i + ASKED], keys, unit[i : i + ASKED] @ vectors, k, cells)


def _scored_exactly(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of one block of a list for the queries, by the vectors. Products are added component by component, so that equal
    vectors have equal scores."""

    def scored(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.array([], "int64"), "cell": pd.array([], "int32"), "key": pd.array([], "int64"), "near": pd.array([], "float64")})]
        if len(queries) and len(rows):
            keys, vectors = rows["key"].to_numpy(), np.ascontiguousarray(_matrix(rows["vector"]).T)
            cells = np.full(len(keys), int(queries["cell"].iloc[0]), np.int32)
            for i in range(0, len(queries), ASKED):
                part = queries.iloc[i : i + ASKED]
                unit = _matrix(part["asked"])
                scores = np.zeros((len(part), len(keys)))
                for j, component in enumerate(vectors):
                    scores += unit[:, j, None] * component
                out.append(_best(part["query_id"].to_numpy(), keys, scores, k, cells))
        return pd.concat(out[1:] or out)

    return scored


def _scored(shared, rerank: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores of the codes of one block of a list for the queries that probe it."""

    def scored(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.array([], "int64"), "cell": pd.array([], "int32"), "key": pd.array([], "int64"), "near": pd.array([], "float64")})
        if not len(queries) or not len(codes):
            return none
        q = shared.value
        cell, keys = int(queries["cell"].iloc[0]), codes["key"].to_numpy()
        code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        out = []
        for i in range(0, len(queries), ASKED):
            part = queries.iloc[i : i + ASKED]
            unit = _matrix(part["asked"])
            tables = q.tables(unit)
            scores = np.repeat((unit @ q.centres[cell])[:, None].astype(np.float32), len(codes), axis=1)
            for j in range(code.shape[1]):
                scores += tables[:, j, :][:, code[:, j]]
            out.append(_best(part["query_id"].to_numpy(), keys, scores, rerank, np.full(len(keys), cell, np.int32)))
        return pd.concat(out)

    return scored
