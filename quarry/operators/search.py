"""Vector search over records and their embeddings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.vector_index import VectorIndex
from quarry.schemas import RECORD_TYPES

DEFAULT_K = 10
HIT = ("repository_name", "branch", "commit_sha", "file_path", "line_start", "line_end", "symbol_name", "record_type", "summary", "code_snippet")


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to a constant vector, in double; null for a null or zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) * float(x) for x in query) ** 0.5

    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    dot = total(F.zip_with(vector, q, lambda a, b: a.cast("double") * b))
    own = F.sqrt(total(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))
    return F.try_divide(dot, own * F.lit(norm))


@dataclass(frozen=True)
class SearchQuery:
    """What is asked for. Lists and names that are empty don't restrict. k below 1 means the default."""

    vector: Sequence[float]
    model: str | None = None
    repositories: Sequence[str] = ()
    branch: str | None = None
    record_types: Sequence[str] = ()
    k: int = DEFAULT_K
    min_score: float | None = None
    include_stale: bool = False
    include_other_models: bool = False

    def __post_init__(self):
        unknown = [t for t in self.record_types if t not in RECORD_TYPES]
        if unknown:
            raise ValueError(f"unknown record type: {unknown[0]}")


def nearest(rows: DataFrame, score: Column, tie: str, k: int = DEFAULT_K, min_score: float | None = None) -> DataFrame:
    """The k rows with the largest score, ties by `tie`; rows without a score are left out. min_score is applied to those k."""
    best = rows.withColumn("score", score).where("score is not null").orderBy(F.col("score").desc(), tie).limit(k if k > 0 else DEFAULT_K)
    return best if min_score is None else best.where(F.col("score") >= min_score)


def search(records: DataFrame, embeddings: DataFrame, q: SearchQuery) -> DataFrame:
    """The hits of a query, best first: HIT columns and score.

    Predicates are put on each side before the join, so they reach the scans; a record with several embeddings can be
    several hits, one without any is none. Only ids are joined with scores; the k best are found as a bounded heap in each task,
    and what else a hit shows is fetched for these k, whose ids reach the records as a broadcast.
    """
    left, right = _asked(records, embeddings, q)
    scored = right.select("code_record_id", cosine(F.col("embedding_vector"), q.vector).alias("s")).where("s is not null")
    ids = left.select("id").join(scored, F.col("id") == F.col("code_record_id")).select("id", "s")
    return _hits(left, nearest(ids, F.col("s"), "id", q.k, q.min_score))


def _asked(records: DataFrame, embeddings: DataFrame, q: SearchQuery) -> tuple[DataFrame, DataFrame]:
    """Records and embeddings that a query asks for."""
    left = records if q.include_stale else records.where(~F.col("is_stale"))
    if q.repositories:
        left = left.where(F.col("repository_name").isin(*q.repositories))
    if q.branch:
        left = left.where(F.col("branch") == q.branch)
    if q.record_types:
        left = left.where(F.col("record_type").isin(*q.record_types))
    return left, embeddings if q.include_other_models or not q.model else embeddings.where(F.col("embedding_model") == q.model)


def _hits(records: DataFrame, best: DataFrame) -> DataFrame:
    """What the hits (id, score), k rows, show of their records."""
    best = best.select(F.col("id").alias("__id"), "score")
    hits = records.select("id", *HIT).join(F.broadcast(best), F.col("id") == F.col("__id"))
    return hits.orderBy(F.col("score").desc(), "id").select(*HIT, "score")


def index_key(embedding_id: Column) -> Column:
    """The key of an embedding in a vector index."""
    return F.xxhash64(embedding_id)


def indexed_search(records: DataFrame, embeddings: DataFrame, index: VectorIndex, q: SearchQuery, over: int = 20) -> DataFrame:
    """`search` by a kept index of the embeddings (key: `index_key` of their id): of the index's `over` * k nearest those that the query
    asks for. Where fewer than k of them are left, because few rows are asked for, the exact search gives the hits."""
    k = q.k if q.k > 0 else DEFAULT_K
    spark = records.sparkSession
    left, right = _asked(records, embeddings, q)
    asked = spark.createDataFrame([(0, [float(x) for x in q.vector])], "query_id long, vector array<double>")
    found = F.broadcast(index.search(asked, over * k).select("key", F.col("score").alias("s")))  # over * k rows
    near = right.select(index_key(F.col("id")).alias("__key"), "code_record_id").join(found, F.col("__key") == F.col("key"))
    ids = left.select("id").join(F.broadcast(near.select("code_record_id", "s")), F.col("id") == F.col("code_record_id")).select("id", "s")
    best = nearest(ids, F.col("s"), "id", k).select("id", "score").persist()
    if best.count() < k:
        return search(records, embeddings, q)
    return _hits(left, best if q.min_score is None else best.where(F.col("score") >= q.min_score))
