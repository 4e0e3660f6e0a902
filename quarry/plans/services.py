"""The two services: scanning a repository into the store, and asking the store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.embed import EmbeddingError, Embedder, embed_cached, embedding_rows
from quarry.operators.search import SearchQuery, index_key, indexed_search, search
from quarry.operators.store import Store
from quarry.operators.vector_index import VectorIndex
from quarry.plans.scan import Counters, ScanContext, records
from quarry.sources.files import Repository, scan_files
from quarry.sources.settings import Settings


@dataclass(frozen=True)
class ScanResult:
    repository: Repository
    job_id: str | None = None
    already_indexed: bool = False
    files_scanned: int = 0
    records_created: int = 0
    records_inserted: int = 0
    records_failed: int = 0
    redaction_failed: int = 0
    embeddings_created: int = 0
    embeddings_failed: int = 0
    seconds: float = 0.0


def scan(store: Store, repo: Repository, embedder: Embedder, settings: Settings | None = None, terms: Sequence[str] = (), force: bool = False) -> ScanResult:
    """Scans a repository: records are inserted once, what an earlier scan of the branch had and this one hasn't becomes stale,
    and records without an embedding are embedded. A commit that is indexed is not scanned again unless `force`."""
    settings = settings or Settings()
    began = time.time()
    spark = store.spark
    store.migrate()
    repository_id = store.upsert_repository(repo.name, repo.branch, repo.commit_sha, repo.url, repo.path)
    if not force and store.has_completed(repository_id, repo.branch, repo.commit_sha):
        return ScanResult(repo, already_indexed=True)
    job = store.start_job(repository_id, repo.branch, repo.commit_sha)
    try:
        files = scan_files(spark, repo.path, settings.scanner.ignore_paths, settings.scanner.max_file_size_kb)
        counting = Counters()
        rows = store.staged(job, "rows", counting.counted(files, list(terms)))
        counts = counting.result()
        new = store.staged(job, "records", records(rows, ScanContext(repository_id, job, repo.name, repo.branch, repo.commit_sha)))
        inserted = store.add_records(repo.name, repo.branch, new)
        part = store.part(repo.name, repo.branch)
        pending = store.table("code_record", part).where((F.col("embedding_status") != "embedded") & ~F.col("is_stale"))
        e = settings.embedding
        # written before anything is counted, so that no text is asked for again
        vectors = store.staged(job, "vectors", embed_cached(pending, embedder, f"{store.root}/_embedded", e.batch_size, e.max_retries, e.retry_backoff_seconds))
        failed = vectors.where("embedding_vector is null").select(F.col("code_record_id").alias("done_id"))
        made, lost = vectors.where("embedding_vector is not null").count(), failed.count()
        store.add_embeddings(repo.name, repo.branch, embedding_rows(vectors, embedder), failed)
        store.unstage(job)
    except Exception as error:
        store.finish_job(job, "failed", error=str(error)[:2000])
        raise
    store.finish_job(job, "completed", inserted, counts["records_failed"] + counts["redaction_failed"])
    return ScanResult(
        repo, job, False, counts["files_scanned"], counts["records_created"], inserted, counts["records_failed"], counts["redaction_failed"], made, lost, time.time() - began
    )


def build_index(store: Store, model: str, recall: float = 0.95) -> VectorIndex:
    """A vector index of all embeddings of a model, kept in the store; `store_index` opens it again."""
    rows = store.table("code_embedding").where(F.col("embedding_model") == model).select(index_key(F.col("id")).alias("key"), "embedding_vector")
    index = VectorIndex.build(rows, "key", "embedding_vector", f"{store.root}/_index/{uuid.uuid4().hex}", recall=recall)
    store.name_index(model, index.folder)
    return index


def store_index(store: Store, model: str) -> VectorIndex | None:
    """The index that was last built for a model, if any."""
    folder = store.named_index(model)
    return VectorIndex.open(store.spark, folder) if folder else None


def ask(store: Store, question: str, embedder: Embedder, query: SearchQuery | None = None, index: VectorIndex | None = None) -> DataFrame | None:
    """Hits for a question, best first; None if it can't be embedded. `query` holds the other restrictions. With an index few vectors are
    read; rows that were stored after it was built are not in it."""
    if not question or not question.strip():
        raise ValueError("a question is needed")
    try:
        vectors = embedder.embed([question])
    except EmbeddingError:
        return None
    if not vectors:
        return None
    q = replace(query or SearchQuery(()), vector=vectors[0], model=embedder.model)
    records_, embeddings = (store.table(t, repositories=q.repositories, branch=q.branch) for t in ("code_record", "code_embedding"))
    if index is not None and not q.include_other_models:
        return indexed_search(records_, embeddings, index, q)
    return search(records_, embeddings, q)


def session(name: str = "quarry") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
