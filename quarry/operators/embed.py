"""Embedding records: text, batches, an embedder with retries, and the rows that are stored."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.tokens import embedding_text
from quarry.schemas import CODE_EMBEDDING


class EmbeddingError(Exception):
    """A batch that could not be embedded."""


class Embedder(Protocol):
    model: str
    version: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Works offline: words are hashed to signed dimensions, and the vector has length one. Blank texts give a zero vector."""

    dimension: int = 64
    model: str = "hashed-words"
    version: str = "1"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


@dataclass(frozen=True)
class HttpEmbedder:
    """POST {endpoint}/v1/embeddings with {model, input}; vectors are put in order of their index and checked."""

    endpoint: str
    model: str
    dimension: int
    api_key: str = ""
    version: str = "1"
    send: Callable[[urllib.request.Request], bytes] | None = None

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        request = urllib.request.Request(f"{self.endpoint.rstrip('/')}/v1/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        try:
            raw = self.send(request) if self.send else urllib.request.urlopen(request, timeout=120).read()  # noqa: S310
            data = json.loads(raw)["data"]
        except (urllib.error.URLError, OSError, ValueError, KeyError, TypeError) as e:
            raise EmbeddingError(f"the embedding service failed: {e}") from e
        vectors = [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        if len(vectors) != len(texts):
            raise EmbeddingError(f"{len(texts)} texts were sent, {len(vectors)} vectors came back")
        if any(len(v) != self.dimension for v in vectors):
            raise EmbeddingError(f"a vector doesn't have {self.dimension} numbers")
        return vectors


def batches(items: Sequence, size: int) -> Iterator[Sequence]:
    """Slices of `size` items in order; the last can be shorter."""
    if size <= 0:
        raise ValueError("a batch holds at least one item")
    for i in range(0, len(items), size):
        yield items[i : i + size]


def with_retries(call: Callable[[], list], retries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list:
    """call(), again after wait, 2 * wait, 4 * wait ... seconds for as often as `retries` while it raises EmbeddingError."""
    for attempt in range(retries + 1):
        try:
            return call()
        except EmbeddingError:
            if attempt == retries:
                raise
            sleep(wait * 2**attempt)
    return []


def embed_records(records: DataFrame, embedder: Embedder, batch_size: int = 256, retries: int = 5, wait: float = 2.0) -> DataFrame:
    """(code_record_id, embedding_text, embedding_vector) of records; the vector is null where its batch failed for good.

    Keep the result before branching on it: reading it twice would ask the embedder twice.
    """
    texts = records.select("id", embedding_text({c: F.col(c) for c in records.columns}).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame, batch_size):
                try:
                    vectors = with_retries(lambda rows=list(part["text"]): embedder.embed(rows), retries, wait)
                except EmbeddingError:
                    vectors = [None] * len(part)
                yield pd.DataFrame({"code_record_id": part["id"], "embedding_text": part["text"], "embedding_vector": vectors})

    return texts.mapInPandas(run, "code_record_id string, embedding_text string, embedding_vector array<float>")


def embed_cached(records: DataFrame, embedder: Embedder, folder: str, batch_size: int = 256, retries: int = 5, wait: float = 2.0) -> DataFrame:
    """`embed_records` by a cache of vectors in the shared folder: each different text is asked for once, ever, for one model and version.

    Texts are named by their SHA-256. Those without a vector are embedded and their vectors written, before any of them is used;
    what failed is not kept, so a later run asks for it again. A lost task asks again for its own batches only.
    """
    spark = records.sparkSession
    name = F.sha2(F.concat_ws("\u001f", F.lit(embedder.model), F.lit(embedder.version), "text"), 256)
    texts = records.select("id", embedding_text({c: F.col(c) for c in records.columns}).alias("text")).withColumn("name", name)
    schema = "name string, vector array<float>"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    known = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    new = texts.dropDuplicates(["name"]).join(known.select(F.col("name").alias("__name")), F.col("name") == F.col("__name"), "left_anti").select("name", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame, batch_size):
                try:
                    vectors = with_retries(lambda rows=list(part["text"]): embedder.embed(rows), retries, wait)
                except EmbeddingError:
                    continue
                yield pd.DataFrame({"name": part["name"], "vector": vectors})

    new.mapInPandas(run, schema).write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder).dropDuplicates(["name"]).withColumnRenamed("name", "__name")
    held = texts.join(found, F.col("name") == F.col("__name"), "left")
    return held.select(F.col("id").alias("code_record_id"), F.col("text").alias("embedding_text"), F.col("vector").alias("embedding_vector"))


def embedding_rows(embedded: DataFrame, embedder: Embedder) -> DataFrame:
    """code_embedding rows of what was embedded."""
    rows = embedded.where("embedding_vector is not null")
    rows = rows.withColumn("embedding_model", F.lit(embedder.model)).withColumn("embedding_model_version", F.lit(embedder.version)).withColumn("embedding_dimension", F.size("embedding_vector"))
    rows = rows.withColumn("id", F.sha2(F.concat_ws("\u001f", "code_record_id", "embedding_model", "embedding_model_version"), 256)).withColumn("created_at", F.current_timestamp())
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CODE_EMBEDDING.fields])
