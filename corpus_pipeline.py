"""A corpus pipeline over `documents`: quality, near-duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents. Stages take all rows that their predecessor kept, read
whole texts however long, and give an empty table for an empty one. Near-duplicates are over shingles of five words, the
default for stages on word shingles; the query over documents alone, op3_near_dedup, has two by its contract.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, neardup, pii, quality
from quarry.llm.common import cut, read_table, remove, shared_dir, small_side


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels outside the held-out third. Null and empty texts have the
    model's prior; rows without a doc_id and repeated rows are judged by their text like others."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~quality.held_out())
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # none is named like a result
    kept = quality.score(docs.withColumnsRenamed(own), model).where("predicted = 1")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingles of five words and a similarity of 0.8: one with the smallest doc_id.

    Rows are told apart by doc_id and text, and rows that share both are one document. Rows without a doc_id or words all stay.
    """
    row = F.xxhash64("doc_id", "text")
    known = docs.where("doc_id is not null").select(row.alias("doc_id"), F.col("doc_id").alias("own"), "text")
    found = cut(neardup.near_duplicates(known).where("n_shingles > 0").select("doc_id", "own", "component_id"))
    first = found.groupBy("component_id").agg(F.min(F.struct("own", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("stays"))
    # by row and not by component, of which one can hold a third of all rows
    gone = found.select(F.col("doc_id").alias("__gone")).distinct().join(first, F.col("__gone") == F.col("stays"), "left_anti")
    again = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__again")))
    named = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), row))
    left = named.join(small_side(cut(gone), rows=2_000_000), F.col("__row") == F.col("__gone"), "left_anti")
    if not again.isEmpty():
        again = small_side(again, rows=2_000_000)
        once = left.join(again, F.col("__row") == F.col("__again"), "left_semi").dropDuplicates(["__row"])
        left = left.join(again, F.col("__row") == F.col("__again"), "left_anti").unionByName(once)
    return left.select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the text. A null text stays null."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which is two times at most. Equal rows are taken alike; texts
    without words take none of the target."""
    mixed = mixing.pareto_mix(docs)
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids, decoded_sha256) of every document: its ids, and the SHA-256 of what they decode to.
    A null text is empty and has no ids."""
    encoded = bpe.encode_checked(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: The trained stages can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared folder, until the next stage is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
