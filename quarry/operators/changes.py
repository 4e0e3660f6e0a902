"""Changes of tables, as functions from rows to rows: inserts, upserts and state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schemas import RECORD_KEY
from quarry.shared import with_positions


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """The new rows whose key no existing row has. A key with a null equals none, so such rows are always new."""
    have = existing.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on: Column = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return new.join(have, on, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: Sequence[str]) -> DataFrame:
    """Existing rows with `overwrite` columns taken from the new row of the same key, and the new rows of other keys."""
    fresh = new.select(*[F.col(c).alias(f"__{c}") for c in new.columns])
    on: Column = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    both = existing.withColumn("__old", F.lit(True)).join(fresh, on, "full_outer")
    old, there = F.col("__old").isNotNull(), F.col(f"__{keys[0]}").isNotNull()
    return both.select(*[F.when(old & ~there if c in overwrite else old, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in existing.columns])


def mark_stale(records: DataFrame, where: Column, but: DataFrame | None = None, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Records with is_stale set where the condition holds; those whose key is in `but` are fresh again."""
    marked = records.withColumn("is_stale", F.col("is_stale") | where)
    if but is None:
        return marked
    seen = but.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__seen", F.lit(True))
    on: Column = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return marked.join(seen, on, "left").withColumn("is_stale", F.when(F.col("__seen"), F.lit(False)).otherwise(F.col("is_stale"))).select(*records.columns)


def with_status(records: DataFrame, ids: DataFrame, status: str, key: str = "id", state: str = "embedding_status") -> DataFrame:
    """Records with the state set for the ids (a column `done_id`); no ids change nothing."""
    done = ids.select(F.col("done_id").alias("__done")).distinct()
    joined = records.join(done, F.col(key) == F.col("__done"), "left")
    return joined.withColumn(state, F.when(F.col("__done").isNotNull(), F.lit(status)).otherwise(F.col(state))).select(*records.columns)


def exists_completed(jobs: DataFrame, **equal: object) -> bool:
    """Whether a completed job has the given values."""
    rows = jobs.where(F.col("status") == "completed")
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return bool(rows.select(F.lit(1)).limit(1).take(1))


def batch_numbers(position: Column, size: int) -> Column:
    """The number of the batch that a row, counted from 0, falls in."""
    if size <= 0:
        raise ValueError("a batch holds at least one row")
    return F.floor(position / size)


def batched(rows: DataFrame, size: int, order: Sequence[str], keys: Sequence[str] = (), out: str = "batch") -> DataFrame:
    """rows with the number of their batch: `size` rows each, in order, for each of the keys; only a key's last one can be smaller."""
    position = "__position"
    return with_positions(rows, order, keys, position).withColumn(out, batch_numbers(F.col(position), size)).drop(position)
