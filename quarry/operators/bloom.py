"""A kept Bloom filter over keys, in column functions: which new keys can be there already.

Each key sets HASHES bits of a row of 64-bit words. The filter is one row of a size fixed by `bits`, so it can be broadcast, kept
as a table, and joined with the filter of later keys. A key that was added is always found; others are found by chance at
`false_positive_rate`.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
#: Bits of a filter by default: 128 KB, for about 100,000 keys at a rate of 1 in 100.
BITS = 1 << 20


def false_positive_rate(keys: int, bits: int = BITS) -> float:
    """The share of other keys that a filter of so many keys finds."""
    return (1 - exp(-HASHES * keys / bits)) ** HASHES


def _places(keys: Sequence[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(HASHES)]


def bloom_filter(rows: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """One row (words array<bigint>) of the keys of all rows; those with a null key set nothing, as they equal none.

    Each task ors the bits of its rows first, so what is shuffled is bounded by the filter's size.
    """
    if bits % 64:
        raise ValueError("a filter has whole words of 64 bits")
    known = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    set_ = known.select(F.explode(F.array(*_places([F.col(k) for k in keys], bits))).alias("at"))
    words = set_.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = words.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("__word"))
    filled = every.join(words, F.col("__word") == F.col("word"), "left").select("__word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))  # all words, in order
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("__word", "bits"))), lambda x: x["bits"]).alias("words"))


def joined(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of the keys of either."""
    both = one.unionByName(other).select(F.posexplode("words").alias("word", "bits"))
    merged = both.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def possible(words: Column, keys: Sequence[Column]) -> Column:
    """Whether the filter may have the key; never for one with a null."""
    out = F.lit(True)
    for k in keys:
        out = out & k.isNotNull()
    bits = F.size(words).cast("long") * 64
    for i in range(HASHES):
        at = F.pmod(F.xxhash64(F.lit(i), *keys), bits)
        out = out & (F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return out


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], kept: DataFrame) -> DataFrame:
    """`changes.insert_if_absent` where `kept` is the filter of the existing keys: only new rows that may be there meet the existing ones."""
    from quarry.operators.changes import insert_if_absent as exact

    marked = new.join(F.broadcast(kept.select(F.col("words").alias("__words"))), how="cross")  # one row of a fixed size
    marked = marked.withColumn("__may", possible(F.col("__words"), [F.col(k) for k in keys])).drop("__words")
    sure, unsure = marked.where(~F.col("__may")).drop("__may"), marked.where("__may").drop("__may")
    return sure.unionByName(exact(existing, unsure, keys))
