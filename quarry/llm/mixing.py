"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import cut, others, small_side

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bins of the ranking per source and level: two levels of 4096 leave a task 1 in 16 million of a source's rows.
BINS = 4096

OUT = ("size", "source_size", "target", "inclusion", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in order of code points, null last, weigh `weights`, repeating, and share `share` times the
    sum of all sizes. A target above `most` times its source's size stops there; its excess is shared
    again among the others by weight, until none is above. Sources of size 0 get 0. No rows give no rows.

    Sources stop in the order of size by weight. So if the first so many of that order stop, the others' rate per
    weight is what is left by the weights left, and the rate that holds is the first that stops no further source: one
    running sum over a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__i", F.row_number().over(order) - 1).withColumn("__w", weight)
    limit = F.col("source_size") * F.lit(float(most))
    every = Window.partitionBy()
    by = Window.orderBy(limit / F.col("__w"), "__i")
    before = F.coalesce(F.sum(limit).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("__w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = sums.withColumn("__rate", F.greatest(F.lit(float(share)) * F.sum("source_size").over(every) - before, F.lit(0.0)) / from_here)
    held = F.min(F.when(F.col("__rate") * F.col("__w") <= limit, F.struct(limit / F.col("__w"), "__i", "__rate"))).over(every)["__rate"]
    rate = rated.withColumn("__held", held)
    return rate.select("source", "source_size", F.least(limit, F.coalesce(F.col("__held") * F.col("__w"), limit)).alias("target"))


def size_class(size: Column) -> Column:
    """Quarter octaves of the size: 0 for sizes up to 1, at most 160 in all."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 4).cast("int")


def class_weight(of_class: Column, power: float) -> Column:
    """What a document weighs when copies are allotted within its source: its class's least size to the power."""
    return F.pow(F.lit(2.0), of_class / F.lit(4.0) * F.lit(float(power)))


def expected_copies(sized: DataFrame, targets: DataFrame, power: float, most: float) -> DataFrame:
    """(source, __rate): documents of the source are each expected min(most, __rate * class_weight) times, which makes the
    source's expected words its target. From rows of (source, size); at most 160 sums a source meet in one task."""
    sums = sized.groupBy("source", size_class(F.col("size")).alias("__class")).agg(F.sum("size").cast("double").alias("__s"))
    held = sums.join(targets.select(F.col("source").alias("__src"), "target"), F.col("source").eqNullSafe(F.col("__src"))).withColumn("__weight", class_weight(F.col("__class"), power))
    down = Window.partitionBy("source").orderBy(F.col("__class").desc())  # the heaviest classes are the first to be held at `most`
    full = F.coalesce(F.sum(F.col("__s") * F.lit(float(most))).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum(F.col("__s") * F.col("__weight")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = held.withColumn("__rate", F.try_divide(F.greatest(F.col("target") - full, F.lit(0.0)), open_))
    fits = F.when(F.col("__rate") * F.col("__weight") <= F.lit(float(most)), F.struct(-F.col("__class"), "__rate"))
    found = rated.groupBy("source").agg(F.max("target").alias("__t"), F.min(fits)["__rate"].alias("__fit"), F.max(F.lit(float(most)) / F.col("__weight")).alias("__all"))
    return found.select("source", F.when(F.col("__t") > 0, F.coalesce("__fit", "__all")).otherwise(F.lit(0.0)).alias("__rate"))


def pareto_mix(docs: DataFrame, size: Column | None = None, seed: int = 20240, most: float = 2.0, power: float = 0.5, **shares) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies, inclusion and taken.

    Within a source, a document is expected `inclusion` times: in proportion to its size (that of its size class) to the
    power `power`, `most` times at most, so that the source's words are expected to be its target; with power 0 all are
    alike. Whole copies of that are certain. The fraction left, p, is the chance of one more copy: documents are ranked by
    (u / (1 - u)) / (p / (1 - p)), u a fixed hash of doc_id, text and seed, and taken in that order up to the document
    whose words bring the sum nearest to the source's target. So `taken` is a multiple of `size`, at most `most` times it,
    reruns agree, and a source misses its target by half a document at most. Rows equal in doc_id and text have one rank
    and are taken together, as if they were one document. Empty and null texts have size 0 and take 0. Very long texts are
    counted whole. An empty table gives an empty table. Other columns of docs pass through, but for those named like the results (in any case).

    Ranks are not sorted as a whole: sums over BINS equal parts of the rank find the part where a
    source's sum ends, the same again inside it, and only the rows of that last part are sorted.
    """
    size = word_count(F.col("text")) if size is None else size
    text_hash = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    sized = docs.withColumn("size", size).withColumn("__h", text_hash)
    small = cut(sized.select("source", "size", "__h"))

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("source", "__src")
        return rows.join(table, rows["source"].eqNullSafe(table["__src"]), "left").drop("__src")

    targets = cut(source_targets(small.select("source", "size"), most=most, **shares))
    targets = small_side(cut(joined(targets, expected_copies(small.select("source", "size"), targets, power, most))))

    def ranked(rows: DataFrame) -> DataFrame:
        """rows (size, __h, __rate, ...) with the expected copies, their whole and fractional part, the rank in 0..1 and its first bin."""
        copies = F.least(F.lit(float(most)), F.coalesce("__rate", F.lit(0.0)) * class_weight(size_class(F.col("size")), power))
        whole = F.least(F.floor(copies + F.lit(1e-12)), F.lit(int(most)))
        held = rows.withColumn("inclusion", copies).withColumn("__whole", whole).withColumn("__p", F.greatest(F.col("inclusion") - F.col("__whole"), F.lit(0.0)))
        u = (F.shiftrightunsigned("__h", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        x = u / (1 - u) * F.try_divide(1 - F.col("__p"), F.col("__p"))
        return held.withColumn("__r", F.coalesce(x / (1 + x), F.lit(1.0))).withColumn("__b1", F.least(F.floor(F.col("__r") * BINS), F.lit(BINS - 1)))

    def crossing(sums: DataFrame, column: str, base: Column) -> DataFrame:
        """Per source the first bin whose sum reaches the rest, and what comes before it."""
        w = Window.partitionBy("source").orderBy(column)
        reach = sums.withColumn("__to", base + F.sum("__s").over(w))
        return reach.where(F.col("__to") >= F.col("__rest")).groupBy("source").agg(F.min(F.struct(F.col(column), (F.col("__to") - F.col("__s")).alias("base"))).alias("__x"))

    every = ranked(joined(small, targets.select("source", "target", "__rate")))
    certain = every.groupBy("source", "target").agg(F.sum(F.col("__whole") * F.col("size")).alias("__certain"))
    rest = cut(certain.select("source", F.greatest(F.col("target") - F.col("__certain"), F.lit(0.0)).alias("__rest")))
    live = joined(every.where("size > 0 and __p > 0"), small_side(rest)).where("__rest > 0")
    first = crossing(live.groupBy("source", "__rest", "__b1").agg(F.sum("size").alias("__s")), "__b1", F.lit(0))
    first = cut(first.select("source", F.col("__x.__b1").alias("__c1"), F.col("__x.base").alias("__base1")))
    inner = joined(live, small_side(first)).where("__b1 = __c1").withColumn("__b2", F.least(F.floor((F.col("__r") * BINS - F.col("__b1")) * BINS), F.lit(BINS - 1)))
    second = crossing(inner.groupBy("source", "__rest", "__base1", "__b2").agg(F.sum("size").alias("__s")), "__b2", F.col("__base1"))
    second = cut(second.select("source", F.col("__x.__b2").alias("__c2"), F.col("__x.base").alias("__base2")))
    last = Window.partitionBy("source", "__c1", "__c2").orderBy("__r", "__h", "size")
    ended = (
        joined(inner, small_side(second)).where("__b2 = __c2")
        .withColumn("__n", F.row_number().over(last))
        .withColumn("__to", F.col("__base2") + F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("__to") - F.col("size") / 2 <= F.col("__rest"))
        .groupBy("source").agg(F.max(F.struct("__r", "__h", "size", "__n")).alias("__last"))
    )
    table = targets
    for part in (rest, first.drop("__base1"), second.drop("__base2"), cut(ended)):
        table = joined(table, part)
    table = small_side(cut(table))
    out = ranked(joined(sized, table))
    b2 = F.least(F.floor((F.col("__r") * BINS - F.col("__b1")) * BINS), F.lit(BINS - 1))
    here = F.struct("__b1", b2.alias("b2"))
    there = F.struct("__c1", F.col("__c2").alias("b2"))
    before = F.col("__c1").isNull() | (here < there)
    mine = F.struct("__r", "__h", "size")
    upto = (here == there) & F.col("__last").isNotNull() & (mine <= F.struct("__last.__r", "__last.__h", "__last.size"))
    more = ((F.col("__rest") > 0) & (F.col("__p") > 0) & F.coalesce(before | upto, F.lit(False))).cast("int")
    copies = F.least(F.col("__whole") + more, F.lit(int(most))).cast("int")
    return (
        out.withColumn("source_size", F.coalesce("source_size", F.lit(0)).cast("long"))
        .withColumn("copies", copies)
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .select(*others(docs, OUT), *OUT)
    )
