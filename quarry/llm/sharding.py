"""Sharding by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import cut, others, prefix_sums

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")

#: Bins over which rows of one shard or pool are spread for prefix sums.
BINS = 512

#: Lower bounds of the size classes in which unlinked documents fill what is left, largest first.
CLASSES = (65536, 16384, 4096, 1024, 0)


def _bin(seed: int) -> Column:
    return F.pmod(F.xxhash64("__h", "doc_id", F.lit(seed)), F.lit(BINS))


def _loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.sum("size").alias("load"))


def _room(spark, loads: DataFrame, shards: int, quota: float) -> DataFrame:
    """(shard, room) of every shard; at most `shards` rows."""
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(loads, "shard", "left").select("shard", F.greatest(F.lit(quota) - F.coalesce("load", F.lit(0)), F.lit(0.0)).alias("room"))


def propagate(linked: DataFrame, shards: int, quota: float, rounds: int) -> DataFrame:
    """linked (doc_id, __h, size, group, shard) with better shards: in each round, a document looks at how
    many members of its group each shard holds, and asks to move to the fullest one that has room. Requests
    are granted, largest gain first, until the shard's room is used. A shard stays under the quota.
    """
    spark = linked.sparkSession
    for i in range(rounds):
        held = linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        room = cut(_room(spark, _loads(linked), shards, quota))
        best = (
            held.join(F.broadcast(room), "shard")  # as many rows as shards
            .groupBy("group").agg(F.max(F.struct(F.when(F.col("room") > 0, F.col("n")).otherwise(0).alias("gain"), F.xxhash64("group", "shard").alias("t"), F.col("shard").alias("to"), "room")).alias("b"))
            .select(F.col("group").alias("__g"), "b.gain", "b.to", "b.room")
        )
        # a row for each group and shard that holds some of it; only then the documents, by both keys
        wish = held.join(best, F.col("group") == F.col("__g")).select(F.col("group").alias("__g2"), F.col("shard").alias("__s2"), "n", "gain", "to", "room")
        moves = (F.col("gain") > 0) & (F.col("gain") >= F.col("n")) & (F.col("to") != F.col("shard"))
        asked = linked.join(wish, (F.col("group") == F.col("__g2")) & (F.col("shard") == F.col("__s2")))
        asked = cut(asked.select("doc_id", "__h", "size", "group", "shard", "gain", "room", F.when(moves, F.col("to")).alias("to")))
        # bins put larger gains first: equal gains share a band of bins
        band = F.lit(40) - F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(40))
        moving = prefix_sums(asked.where("`to` is not null").withColumn("__bin", band * BINS + _bin(i)), ["to"], "__bin", [F.col("gain").desc(), "group", "__h", "doc_id"], F.col("size"), "__before")
        moved = moving.select("doc_id", "__h", "size", "group", F.when(F.col("__before") + F.col("size") <= F.col("room"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        stay = asked.where("`to` is null").select("doc_id", "__h", "size", "group", "shard")
        linked = cut(stay.unionByName(moved))
    return linked


def fill(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """rows with a shard each: laid end to end, they are cut where the shards' gaps (shard, gap), laid end to end, are cut."""
    total = gaps.agg(F.sum("gap")).first()[0] or 0.0
    need = rows.agg(F.sum("size")).first()[0] or 0
    scale = need / total if total > 0 else 0.0
    w = Window.orderBy("shard")
    ends = gaps.withColumn("hi", F.sum("gap").over(w) * F.lit(scale)).where("gap > 0")
    bounds = [(r["hi"], r["shard"]) for r in ends.orderBy("shard").collect()]  # as many as shards
    laid = prefix_sums(rows.withColumn("__bin", _bin(77)), [], "__bin", ["__h", "doc_id"], F.col("size"), "__before")
    if not bounds:
        return rows.withColumn("shard", F.lit(0))
    at = F.col("__before") + F.col("size") / 2
    shard = F.lit(bounds[-1][1])
    for hi, s in reversed(bounds[:-1]):
        shard = F.when(at < F.lit(hi), F.lit(s)).otherwise(shard)
    return laid.withColumn("shard", shard).drop("__before", "__bin")


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 4, slack: float = 0.9) -> DataFrame:
    """docs (doc_id, text, ...) with size, text_crc32, law, shard, slot and grown_shard.

    The law is `bytes`: sizes (UTF-8 bytes of the text and 16) are near equal over the shards. Linked
    documents are those of equal text. They start at shards by hash and move by label propagation; a
    shard's quota is `slack` times an equal part. A group larger than a quarter of that is first split by
    hash into parts of about that size, so that no shard has to hold a hot group whole. Unlinked documents
    have no edge that could be cut; they fill what is left, large ones first, so that the last, small ones
    even out the sizes. Linked documents beyond a shard's equal part would go with them.

    Null texts have size 16, crc32 0 and no links; empty texts are one group. Repeated rows are linked like
    other equal texts. With fewer documents than shards some shards are empty. Other columns pass through.
    slot counts from 0 in each shard without gaps. grown_shard is null under this law.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    raw = F.col("text").cast("binary")
    facts = {
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"),
        "text_crc32": F.coalesce(F.crc32(raw), F.lit(0)).cast("long"),
        "__h": F.xxhash64("text"),
    }
    kept = others(docs, OUT)
    rows = cut(docs.select(*[c for c in kept if c != "text"], *[e.alias(n) for n, e in facts.items()], F.when(F.col("text").isNotNull(), F.sha2(raw, 256)).alias("__key")))
    extra = [c for c in kept if c not in ("text", "doc_id")]
    total = rows.agg(F.sum("size")).first()[0] or 0
    even = total / shards
    groups = rows.where("__key is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).where("n > 1")
    groups = cut(groups.select(F.col("__key").alias("__gkey"), F.ceil(F.col("b") / F.lit(max(1.0, even * slack / 4))).alias("__parts")))
    marked = cut(rows.join(groups, F.col("__key") == F.col("__gkey"), "left").withColumn("group", F.when(F.col("__gkey").isNotNull(), F.xxhash64("__key", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("__parts"))))).select("doc_id", *extra, "size", "text_crc32", "__h", "group"))
    first = F.pmod(F.xxhash64("doc_id", "__h", F.lit(3)), F.lit(shards)).cast("int")
    linked = marked.where("group is not null").select("doc_id", "__h", "size", "group", first.alias("shard"))
    linked = propagate(cut(linked), shards, even * slack, rounds)
    # what hashing put beyond an equal part goes back to the pool
    over = prefix_sums(linked.withColumn("__bin", _bin(9)), ["shard"], "__bin", ["group", "__h", "doc_id"], F.col("size"), "__before")
    over = cut(over.select("doc_id", "__h", "size", F.when(F.col("__before") + F.col("size") <= F.lit(even), F.col("shard")).alias("shard")))
    placed = over.where("shard is not null")
    pool = cut(over.where("shard is null").select("doc_id", "__h", "size").unionByName(marked.where("group is null").select("doc_id", "__h", "size")))
    loads = _loads(placed)
    parts = [placed]
    for i, low in enumerate(CLASSES):
        now = pool.where(F.col("size") >= low) if i == 0 else pool.where((F.col("size") >= low) & (F.col("size") < CLASSES[i - 1]))
        filled = cut(fill(now, cut(_room(spark, loads, shards, even).withColumnRenamed("room", "gap"))).select("doc_id", "__h", "size", "shard"))
        parts.append(filled)
        loads = cut(loads.unionByName(_loads(filled)).groupBy("shard").agg(F.sum("load").alias("load")))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    slotted = prefix_sums(done.withColumn("__bin", _bin(13)), ["shard"], "__bin", ["doc_id", "__h"], F.lit(1), "slot")
    # equal rows (doc_id, text) are told apart by their number, so that each gets one place
    number = Window.partitionBy("doc_id", "__h").orderBy("shard", "slot")
    slotted = slotted.withColumn("__n", F.row_number().over(number)).select(F.col("doc_id").alias("__id"), F.col("__h").alias("__h2"), "__n", "shard", "slot")
    numbered = marked.withColumn("__m", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("size")))
    out = numbered.join(slotted, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__h").eqNullSafe(F.col("__h2")) & (F.col("__m") == F.col("__n")))
    return out.select("doc_id", *extra, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
