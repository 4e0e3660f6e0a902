"""What driver and executors share: a folder, bounded broadcasts, and positions of rows without a window over all of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Where that is unset, a local one if driver and executors are one
    process (as in tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder through Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 100_000, chars: int = 4_000_000) -> DataFrame:
    """df, to be broadcast if it is measured to have at most so many rows, and characters in its strings; else as it is, for a shuffled join."""
    strings = [F.coalesce(F.length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    measured = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(strings, F.lit(0)).cast("long")).alias("c")).first()
    return F.broadcast(df) if measured["n"] <= rows and (measured["c"] or 0) <= chars else df


def spread(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """df dealt evenly to tasks of about so many rows, for work that is long beside the row's own size: a narrow table of millions of
    rows is a few splits of a file, so that without this a few tasks would do it all. Tasks grow in number as the table does.

    No filter is moved before the condition at the end, which always holds: a later filter on what is made from the rows, and with it
    the making, would else be done before the rows are dealt, by the few tasks that read the table."""
    parts = -(-df.count() // rows)
    return df.repartition(parts).where(F.spark_partition_id() >= 0) if parts > 1 else df


def once(made: Column) -> Column:
    """A column that is long in the making, as it is, to be made once a row. Spark would make it anew in each later filter and column that
    asks for it, but not if it hangs on the partition."""
    return F.when(F.spark_partition_id() >= 0, made)


def with_positions(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "position") -> DataFrame:
    """df with `out`: the row's place from 0 among the rows of the same keys, by `order` (nulls first), without gaps.

    Rows are dealt to ranges of keys and order, a key with most rows to many of them. Each range numbers its own rows, and the
    number of rows that a key has in earlier ranges (one row a range and key) is added. Rows that are equal in keys and order
    are numbered in any order, each once. The ranges are kept in the shared folder, so that they are the same in both
    passes, whatever executor is lost.
    """
    spark = df.sparkSession
    keys = list(keys)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64(*df.columns)
    ranged = df.withColumn("__tie", tie).repartitionByRange(parts, *keys, *order, "__tie").withColumn("__range", F.spark_partition_id())
    folder = shared_folder(spark, "positions")
    ranged.write.parquet(folder)
    ranged = spark.read.schema(ranged.schema).parquet(folder)
    counts = ranged.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__k{i}" for i in range(len(keys))]
    bases = counts.select(F.col("__range").alias("__r"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order, "__tie")) - 1
    on = F.col("__range") == F.col("__r")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    numbered = ranged.withColumn("__in", inside).join(bases, on)
    return numbered.select(*df.columns, (F.col("__base") + F.col("__in")).alias(out))


def total(values: Column) -> Column:
    """The sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
