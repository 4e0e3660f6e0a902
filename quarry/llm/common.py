"""Helpers shared by the operators: durable cuts of the lineage and prefix sums that no single task has to hold."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one if they are one
    process (local mode, as in tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the actions inside; they are put back afterwards."""
    names = {"cleanup": CLEANUP, "batch": BATCH}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for reference cycles, for loops that make millions of short-lived objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs a reread and not the lineage.

    Once the rows are kept, the shuffles that made them only take up disks and are removed. With `batch`, Python gets so many
    rows at once at most, which bounds its memory where rows are large.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with settings(spark, cleanup="true", **({"batch": str(batch)} if batch else {})):
        return df.select("*").checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sums(df: DataFrame, keys: Sequence[str], bin_column: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys that come before this one.

    The order is bin_column (a small number of bins), then `order`. Only sums of bins meet in one
    task; rows meet only those of their key and bin, so a key with a third of all rows is spread.
    """
    keys = list(keys)
    held = df.withColumn("__v", value)
    sums = held.groupBy(*keys, bin_column).agg(F.sum("__v").alias("__s"))
    over_bins = Window.partitionBy(*keys).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("__base", F.coalesce(F.sum("__s").over(over_bins), F.lit(0))).drop("__s")
    names = [f"__k{i}" for i in range(len(keys) + 1)]
    bases = bases.select(*[F.col(k).alias(n) for k, n in zip([*keys, bin_column], names, strict=True)], "__base")
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, bin_column], names, strict=True)]
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        held.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(bases, on, "left")
        .withColumn(out, F.coalesce(F.col("__base"), F.lit(0)) + F.col("__in"))
        .drop("__v", "__in", "__base", *names)
    )


def others(df: DataFrame, own: Sequence[str]) -> list[str]:
    """Columns of df that pass through an operator: those not named (in any case) like its own ones. Names with two leading underscores are reserved."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken and not c.startswith("__")]


def small_side(df: DataFrame, rows: int = 10_000, chars: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it is measured to have at most so many rows, and characters in its strings; else as it is, for a shuffled join."""
    strings = [F.coalesce(F.length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    measured = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(strings, F.lit(0)).cast("long")).alias("c")).first()
    return F.broadcast(df) if measured["n"] <= rows and (measured["c"] or 0) <= chars else df


class Recent(dict):
    """What a key makes, remembered in two generations: when the newer one is full it becomes the older one, and what is
    asked for again moves on. So frequent keys are never forgotten, and the cost of a miss does not grow with the input."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
