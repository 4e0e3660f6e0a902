"""Continuous scanning: new files of a folder are turned into records as they come.

Records have ids made from their keys and an insert leaves out what is there, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.changes import insert_if_absent
from quarry.operators.store import Store
from quarry.plans.scan import ScanContext, extracted, records

FILE_SCHEMA = "path string, length long, content string"


def stream_files(store: Store, folder: str, ctx: ScanContext, checkpoint: str, terms: Sequence[str] = (), once: bool = True) -> StreamingQuery:
    """Follows a folder of Parquet files of (path, length, content) rows. With `once` it ends when what is there is done."""
    source = store.spark.readStream.schema(FILE_SCHEMA).parquet(folder)
    part = store.part(ctx.repository_name, ctx.branch)

    def add(batch: DataFrame, _: int) -> None:
        new = records(extracted(batch, terms), ctx)
        old = store.table("code_record", part)
        store.write("code_record", old.unionByName(insert_if_absent(old, new)), part)

    writer = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()

