"""Incremental silver: new bronze batches as a stream, each micro-batch an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quantlake.sources.lake import Lake
from quantlake.specs import DatasetSpec


def follow_bronze(lake: Lake, spec: DatasetSpec, checkpoint: str) -> StreamingQuery:
    """Take in the bronze batches that have arrived, then stop; the checkpoint remembers them.

    Rows keep the stamps that bronze gave them, so several batches that waited together, in whatever order they are read,
    leave the newest row of each key.
    """
    path = f"{lake.root}/bronze/{spec.name}/*"
    schema = lake.spark.read.option("mergeSchema", "true").parquet(path).schema

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            lake.take_in(spec, batch)

    return lake.spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
