"""File arrival: the batch load as a stream. Each micro-batch of new extract files goes
through the same keyed append, so a repeated batch adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import append_new


def load_arrivals(spark: SparkSession, source: str, schema: str, target: str, table: str, order: list[str], checkpoint: str):
    """Start (with all files that are there, then stop) the load of Parquet extracts."""

    def load(batch: DataFrame, _: int) -> None:
        append_new(batch, target, table, order)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
