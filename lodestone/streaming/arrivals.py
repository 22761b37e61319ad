"""New catalogue files as a stream: every micro-batch goes through the batch operators and is appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def append_each(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that writes work(batch) of each micro-batch to out/batch=n; a batch that is run again after a
    failure replaces what it wrote before, so every row arrives once."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
