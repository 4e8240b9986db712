"""The journal as a stream: latest rows per key, kept in state and published per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.versions import VersionedTable


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream; each file is read once."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_stream(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last row of each key; rows that come late change nothing."""
    last = F.max(F.struct(order, *values)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.`{c}`").alias(c) for c in [order, *values]])


def publish_latest(stream: DataFrame, table: VersionedTable, key: str, checkpoint: str) -> None:
    """Run a stream over what is there now; each batch publishes a version of the table.

    A batch has the keys that it changes, and only these are merged. The batch number is part of the commit,
    which follows the version that was read: a batch that is delivered again after a failure, or by a second
    runner, is left out, so every batch counts once."""

    def batch(rows: DataFrame, number: int) -> None:
        held = table.latest()
        if held.notes.get("batch", -1) < number:
            table.merge(rows, key, {"batch": number}, held)

    query = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
