"""Queries that run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.versions import VersionedTable
from lectern.session import step_dir, table
from lectern.streaming.journal import latest_stream, publish_latest, stream_files


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, from a stream over the event files; the same as in batch."""
    schema = table(spark, d, "events").schema
    rows = stream_files(spark, d, schema, "events.parquet")
    base = f"{step_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = VersionedTable(spark, f"{base}/table")
    publish_latest(latest_stream(rows, ["user_id"], "ts", ["event_id", "event_type"]), out, "user_id", f"{base}/checkpoint")
    held = out.read()
    return held.select("user_id", "event_id", "event_type") if held is not None else table(spark, d, "events").select("user_id", "event_id", "event_type").where(F.lit(False))


QUERIES = {"stream_latest": stream_latest}
SQL = {"stream_latest": "select user_id, arg_max(event_id, ts) as event_id, arg_max(event_type, ts) as event_type from events group by 1"}
