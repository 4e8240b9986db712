from __future__ import annotations

from lectern.operators.versions import VersionedTable
from lectern.streaming.journal import latest_stream, publish_latest, stream_files

SCHEMA = "k string, n int, v string"


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    write = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).write.mode("append").parquet(folder)
    table = VersionedTable(spark, f"file://{tmp_path}/out")
    write(("a", 1, "x"), ("b", 1, "y"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        publish_latest(latest_stream(stream_files(spark, folder, schema), ["k"], "n", ["v"]), table, "k", f"file://{tmp_path}/check")
        return {(r["k"], r["v"]) for r in table.read().collect()}

    assert run() == {("a", "x"), ("b", "y")}
    write(("a", 3, "z"), ("b", 0, "late"), ("c", 1, "w"))
    assert run() == {("a", "z"), ("b", "y"), ("c", "w")}
    before = table.latest().version
    assert run() == {("a", "z"), ("b", "y"), ("c", "w")} and table.latest().version == before
