"""Transactions on the knowledge journal: validation, optimistic commit, chained events, projections.

A transaction is validated as a whole by jobs that return what is wrong; only if nothing is, one event
file is published under the next revision. Publishing fails if that revision exists, so of two writers
with the same expected revision one wins and the other is told. All other tables are projections and
can be made again from the events.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.knowledge import violations
from lectern.operators.versions import Store
from lectern.session import materialize


class Conflict(Exception):
    """Another transaction came first, or the expected revision is no revision."""


#: How many broken rules an error names; all of them are in its frame.
NAMED = 100


class Invalid(Exception):
    """The transaction breaks rules. ``args[0]`` names the first of them as (subject, rule) for the message;
    ``problems`` is the frame of all, if a job has found them."""

    def __init__(self, named: list[tuple[str, str]], problems: DataFrame | None = None) -> None:
        super().__init__(named)
        self.problems = problems


def digest(event: dict) -> str:
    """SHA-256 of canonical JSON: sorted keys, nothing between, raw UTF-8."""
    return hashlib.sha256(json.dumps(event, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Journal:
    """Events as immutable files, one per revision, each with the digest of the one before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    def head(self) -> tuple[int, str | None]:
        """The last revision and its digest; revision 0 has none."""
        names = [n for n in self.store.names("events") if n.endswith(".json")]
        if not names:
            return 0, None
        held = json.loads(self.store.read(f"events/{names[-1]}"))
        return held["revision"], held["event_sha256"]

    def append(self, expected: int, model: str, payload: dict, problems: DataFrame | None = None) -> int:
        """Publish an event; returns its revision. Nothing is written unless every condition holds.

        problems: a frame of (subject, rule); the error carries it."""
        if isinstance(expected, bool) or not isinstance(expected, int):
            raise Conflict("the expected revision must be a whole number")
        if not isinstance(model, str) or not model.strip():
            raise Invalid([("transaction", "model")])
        if not any(payload.values()):
            raise Invalid([("transaction", "empty")])
        revision, before = self.head()
        if revision != expected:
            raise Conflict(f"revision is {revision}, not {expected}")
        if problems is not None:
            problems = materialize(problems.select("subject", "rule"), "problems")
            found = [tuple(r) for r in problems.orderBy("subject", "rule").limit(NAMED).collect()]
            if found:
                raise Invalid(found, problems)
        event = {**payload, "model": model, "revision": revision + 1, "previous_event_sha256": before}
        event["event_sha256"] = digest(event)
        try:
            self.store.publish(f"events/{revision + 1:08d}.json", json.dumps(event, ensure_ascii=False, sort_keys=True))
        except Exception as e:
            if f"{revision + 1:08d}.json" in self.store.names("events"):
                raise Conflict(f"revision {revision + 1} was published by another writer") from e
            raise
        return revision + 1

    def events(self) -> DataFrame:
        """(name, value) of all events, raw."""
        return self.spark.read.text(f"{self.store.path}/events", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")

    def links(self) -> DataFrame:
        """(name, revision, previous, claimed, actual) of all events: what each says of itself, and its digest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    event = json.loads(value)
                    claimed = event.pop("event_sha256", None)
                    out.append((name, event.get("revision"), event.get("previous_event_sha256"), claimed, digest(event)))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)], names=["name", "revision", "previous", "claimed", "actual"])

        return self.events().mapInArrow(run, "name string, revision bigint, previous string, claimed string, actual string")

    def violations(self) -> DataFrame:
        """(subject, rule) where the chain of revisions and digests doesn't hold. Each event is joined with the one
        before it by the number in its name, so no task walks the chain."""
        rows = materialize(self.links(), "links").withColumn("at", F.regexp_extract("name", r"^0*(\d+)\.json$", 1).cast("bigint"))
        before = rows.select((F.col("at") + 1).alias("at"), F.col("claimed").alias("before"), F.lit(True).alias("known"))
        rules = {
            "revision": (F.col("revision") != F.col("at")) | F.col("revision").isNull() | ((F.col("at") > 1) & F.col("known").isNull()),
            "previous digest": ~F.col("previous").eqNullSafe(F.col("before")),
            "digest": ~F.col("claimed").eqNullSafe(F.col("actual")),
        }
        return violations(rows.join(before, "at", "left"), F.col("name"), rules)

    def broken(self) -> list[tuple[str, str]]:
        """What ``violations`` finds, in order; for journals whose violations are few."""
        return sorted(tuple(r) for r in self.violations().collect()) if self.store.names("events") else []


def quote_violations(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(subject, rule) of evidence references (ref_id, unit_id, unit_fingerprint, start, end, quote).

    A reference names a live unit in its current version and a range of its text; the quote is that range."""
    now = units.select("unit_id", "text", "fingerprint", F.coalesce("retired", F.lit(False)).alias("retired"), F.lit(True).alias("known"))
    rows = refs.join(now, "unit_id", "left")
    size = F.length(F.coalesce("text", F.lit("")))
    in_range = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= size)
    rules = {
        "unit": F.col("known").isNull() | F.col("retired"),
        "fingerprint": F.col("known") & ~F.col("fingerprint").eqNullSafe(F.col("unit_fingerprint")),
        "range": F.col("known") & ~F.coalesce(in_range, F.lit(False)),
        "empty quote": F.col("known") & (size > 0) & (F.coalesce("quote", F.lit("")) == ""),
        "quote": in_range & (F.coalesce("quote", F.lit("")) != F.substring(F.coalesce("text", F.lit("")), F.col("start") + 1, F.col("end") - F.col("start"))),
    }
    return violations(rows, F.col("ref_id"), rules)


def view_violations(views: DataFrame, renditions: DataFrame) -> DataFrame:
    """(subject, rule) of visual readings (view_id, rendition_id, sha256, tool, observation)."""
    now = renditions.select("rendition_id", F.col("sha256").alias("now"), "role", F.lit(True).alias("known"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {"rendition": F.col("known").isNull() | ~F.col("sha256").eqNullSafe(F.col("now")), "icon": F.col("role") == "icon", "tool": blank("tool"), "observation": blank("observation")}
    return violations(views.join(now, "rendition_id", "left"), F.col("view_id"), rules)


def compact_views(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views stored once per event, and records that keep their ids.

    events: revision, record_id, view (a struct)."""
    named = events.withColumn("view_id", F.concat(F.lit("V"), F.substring(F.sha2(F.to_json(F.struct("revision", "view"), {"ignoreNullFields": "false"}), 256), 1, 24)))
    views = named.select("revision", "view_id", "view").dropDuplicates(["revision", "view_id"])
    return views, named.groupBy("revision", "record_id").agg(F.array_sort(F.collect_set("view_id")).alias("view_ids"))


def store_blobs(rows: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """Write contents as files named by their digest, each once, and return (path, sha256, bytes).

    A file appears whole or not at all; one that is there already is left."""
    distinct = rows.select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).where("content is not null").dropDuplicates(["sha256"])

    def write(batches):  # noqa: ANN001, ANN202
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        for b in batches:
            out = []
            for sha, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{base}/{sha}"
                if target.get_file_info(path).type == fs.FileType.NotFound:
                    temp = f"{base}/.{uuid.uuid4().hex}"
                    with target.open_output_stream(temp) as f:
                        f.write(data)
                    target.move(temp, path)
                out.append({"path": os.path.join(folder, sha), "sha256": sha, "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("sha256", pa.string()), ("bytes", pa.int64())]))

    return materialize(distinct.mapInArrow(write, "path string, sha256 string, bytes bigint"), "blobs")


def reading_text(paragraphs: DataFrame, order: list[str], key: str = "source_id") -> DataFrame:
    """(key, markdown): a reading rendition of each source; headings by their level, list paragraphs as items,
    signs that HTML would read are escaped."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line: Column = F.when(F.col("heading_level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), escaped)).when(F.col("num_id").isNotNull(), F.concat(F.lit("- "), escaped)).otherwise(escaped)
    held = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("lines"))
    return held.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("markdown"))
