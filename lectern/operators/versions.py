"""Tables as immutable versions, and runs that take only what is new or changed.

A version is a manifest: the data files of the table and, for each, its deletion vectors (the positions
of rows that no longer hold, one set per version that removed some). Files are never changed; a new
version adds files, drops files or gives files a further vector, and is published by one atomic rename
that fails if another writer was first. A manifest names parts, which list files; a version writes only
the parts that it changes, so publishing costs what has changed. The difference of two versions follows
from their manifests alone: parts that both have aren't read, added files, removed files and new vectors
give the rows that came and went.

``run_once`` reads the version that the last output commit says it has processed, gives a function the
rows that changed since, and publishes output and processed version in one manifest, on the very output
version it started from. If another run was faster, nothing of this one is seen and it starts over from
what the other has left; so no record is taken twice or skipped. A run that fails before it publishes
leaves nothing visible and is repeated whole; one that fails after has been done.

Cases: a null key is kept as a value and matches itself; repeated snapshot rows of a key count once
(the greatest row); an empty snapshot removes all rows; extra columns are carried along.
"""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, ROW = "__file", "__row"
#: A manifest with more parts than this has its small ones put together by the next version.
MOST_PARTS = 64


class Overtaken(RuntimeError):
    """Another writer has published this version."""


class Store:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self.conf)

    def _path(self, p: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def publish(self, name: str, text: str) -> None:
        """Write a file that must not exist yet; it appears whole or not at all. If it does, ``Overtaken``."""
        target = self._path(f"{self.path}/{name}")
        temp = self._path(f"{self.path}/_temp/{uuid.uuid4().hex}")
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(temp, False)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(temp), self.fs.makeQualified(target), options)
        except Py4JJavaError as error:
            self.remove(temp.toString())
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Overtaken(name) from error
            raise


@dataclass
class Manifest:
    """One version: parts by name, each the data files with their deletion vectors (folders of file and row); and notes."""

    version: int
    parts: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    @property
    def files(self) -> dict[str, list[str]]:
        return {f: v for part in self.parts.values() for f, v in part.items()}


class VersionedTable:
    """A table of immutable versions in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self.path = self.store.path
        self._parts: dict[str, dict[str, list[str]]] = {}  # parts never change

    def latest(self) -> Manifest:
        """The newest version; version 0 is the empty table."""
        names = [n for n in self.store.names("manifests") if n.endswith(".json")]
        return self.version(int(names[-1][:-5])) if names else Manifest(0)

    def _part(self, name: str) -> dict[str, list[str]]:
        if name not in self._parts:
            self._parts[name] = json.loads(self.store.read(f"parts/{name}.json"))
        return self._parts[name]

    def version(self, number: int) -> Manifest:
        if number == 0:
            return Manifest(0)
        held = json.loads(self.store.read(f"manifests/{number:010d}.json"))
        return Manifest(held["version"], {n: self._part(n) for n in held["parts"]}, held["notes"])

    def _new_part(self, files: dict[str, list[str]]) -> dict[str, dict[str, list[str]]]:
        if not files:
            return {}
        name = uuid.uuid4().hex
        self.store.publish(f"parts/{name}.json", json.dumps(files, sort_keys=True))
        self._parts[name] = files
        return {name: files}

    def _publish(self, base: Manifest, parts: dict[str, dict[str, list[str]]], notes: dict) -> Manifest:
        """The version after ``base``; ``Overtaken`` if there is one already."""
        if len(parts) > MOST_PARTS:
            small = dict(sorted(parts.items(), key=lambda x: len(x[1]))[: MOST_PARTS // 2])
            parts = {n: p for n, p in parts.items() if n not in small} | self._new_part({f: v for p in small.values() for f, v in p.items()})
        made = Manifest(base.version + 1, parts, notes)
        self.store.publish(f"manifests/{made.version:010d}.json", json.dumps({"version": made.version, "parts": list(parts), "notes": notes}, sort_keys=True))
        return made

    def _write(self, df: DataFrame) -> list[str]:
        """New data files of ``df``."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        status = self.store.fs.listStatus(self.store._path(folder))
        return [x.getPath().toString() for x in status if x.getPath().getName().endswith(".parquet") and x.getLen() > 0]

    def append(self, df: DataFrame, notes: dict | None = None, base: Manifest | None = None) -> Manifest:
        """A version with the rows of ``df`` added, after ``base`` (default the newest)."""
        base = base or self.latest()
        added = self._write(df)
        try:
            return self._publish(base, base.parts | self._new_part({f: [] for f in added}), notes or {})
        except Overtaken:
            for f in {f.rpartition("/")[0] for f in added}:
                self.store.remove(f)
            raise

    def adopt(self, files: list[str], notes: dict | None = None) -> Manifest:
        """A version with existing Parquet files added as they are: a delivery isn't copied."""
        base = self.latest()
        known = base.files
        return self._publish(base, base.parts | self._new_part({f: [] for f in files if f not in known}), notes or {})

    def _files(self, files: dict[str, list[str]], schema=None) -> DataFrame:  # noqa: ANN001
        """Live rows of files, with their place."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        rows = reader.parquet(*files).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        vectors = sorted({v for held in files.values() for v in held})
        return rows.join(self.spark.read.parquet(*vectors), [FILE, ROW], "left_anti") if vectors else rows

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The rows of a version; None for the empty table."""
        manifest = manifest or self.latest()
        return self._files(manifest.files).drop(FILE, ROW) if manifest.files else None

    def put_snapshot(self, snapshot: DataFrame, key: str, notes: dict | None = None, base: Manifest | None = None) -> Manifest:
        """A version that holds exactly ``snapshot``, one row per key.

        Rows that stay as they are stay where they are; others get a deletion vector, new and changed
        rows go to new files. Both sides are joined on the key once; rows that stay are dropped in the
        join and never written."""
        base = base or self.latest()
        others, new = self._one_per_key(snapshot, key)
        if not base.files:
            return self.append(new.select(key, *[f"new.`{c}`" for c in others]), notes, base)
        both = self._placed(base, key, others).join(new, F.col("__key").eqNullSafe(F.col(key)), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
        return self._replace(base, both, key, others, notes)

    def merge(self, rows: DataFrame, key: str, notes: dict | None = None, base: Manifest | None = None) -> Manifest:
        """A version in which the rows of ``rows``, one per key, replace those with the same key; others stay
        untouched. Of the table only rows with these keys are joined."""
        base = base or self.latest()
        others, new = self._one_per_key(rows, key)
        if not base.files:
            return self.append(new.select(key, *[f"new.`{c}`" for c in others]), notes, base)
        both = new.join(self._placed(base, key, others), F.col("__key").eqNullSafe(F.col(key)), "left").where(~F.col("old").eqNullSafe(F.col("new")))
        return self._replace(base, both, key, others, notes)

    @staticmethod
    def _one_per_key(rows: DataFrame, key: str) -> tuple[list[str], DataFrame]:
        """The other columns, and (key, new): the greatest row of each key."""
        others = [c for c in rows.columns if c != key]
        return others, rows.groupBy(key).agg(F.max(F.struct(*others)).alias("new")) if others else rows.select(key, F.struct(F.lit(1)).alias("new")).distinct()

    def _placed(self, base: Manifest, key: str, others: list[str]) -> DataFrame:
        """(__key, old, place) of the live rows of a version."""
        return self._files(base.files).select(F.col(key).alias("__key"), F.struct(*others).alias("old") if others else F.struct(F.lit(1)).alias("old"), FILE, ROW)

    def _replace(self, base: Manifest, both: DataFrame, key: str, others: list[str], notes: dict | None) -> Manifest:
        """A version with the rows of ``both`` (key, new, place of the old row) replaced, added or removed."""
        folder = f"{self.path}/steps/{uuid.uuid4().hex}"
        both.select(F.col("new").isNotNull().alias("added"), key, "new", FILE, ROW).write.parquet(folder)
        both = self.spark.read.parquet(folder)
        added = self._write(both.where("added").select(key, *[f"new.`{c}`" for c in others]))
        gone = both.where(F.col(FILE).isNotNull()).select(FILE, ROW)
        touched = {r[0] for r in gone.select(FILE).distinct().collect()}  # files of the manifest, not rows
        parts = dict(base.parts)
        if touched:
            vector = f"{self.path}/deleted/{uuid.uuid4().hex}"
            gone.write.parquet(vector)
            hit = {n: p for n, p in parts.items() if not touched.isdisjoint(p)}
            parts = {n: p for n, p in parts.items() if n not in hit}
            for p in hit.values():  # only the parts with touched files are written again
                parts |= self._new_part({f: [*v, vector] if f in touched else v for f, v in p.items()})
        self.store.remove(folder)
        return self._publish(base, parts | self._new_part({f: [] for f in added}), notes or {})

    def compact(self) -> Manifest:
        """A version of the same rows without deletion vectors: their files are removed, new ones added."""
        base = self.latest()
        held = {f: v for f, v in base.files.items() if v}
        if not held:
            return base
        added = self._write(self._files(held).drop(FILE, ROW))
        parts: dict[str, dict[str, list[str]]] = {}
        for n, p in base.parts.items():
            parts |= {n: p} if held.keys().isdisjoint(p) else self._new_part({f: v for f, v in p.items() if not v})
        return self._publish(base, parts | self._new_part({f: [] for f in added}), base.notes)

    def changes(self, since: Manifest, until: Manifest) -> DataFrame | None:
        """(change, columns) of rows that came ('insert') or went ('delete') between two versions.

        Rows moved unchanged between files (by compaction) cancel out; files of both versions with the
        same deletion vectors aren't read."""
        own = {f: v for n, p in until.parts.items() if n not in since.parts for f, v in p.items()}
        before = {f: v for n, p in since.parts.items() if n not in until.parts for f, v in p.items()}
        came = {f: v for f, v in own.items() if f not in before}
        left = {f: v for f, v in before.items() if f not in own}
        grown = {f: (before[f], v) for f, v in own.items() if f in before and before[f] != v}
        parts = []
        if came:
            parts.append(self._files(came).drop(FILE, ROW).withColumn("change", F.lit("insert")))
        if left:
            parts.append(self._files(left).drop(FILE, ROW).withColumn("change", F.lit("delete")))
        if grown:
            lost = self.spark.read.parquet(*sorted({v for a, b in grown.values() for v in b if v not in a}))
            rows = self._files({f: [] for f in grown})
            parts.append(rows.join(lost, [FILE, ROW], "left_semi").drop(FILE, ROW).withColumn("change", F.lit("delete")))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        columns = [c for c in out.columns if c != "change"]
        if left and came:
            sign = F.sum(F.when(F.col("change") == "insert", 1).otherwise(-1)).alias("__n")
            net = out.groupBy(*columns).agg(sign).where("__n <> 0")
            out = net.select(F.when(F.col("__n") > 0, "insert").otherwise("delete").alias("change"), *columns, F.explode(F.sequence(F.lit(1), F.abs("__n"))).alias("__i")).drop("__i")
        return out.select("change", *columns)


def run_once(source: VersionedTable, output: VersionedTable, work: Callable[..., DataFrame]) -> Manifest | None:
    """Process what changed in ``source`` since the last output commit; None if nothing did.

    ``work`` gets the changed rows, and the output as it was if it takes a second argument. The processed
    version is part of the commit, which follows the output version that was read: if another run
    commits first, this one starts over from there."""
    with_output = len(inspect.signature(work).parameters) > 1
    while True:
        done = output.latest()
        since = source.version(done.notes.get("processed", 0))
        until = source.latest()
        if since.version == until.version:
            return None
        changed = source.changes(since, until)
        try:
            if changed is None:
                return output._publish(done, done.parts, {"processed": until.version})
            made = work(changed, output.read(done)) if with_output else work(changed)
            return output.append(made, {"processed": until.version}, done)
        except Overtaken:
            continue


def current_units(units: DataFrame) -> DataFrame:
    """(unit_id, fingerprint, retired) of each unit's row with the highest revision; rows without a
    fingerprint don't count. Of rows with the same revision the later one holds."""
    rows = units.where("unit_id is not null and fingerprint is not null")
    last = rows.groupBy("unit_id").agg(F.max(F.struct("revision", "arrived_at", "fingerprint", F.coalesce("retired", F.lit(False)).alias("retired"))).alias("last"))
    return last.select("unit_id", "last.fingerprint", "last.retired")


def taken_units(readings: DataFrame, runs: DataFrame) -> DataFrame:
    """(unit_id, fingerprint) that successful attempts took last; the run table is of a fixed size."""
    good = F.broadcast(runs.where("status = 'succeeded'").select("run_no", "attempt").distinct())
    rows = readings.where("unit_id is not null").join(good, ["run_no", "attempt"])
    last = rows.groupBy("unit_id").agg(F.max(F.struct("run_no", "noted_at", F.col("unit_fingerprint").alias("fingerprint"))).alias("last"))
    return last.select("unit_id", "last.fingerprint")


#: What the output of runs over units holds: the current version as known, what was taken of it last, and
#: whether the run that wrote the row handed it out. seen orders the rows of a unit.
TAKEN = "unit_id string, revision bigint, arrived_at timestamp, fingerprint string, retired boolean, taken string, due boolean, seen bigint"


def take_units(changed: DataFrame, before: DataFrame | None) -> DataFrame:
    """Rows of ``TAKEN`` for the units of changed rows: what is current now, and whether it is due.

    A late row with a lower revision doesn't replace a current one that an earlier run has seen."""
    rows = changed.where("change = 'insert' and unit_id is not null and fingerprint is not null")
    version = F.struct("revision", "arrived_at", "fingerprint", F.coalesce("retired", F.lit(False)).alias("retired"))
    now = rows.groupBy("unit_id").agg(F.max(version).alias("now"))
    if before is None:
        before = changed.sparkSession.createDataFrame([], TAKEN)
    old = before.groupBy("unit_id").agg(F.max(F.struct("seen", "revision", "arrived_at", "fingerprint", "retired", "taken")).alias("old"))
    both = now.join(old, "unit_id", "left")
    last = F.when(F.col("old.revision").isNull(), F.col("now")).otherwise(F.greatest(F.col("now"), F.struct(*[F.col(f"old.{c}").alias(c) for c in ("revision", "arrived_at", "fingerprint", "retired")])))
    both = both.select("unit_id", last.alias("v"), F.col("old.taken").alias("taken"), F.coalesce("old.seen", F.lit(0)).alias("seen"))
    due = ~F.col("v.retired") & ~F.col("v.fingerprint").eqNullSafe(F.col("taken"))
    return both.select("unit_id", "v.*", F.when(due, F.col("v.fingerprint")).otherwise(F.col("taken")).alias("taken"), due.alias("due"), (F.col("seen") + 1).alias("seen"))


def start_taken(output: VersionedTable, readings: DataFrame, runs: DataFrame) -> Manifest:
    """The first version of an output: what successful attempts took before there was one."""
    known = taken_units(readings, runs)
    nothing = {"revision": "bigint", "arrived_at": "timestamp", "retired": "boolean"}
    rows = known.select("unit_id", F.col("fingerprint").alias("taken"), F.lit(None).cast("string").alias("fingerprint"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit(False).alias("due"), F.lit(0).cast("bigint").alias("seen"))
    return output.append(rows.select(*[c.split()[0] for c in TAKEN.split(", ")]))


def next_units(units: DataFrame | list[str], readings: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """(unit_id, fingerprint) for the next run: units added or changed since a successful run took them.

    ``units`` are deliveries: files, which are adopted as they are, or rows. ``folder`` keeps deliveries
    and output between calls; a call reads only the files that came since the last one."""
    spark = readings.sparkSession
    source, output = VersionedTable(spark, f"{folder}/deliveries"), VersionedTable(spark, f"{folder}/taken")
    source.adopt(units) if isinstance(units, list) else source.append(units)
    before = output.latest()
    if not before.version:
        before = start_taken(output, readings, runs)
    made = run_once(source, output, take_units)
    came = output.changes(before, made) if made is not None else None
    if came is None:
        return spark.createDataFrame([], "unit_id string, fingerprint string")
    return came.where("due").select("unit_id", "fingerprint")
