"""The journal folded into what holds now: units, records with their history, readings, staleness, coverage.

A fold over events in order keeps the last word on each key. Here each kind of event is a frame with the
revision of its event, and the last word is the greatest row of a key, so that the fold is one aggregation
per kind that combines before the shuffle; the events are never walked one by one.

Within one event units are retired first, then defined; readings are noted first, then called for again.

Cases: events may come in any order and repeatedly; a unit that is retired before it is defined is as if it
had never been; rows with a null key are left out; empty frames give empty states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.knowledge import latest, spread
from lectern.session import materialize


def units_now(definitions: DataFrame, retirements: DataFrame) -> DataFrame:
    """The last definition (unit_id, revision, others) of each unit, and whether it was retired after it.

    retirements: (unit_id, revision)."""
    others = [c for c in definitions.columns if c not in ("unit_id", "revision")]
    last = latest(definitions.where("unit_id is not null"), ["unit_id"], ["revision"], others)
    gone = retirements.where("unit_id is not null").groupBy("unit_id").agg(F.max("revision").alias("__gone"))
    return last.join(gone, "unit_id", "left").withColumn("retired", F.coalesce(F.col("__gone") > F.col("revision"), F.lit(False))).drop("__gone")


def records_now(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last version of each record (id, revision, version, others), and those before it."""
    others = [c for c in records.columns if c not in ("id", "revision", "version")]
    rows = records.where("id is not null").distinct()
    last = latest(rows, ["id"], ["revision", "version"], others)
    top = last.select("id", F.col("revision").alias("__revision"), F.col("version").alias("__version"))
    history = rows.join(top, "id").where((F.col("revision") != F.col("__revision")) | (F.col("version") != F.col("__version"))).drop("__revision", "__version")
    return last, history


def reading_state(reads: DataFrame, again: DataFrame) -> DataFrame:
    """The last reading of each unit and stage (unit_id, stage, revision, others), and whether it was called for
    again since; again: (unit_id, stage, revision)."""
    others = [c for c in reads.columns if c not in ("unit_id", "stage", "revision")]
    last = latest(reads.where("unit_id is not null and stage is not null"), ["unit_id", "stage"], ["revision"], others)
    asked = again.groupBy("unit_id", "stage").agg(F.max("revision").alias("__asked"))
    return last.join(asked, ["unit_id", "stage"], "left").withColumn("recheck", F.coalesce(F.col("__asked") >= F.col("revision"), F.lit(False))).drop("__asked")


def broken_dependencies(depends: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of (..., on, version) whose record is missing or has another version."""
    now = records.select(F.col("id").alias("on"), F.col("version").alias("__now"))
    return depends.join(now, "on", "left").where(~F.col("version").eqNullSafe(F.col("__now"))).drop("__now")


def stale_reasons(records: DataFrame, units: DataFrame, evidence: DataFrame, sources: DataFrame, depends: DataFrame, rechecks: DataFrame) -> DataFrame:
    """(id, reason) of records that don't hold any more, each reason once.

    evidence: (id, unit_id, unit_fingerprint); sources: (id, source_id, held), whether the source is as it
    was; depends: (id, on, version); rechecks: (id, version, reason). Whatever depends on a stale record is stale."""
    live = units.where("not retired").select("unit_id", F.col("fingerprint").alias("__now"))
    refs = evidence.join(live, "unit_id", "left").where(~F.coalesce(F.col("unit_fingerprint") == F.col("__now"), F.lit(False)))
    say = lambda rows, what, c: rows.select("id", F.concat(F.lit(what), F.col(c)).alias("reason"))
    asked = rechecks.join(records.select("id", "version"), ["id", "version"], "left_semi").select("id", "reason")
    seeds = say(refs, "unit changed or missing: ", "unit_id").unionByName(say(sources.where("not held"), "source changed or missing: ", "source_id"))
    seeds = seeds.unionByName(say(broken_dependencies(depends, records), "revised: ", "on")).unionByName(asked)
    known = records.select("id")
    return spread(seeds.join(known, "id", "left_semi"), depends.select("id", "on").join(known, "id", "left_semi"))


def coverage(units: DataFrame, reads: DataFrame, bound: DataFrame, records: DataFrame, stale: DataFrame, stages: list[str], blocked: Column) -> DataFrame:
    """(unit_id, stage, status, reasons) of every live required unit and stage.

    A reading of the current fingerprint gives its status, unless it was called for again or knowledge that it
    is bound to (unit_id, stage, on, version) is revised, missing or stale; then, as after a change of the
    unit, it needs revalidation. Without a reading a blocked unit is a gap, any other unread."""
    wanted = units.where(F.col("required") & ~F.col("retired")).select("unit_id", "fingerprint", blocked.alias("blocked"), F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    unsound = broken_dependencies(bound, records).select("unit_id", "stage", "on").unionByName(bound.join(stale.select(F.col("id").alias("on")).distinct(), "on", "left_semi").select("unit_id", "stage", "on"))
    unsound = unsound.groupBy("unit_id", "stage").agg(F.array_sort(F.collect_set("on")).alias("unsound"))
    rows = wanted.join(reads.select("unit_id", "stage", "unit_fingerprint", F.col("status").alias("read"), "recheck"), ["unit_id", "stage"], "left").join(unsound, ["unit_id", "stage"], "left")
    current = F.col("unit_fingerprint") == F.col("fingerprint")
    reasons = F.concat(F.when(F.col("recheck"), F.array(F.lit("called for again"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("unsound", lambda x: F.concat(F.lit("bound knowledge: "), x)), F.array().cast("array<string>")))
    again = F.coalesce(current, F.lit(False)) & (F.size(reasons) > 0)
    status = F.when(again, "needs_revalidation").when(current, F.col("read")).when(F.col("blocked"), "gap").when(F.col("read").isNotNull(), "needs_revalidation").otherwise("unread")
    return rows.select("unit_id", "stage", status.alias("status"), F.when(again, F.array_join(reasons, "; ")).alias("reasons"))


@dataclass
class Events:
    """The frames of a journal, by kind of event; columns as the functions of this module say."""

    definitions: DataFrame
    retirements: DataFrame
    records: DataFrame
    reads: DataFrame
    reads_again: DataFrame
    evidence: DataFrame
    sources: DataFrame
    depends: DataFrame
    rechecks: DataFrame
    bound: DataFrame


@dataclass
class State:
    """What holds after all events."""

    units: DataFrame
    records: DataFrame
    history: DataFrame
    reads: DataFrame
    stale: DataFrame
    coverage: DataFrame


def replay(events: Events, stages: list[str], blocked: Column) -> State:
    """The state after all events. Units, records and readings are written once, as several parts read them."""
    units = materialize(units_now(events.definitions, events.retirements), "units")
    records, history = records_now(events.records)
    records = materialize(records, "records")
    reads = materialize(reading_state(events.reads, events.reads_again), "reads")
    stale = materialize(stale_reasons(records, units, events.evidence, events.sources, events.depends, events.rechecks), "stale")
    return State(units, records, history, reads, stale, coverage(units, reads, events.bound, records, stale, stages, blocked))


def save(state: State, folder: str, signature: str) -> None:
    """Write a state as a checkpoint of the journal with this signature; it counts once all of it is there."""
    from lectern.operators.versions import Store

    spark = state.units.sparkSession
    for name in State.__dataclass_fields__:
        getattr(state, name).write.mode("overwrite").parquet(f"{folder}/{signature}/{name}")
    store = Store(spark, folder)
    if f"{signature}.json" not in store.names("states"):
        store.publish(f"states/{signature}.json", "{}")


def load(spark, folder: str, signature: str) -> State | None:  # noqa: ANN001
    """The checkpoint of a signature; None if there is none, so that the journal is replayed."""
    from lectern.operators.versions import Store

    if f"{signature}.json" not in Store(spark, folder).names("states"):
        return None
    return State(**{name: spark.read.parquet(f"{folder}/{signature}/{name}") for name in State.__dataclass_fields__})
