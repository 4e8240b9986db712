"""Journal projections: latest rows, coverage of readings, staleness, closures, validation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key; rows are combined before the shuffle, so a key may have any number."""
    last = F.max(F.struct(*order, *values)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.`{c}`").alias(c) for c in [*order, *values]])


def history(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows superseded by a later one of their key, with their version from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("version", F.row_number().over(w)).withColumn("__next", F.lead(F.lit(1)).over(w))
    return numbered.where("__next = 1").drop("__next")


def versions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the version of their key, one more per transaction."""
    return rows.withColumn("version", F.dense_rank().over(Window.partitionBy(key).orderBy(*order)))


def chain_violations(rows: DataFrame, key: list[str], order: list[str], revision: str, digest: str, previous: str | None = None) -> DataFrame:
    """Rows of an ordered journal whose revision doesn't grow, that have no digest or that of another row, or (if
    rows name it) another previous digest than that of the row before."""
    w = Window.partitionBy(*key).orderBy(*order) if key else Window.orderBy(*order)  # a journal without key has one writer
    rule = F.when(F.col(digest).isNull(), "no digest").when(F.col("__before").isNotNull() & (F.col(revision) <= F.col("__before")), "revision doesn't grow").when(F.col("__same") == F.col(digest), "digest repeated")
    if previous is not None:
        rule = F.when(~F.col(previous).eqNullSafe(F.col("__same")), "previous digest").otherwise(rule)
    checked = rows.withColumn("__before", F.lag(revision).over(w)).withColumn("__same", F.lag(digest).over(w)).withColumn("rule", rule)
    return checked.where("rule is not null").drop("__before", "__same")


def coverage(units: DataFrame, readings: DataFrame, stages: list[str], blocked: Column) -> DataFrame:
    """(unit_id, stage, status) of every unit and stage.

    A reading of the current fingerprint gives its status; else a blocked unit is a gap; else one that was
    read before needs revalidation; else it is unread. readings: the latest row per unit and stage."""
    all_stages = units.select("unit_id", "fingerprint", blocked.alias("blocked"), F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    read = readings.select("unit_id", "stage", "unit_fingerprint", F.col("status").alias("read_status"))
    joined = all_stages.join(read, ["unit_id", "stage"], "left")
    status = F.when(F.col("unit_fingerprint") == F.col("fingerprint"), F.col("read_status")).when(F.col("blocked"), "gap").when(F.col("read_status").isNotNull(), "needs_revalidation").otherwise("unread")
    return joined.select("unit_id", "stage", status.alias("status"))


def stage_summary(covered: DataFrame) -> DataFrame:
    """Counts per stage, and whether it is complete."""
    pending = F.col("status").isin("unread", "needs_revalidation")
    counts = covered.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(~pending & (F.col("status") != "gap")).alias("actually_read"), F.count_if(F.col("status") == "gap").alias("gap"), F.count_if(pending).alias("unread_or_stale"))
    return counts.withColumn("accounted_for", F.col("actually_read") + F.col("gap")).withColumn("complete", F.col("unread_or_stale") == 0)


def next_batch(covered: DataFrame, stage: str, order: list[str], limit: int = 8) -> DataFrame:
    """The first ``limit`` pending units of a stage, with the number that remains after them."""
    pending = covered.where((F.col("stage") == stage) & F.col("status").isin("unread", "needs_revalidation"))
    total = pending.agg(F.count("*").alias("pending"))
    rows = pending.orderBy(*order).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("pending") - limit, F.lit(0))).drop("pending")  # total: one row


def closure(edges: DataFrame, start: DataFrame | None = None, every: int = 8) -> DataFrame:
    """(id, ancestor) of a graph (child, parent), the own id included; cycles end it.

    Semi-naive: each round joins only what the last one found, and leaves out what is known. Rounds are
    written to the shared folder, so lineage stays short and lost executors cost one round; what is known is
    written together every few rounds. It goes on until a round finds nothing, however deep the graph is."""
    edges = materialize(edges.select("child", "parent").distinct(), "edges")
    ids = start.select("id") if start is not None else edges.select(F.col("child").alias("id")).union(edges.select("parent"))
    known = fresh = materialize(ids.distinct().select("id", F.col("id").alias("ancestor")), "closure")
    for n in itertools.count(1):
        step = fresh.join(edges, fresh["ancestor"] == edges["child"]).select("id", F.col("parent").alias("ancestor")).distinct()
        fresh = materialize(step.join(known, ["id", "ancestor"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        if n % every == 0:
            known = materialize(known, "closure")


def spread(seeds: DataFrame, depends: DataFrame, every: int = 8) -> DataFrame:
    """(id, reason) for all that is stale: seeds (id, reason), and whatever depends (id, on) on stale things,
    to a fixed point; cycles end it. Each stale dependency is a reason of its own."""
    depends = materialize(depends.select("id", "on").distinct(), "depends")
    reasons = materialize(seeds.select("id", "reason").distinct(), "stale")
    fresh = reasons.select("id").distinct()
    stale = fresh
    for n in itertools.count(1):
        hit = depends.join(fresh.withColumnRenamed("id", "on"), "on").select("id", F.concat(F.lit("depends on "), F.col("on")).alias("reason"))
        hit = materialize(hit.distinct(), "stale")
        reasons = reasons.unionByName(hit)
        fresh = materialize(hit.select("id").distinct().join(stale, "id", "left_anti"), "stale")
        if fresh.isEmpty():
            return reasons.distinct()
        stale = stale.unionByName(fresh)
        if n % every == 0:
            stale, reasons = materialize(stale, "stale"), materialize(reasons, "stale")


def violations(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(subject, rule) for each rule that a row breaks; all rules are tested in one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(subject.alias("subject"), F.explode(broken).alias("rule")).distinct()
