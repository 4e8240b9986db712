"""The documents of the index and the graph of relationships between them.

Cases: retired units and stale records are in neither; an edge to itself is none; repeated edges count once;
an edge keeps its reason, so two reasons give two edges; null ends are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.index import both_ways
from lectern.operators.units import band_pairs


def index_documents(units: DataFrame, records: DataFrame, stale: DataFrame) -> DataFrame:
    """(id, type, kind, source_ids, name, body, section, metadata, locator, review_status) of all that is live.

    units: unit_id, kind, source_ids, text, section_path, metadata, locator, retired; records: id, kind,
    source_ids, name, body, scope, unknowns, review_status; stale: ids of records that don't hold."""
    text = lambda c: F.coalesce(c, F.lit(""))
    one = units.where("not retired").select(
        F.col("unit_id").alias("id"), F.lit("unit").alias("type"), "kind", "source_ids", F.lit("").alias("name"), text(F.col("text")).alias("body"),
        text(F.array_join("section_path", " > ")).alias("section"), text(F.col("metadata")).alias("metadata"), "locator", F.lit(None).cast("string").alias("review_status"),
    )
    two = records.join(stale.select("id").distinct(), "id", "left_anti").select(
        "id", F.lit("knowledge").alias("type"), "kind", "source_ids", text(F.col("name")).alias("name"), text(F.col("body")).alias("body"),
        text(F.col("scope")).alias("section"), text(F.array_join("unknowns", " ")).alias("metadata"), F.lit(None).cast(units.schema["locator"].dataType).alias("locator"), "review_status",
    )
    return one.unionByName(two)


def _edges(rows: DataFrame, a: str, b: str, reason: Column) -> DataFrame:
    return rows.select(F.col(a).alias("a"), F.col(b).alias("b"), reason.alias("reason")).where("a is not null and b is not null")


def attachment_places(attachments: DataFrame, units: DataFrame, reach: int = 2) -> DataFrame:
    """(hub, side, id): the places where something is attached, each with the units around it ('outer': at most
    ``reach`` paragraphs away in the same part) and those of what is attached ('inner').

    attachments: (occurrence_id, source_id, part, n, child_owner); units: (unit_id, owner_id, part, n). Every
    outer unit is related to every inner one; the place stands between them, so that this takes a row for
    each unit and not for each pair. The band is joined by equality."""
    hub = F.concat(F.lit("attachment_occurrence:"), "occurrence_id")
    around = units.select(F.col("unit_id").alias("id"), F.col("owner_id").alias("source_id"), "part", F.col("n").alias("__n"))
    outer = band_pairs(attachments, around, ["source_id", "part"], "n", "__n", reach).select(hub.alias("hub"), F.lit("outer").alias("side"), "id")
    inner = units.select(F.col("unit_id").alias("id"), F.col("owner_id").alias("child_owner")).join(attachments.select("occurrence_id", "child_owner"), "child_owner")
    return outer.unionByName(inner.select(hub.alias("hub"), F.lit("inner").alias("side"), "id")).distinct()


def graph(units: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """(a, b, reason) in both directions: units and the paragraph they are part of, records and the units
    they rest on, and records that are related. Attachments are places (``attachment_places``).

    units: (unit_id, parent_id), live ones; evidence: (id, unit_id); relations: (id, target_id, kind) of live
    records."""
    parts = [_edges(units, "unit_id", "parent_id", F.lit("paragraph_context")), _edges(evidence, "id", "unit_id", F.lit("claim_evidence"))]
    parts.append(_edges(relations, "id", "target_id", F.concat(F.lit("knowledge_relation:"), "kind")))
    return both_ways(reduce(DataFrame.unionByName, parts))


def neighbours(scored: DataFrame, edges: DataFrame, hubs: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, via, score): what one hop from scored rows leads to, with the best row that leads there. Through a
    place only the best row of each side is carried on."""
    best = F.max(F.struct("score", F.col("a").alias("via"))).alias("best")
    step = scored.select(F.col(key).alias("a"), "score").join(edges.select("a", "b").distinct(), "a").groupBy(F.col("b").alias(key)).agg(best)
    if hubs is not None:
        at = scored.select(F.col(key).alias("id"), "score").join(hubs, "id").groupBy("hub", "side").agg(F.max(F.struct("score", F.col("id").alias("via"))).alias("best"))
        other = at.withColumn("side", F.when(F.col("side") == "outer", "inner").otherwise("outer"))
        reached = other.join(hubs, ["hub", "side"]).where(F.col("id") != F.col("best.via")).select(F.col("id").alias(key), "best")
        step = step.unionByName(reached).groupBy(key).agg(F.max("best").alias("best"))
    return step.select(key, "best.via", "best.score")
