"""Differences of snapshots, coverage of ranges, and checks that find what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots; equal rows are dropped in the join."""
    a = before.select(F.col(key).alias("ka"), F.col(digest).alias("da"))
    b = after.select(F.col(key).alias("kb"), F.col(digest).alias("db"))
    joined = a.join(b, F.col("ka") == F.col("kb"), "full_outer").where(F.col("ka").isNull() | F.col("kb").isNull() | ~F.col("da").eqNullSafe(F.col("db")))
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").otherwise("changed")
    return joined.select(F.coalesce("ka", "kb").alias(key), change.alias("change"))


def inventory_diff(before: DataFrame, after: DataFrame, owner: str, key: str, digest: str) -> DataFrame:
    """(owner, change): owners added, removed, or with any row added, removed or changed between two snapshots
    that hold each key once.

    Rows meet by owner and key, and each pair is compared; what is left per owner is flags, which combine
    before the shuffle, so an owner with many rows is no hot group."""
    rows = [s.select(owner, key, F.struct(F.col(digest).alias("digest")).alias("held"), F.lit(now).alias("now")) for s, now in ((before, False), (after, True))]
    pairs = rows[0].unionByName(rows[1]).groupBy(owner, key).agg(F.max(F.when(~F.col("now"), F.col("held"))).alias("a"), F.max(F.when(F.col("now"), F.col("held"))).alias("b"))
    owners = pairs.groupBy(owner).agg(F.bool_or(F.col("a").isNotNull()).alias("was"), F.bool_or(F.col("b").isNotNull()).alias("is"), F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))
    change = F.when(~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("changed")
    return owners.where("differs").select(owner, change.alias("change"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of distinct keys that one side alone has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other side doesn't have."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def range_coverage(ranges: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """(key, covered): whether half-open ranges cover [0, length) without a gap.

    A gap is a start beyond the greatest end before it."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.lit(0))
    marked = ranges.select(key, length, end, (F.col(start) > before).alias("gap"))
    return marked.groupBy(key).agg((~F.bool_or("gap") & (F.max(end) >= F.max(length))).alias("covered"))


def contiguous(spans: DataFrame, keys: list[str], start: str, end: str, length: str) -> DataFrame:
    """(keys, exact): whether spans part [0, length) exactly, none of them empty."""
    w = Window.partitionBy(*keys).orderBy(start)
    fits = (F.col(start) == F.coalesce(F.lag(end).over(w), F.lit(0))) & (F.col(end) > F.col(start))
    return spans.select(*keys, length, end, fits.alias("fits")).groupBy(*keys).agg((F.bool_and("fits") & (F.max(end) == F.max(length))).alias("exact"))


def inside(x: Column, y: Column, width: Column, height: Column, parent_width: Column, parent_height: Column) -> Column:
    """Whether a box is one and lies in its parent's frame."""
    return (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= parent_width) & (y + height <= parent_height)


def report(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check, subject) of all that checks found; each check is a frame with a subject."""
    out = None
    for name, rows in checks:
        part = rows.select(F.lit(name).alias("check"), F.col("subject").cast("string").alias("subject"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
