"""Checks of stored files and of the links between captured things, and receipts of what was read.

Every check gives the rows that don't fit, (subject, rule), by joins on equal keys; nothing is brought to the
driver. Cases: null ids are no subject; repeated rows give one finding; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.knowledge import violations


def duplicate_ids(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Ids that stand for more than one content."""
    held = rows.where(F.col(key).isNotNull()).select(key, content).distinct().groupBy(key).agg(F.count("*").alias("n"))
    return held.where("n > 1").select(F.col(key).cast("string").alias("subject"), F.lit("duplicate id").alias("rule"))


def hash_check(stored: DataFrame, files: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """What is stored (key, digest) against the digests of what is there: 'missing' or 'mismatch'."""
    now = files.select(F.col(key), F.col(digest).alias("__now"), F.lit(True).alias("__there")).distinct()
    rows = stored.where(F.col(key).isNotNull()).select(key, digest).distinct().join(now, key, "left")
    return violations(rows, F.col(key).cast("string"), {"missing": F.col("__there").isNull(), "mismatch": F.col("__there") & ~F.col(digest).eqNullSafe(F.col("__now"))})


def content_links(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Assets (asset_id, sha256, content_source_id, owner) whose content source (source_id, sha256, parents) is
    missing or has other content, or doesn't name the owner of the asset as a parent."""
    now = sources.select(F.col("source_id").alias("content_source_id"), F.col("sha256").alias("__sha"), "parents", F.lit(True).alias("__known"))
    rows = assets.where("content_source_id is not null").join(now, "content_source_id", "left")
    rules = {
        "content source": F.col("__known").isNull() | ~F.col("sha256").eqNullSafe(F.col("__sha")),
        "parent": F.col("__known") & F.col("sha256").eqNullSafe(F.col("__sha")) & ~F.coalesce(F.array_contains("parents", F.col("owner")), F.lit(False)),
    }
    return violations(rows, F.col("asset_id"), rules)


def cell_views(views: DataFrame, cells: DataFrame, place: list[str]) -> DataFrame:
    """Views of cells (view_id, place) whose cell isn't stored."""
    gone = views.where(F.col("view_id").isNotNull()).join(cells.select(*place).distinct(), place, "left_anti")
    return gone.select(F.col("view_id").alias("subject"), F.lit("cell").alias("rule")).distinct()


def receipts(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, receipt_id, n, digest): one receipt for each reading (keys) over its ranges (unit_id,
    unit_fingerprint, start, end), whatever their order.

    The digest is the exclusive or of the digests of the different ranges, which combines before the shuffle: a
    reading that a third of all ranges belong to is no hot group. The id follows from keys and digest."""
    columns = ["unit_id", "unit_fingerprint", "start", "end"]
    rows = ranges.select(*keys, *columns).distinct()
    own = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("bigint")
    made = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(own).alias("digest"))
    identity = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.col("n").cast("string"), F.col("digest").cast("string"))
    return made.withColumn("receipt_id", F.concat(F.lit("Q"), F.substring(F.sha2(identity, 256), 1, 32)))


def receipt_violations(claims: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Receipts that a reader shows (keys, receipt_id) against those that follow from the ranges."""
    now = receipts(ranges, keys).select(*keys, F.col("receipt_id").alias("__now"))
    rows = claims.join(now, keys, "left")
    shape = F.coalesce(F.col("receipt_id").rlike("^Q[0-9a-f]{32}$"), F.lit(False))
    return violations(rows, F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]), {"shape": ~shape, "unknown": F.col("__now").isNull(), "changed": shape & (F.col("receipt_id") != F.col("__now"))})
