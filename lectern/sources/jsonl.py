"""Units from JSON Lines and journals of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.verify import hash_check


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, bytes) of the data files of a folder, by their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/data")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_units(rows: DataFrame, folder: str) -> None:
    """Write rows as JSON Lines, and a manifest with the digest of each file."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).write.text(f"{folder}/data", lineSep="\n")
    _digests(rows.sparkSession, folder).write.parquet(f"{folder}/manifest")


def altered_files(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, rule) of data files that are missing, changed, or in no manifest."""
    stored, now = spark.read.parquet(f"{folder}/manifest"), _digests(spark, folder)
    more = now.join(stored, "path", "left_anti").select(F.col("path").alias("subject"), F.lit("unknown").alias("rule"))
    return hash_check(stored, now).unionByName(more)


def read_checked(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """Rows that ``write_units`` has written; an error if any file was altered since."""
    first = altered_files(spark, folder).orderBy("subject").first()
    if first is not None:
        raise ValueError(f"{first['subject']}: {first['rule']}")
    return read_units(spark, f"{folder}/data", schema)


def read_units(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON Lines, parted at line feeds alone: other line ends may stand within strings.

    Each row has its raw line's digest beside it, to be compared with a stored one."""
    raw = spark.read.text(path, lineSep="\n").where(F.length("value") > 0)
    return raw.select(F.from_json("value", schema).alias("r"), F.sha2("value", 256).alias("row_sha256")).select("r.*", "row_sha256")


def read_journal(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Events of a journal, one JSON file each, in no order; sort by revision where order matters."""
    return spark.read.schema(schema).json(path, multiLine=True)
