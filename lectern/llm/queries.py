"""The queries of this subpackage, by name; each takes a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, consistent, encoding, packing, sentences, terms
from lectern.llm.sql import SQL
from lectern.session import table

try:
    import public_tokenizers

    FOLDER = public_tokenizers.path("").rstrip("/")
except Exception:  # the package is optional; the folder is a parameter of every operator
    FOLDER = "/opt/tokenizers"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark is not null").select("term", "mark")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.index_terms(table(spark, folder, "index_shards"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select("entry_no", "term", "n", "total", "z")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return terms.log_odds(terms.record_terms(table(spark, folder, "index_entries")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.own_terms(_scores(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_restored(spark, folder).select("source_id", "para_id").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_paragraphs(table(spark, folder, "sources"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return consistent.look_alike_pairs(table(spark, folder, "units"), table(spark, folder, "index_entries"), "unit_id", "text", "entry_id", "body")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"), bpe.read_vocabulary(f"{FOLDER}/byte_bpe_50k.tiktoken"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "reading_windows"), FOLDER)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of p7_pack are."""
    windows = table(spark, folder, "reading_windows").select("window_id", F.col("capacity_tokens").alias("capacity"))
    return packing.fill(p7_pack(spark, folder), windows)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return sentences.split_sentences(documents, sentences.fit(documents))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
