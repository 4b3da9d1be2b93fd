"""Tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe import ROWID

# Tables whose key follows the order of the rows in the file, so that it is their row identity.
ROW_KEYS = {
    "customer": "c_custkey",
    "documents": "doc_id",
    "events": "event_id",
    "orders": "o_orderkey",
    "part": "p_partkey",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def identified(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its row identity column."""
    return table(spark, folder, name).withColumn(ROWID, F.col(ROW_KEYS[name]))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels where there are any: nulls, ties and a boolean column."""
    labels = table(spark, folder, "labels").select(
        "doc_id", "quality", (F.col("quality") == 1).alias("good")
    )
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(labels, "doc_id", "left")


JUDGED_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.quality = 1 AS good
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def judged_identified(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).withColumn(ROWID, F.col("doc_id"))
