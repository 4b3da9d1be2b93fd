"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanframe.session import shared_folder

#: A word is a run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column's name has, in any case of letters."""
    held = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in held:
            name += "_"
        found.append(name)
    return found


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder that all executors reach; it is deleted when the application ends."""
    folder = shared_folder(spark, what)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


#: Spark then deletes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, what: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: computed once, without lineage.

    The table replaces the shuffle files that made it, so these need not stay on the executors' disks.
    """
    spark = frame.sparkSession
    folder, before = new_folder(spark, what), spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    table_ = spark.read.schema(frame.schema).parquet(folder)
    table_.written_to = folder
    return table_


def discard(frame: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing will read again."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
