"""Session settings and the shared folder of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*", memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleanframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # wide profiles build hundreds of column expressions; recording a call site for each is slow
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's checkpoint folder, which all executors can reach.

    Only a local session may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="gleanframe-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, what: str, *by: str) -> DataFrame:
    """``frame`` written once below the shared folder, in folders of the columns ``by``, and read back.

    The files go when the application ends.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark, what)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    frame.write.partitionBy(*by).parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
