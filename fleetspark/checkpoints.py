"""Materialised intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`, which the driver and all executors share.

    Where the session names none, as in tests, it is set to a folder below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named


def new_folder(spark: SparkSession, name: str, within: str | None = None) -> str:
    """A new path in `within`, or else in the shared folder. What is written there goes when the driver ends."""
    path = f"{within or checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owned = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    owned.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(owned)
    return path


def materialised(df: DataFrame, within: str | None = None) -> DataFrame:
    """The DataFrame as a parquet table in `within`, or else in the shared folder, written once and read back.

    It serves tables that several reports share: each report reads only the columns it needs, and the size of the table is
    known to the planner. The copy outlives the executors that made it and goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table", within)
    # The copy is written once and read a few times, so less to write is worth the time to compress.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
