"""The persisted chunk index: a parquet table of id, content, metadata and embedding, in buckets of the id.

Beside the buckets lies a manifest of the batches that have been appended.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import materialised
from ..operators.search import new_chunks

# Folders of an index. An append reads the ids of those only that its chunks fall into.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Scan an index that was built before."""
    return spark.read.parquet(path).drop("bucket")


def appended_batches(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: `batch` and the number of `chunks` that it added. Hidden from a scan of the index by its name."""
    stored = _read_if_present(spark, f"{path}/_batches")
    return spark.createDataFrame([], "batch string, chunks bigint") if stored is None else stored


def stored_ids(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame | None:
    """Id and bucket of what the index holds in these buckets, or None without an index. Other buckets are not opened."""
    stored = _read_if_present(spark, path)
    return None if stored is None else stored.filter(F.col("bucket").isin(buckets)).select("id", "bucket")


def append_new_chunks(
    spark: SparkSession,
    chunks: DataFrame,
    path: str,
    embed: Callable[[DataFrame], DataFrame],
    batch: str | None = None,
) -> None:
    """Embed and append the chunks whose id is not in the index yet. Running it twice adds nothing.

    `embed` adds a column to each row. It comes after the last shuffle, so texts are dealt to the buckets and vectors stay where
    they are made. The shuffle that finds each id once serves the comparison with the stored ids as well.

    Of the stored table only the ids in the buckets that the chunks fall into are read, and only new chunks reach the embedding
    step. A `batch` that the manifest names already is passed over without reading either. One that was cut off before it
    reached the manifest is appended again, and adds what is missing.
    """
    if batch is not None and not appended_batches(spark, path).filter(F.col("batch") == batch).isEmpty():
        return
    arriving = materialised(chunks.withColumn("bucket", _bucket()))
    # At most one number for each bucket.
    touched = [row.bucket for row in arriving.select("bucket").distinct().collect()]
    fresh = new_chunks(arriving, stored_ids(spark, path, touched))
    fresh = materialised(fresh) if batch is not None else fresh
    # A bucket's rows go to one file where they are few, and to several where the size asks for it.
    embed(fresh.hint("rebalance", "bucket")).write.mode("append").partitionBy("bucket").parquet(path)
    if batch is not None:
        noted = fresh.agg(F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("chunks"))
        noted.coalesce(1).write.mode("append").parquet(f"{path}/_batches")


def build_if_absent(
    spark: SparkSession, chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Open the index, building it first when there is none."""
    if _read_if_present(spark, path) is None:
        append_new_chunks(spark, chunks, path, embed)
    return read_index(spark, path)
