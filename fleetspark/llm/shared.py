"""Tables in the shared folder, row keys and joins that bear hot keys."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import new_folder

# White space is the ASCII kind throughout; words are the runs between.
WORD = r"[^\x20\x09-\x0D]+"

# A key is hot when it holds more than one row in so many; there can be no more hot keys than that.
HOT_SHARE = 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder, so that a lost executor does not take them along.

    It goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stands for a null id where ids are compared.
NO_ID = 2**63 - 1


def given(id_column: str) -> Column:
    """The id as it was given, null again where a stand-in was used."""
    return F.nullif(F.col(id_column), F.lit(NO_ID).cast("long"))


def row_key(id_column: str = "doc_id", text: str = "text") -> list:
    """`_id` and `_hash`, which identify a document by its id and its text. Both are never null."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
    ]


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with their place `rank` in this order, over all partitions. Only a count for each partition meets in one place."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sooner = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    parts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(sooner), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return placed.join(F.broadcast(parts), "_part").withColumn("rank", rank).drop("_part", "_at", "_before")


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with one record per key, safe for keys that hold a large share of the rows.

    `per_key` has the number of rows of each key in `count`. The keys with more than a thousandth of all rows, at most a
    thousand records, are broadcast; the others meet in a shuffle, where none is large. Nulls in the key find no partner.
    Both inputs are read twice, so pass written tables.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > total
    hot, cold = per_key.filter(is_hot), per_key.filter(~is_hot)
    hot_keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents that are not in `dropped`, a written table of `_id` and `_hash`. The columns stay as they are.

    It is a merge join at every size: what is dropped grows with the documents, so it is never broadcast.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *row_key())
    return keyed.join(dropped.select("_id", "_hash").hint("merge"), ["_id", "_hash"], "left_anti").select("_row.*")
