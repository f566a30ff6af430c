"""Approximate search by an inverted file: vectors are filed in cells, and a query looks into the cells nearest to it."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import materialised
from .search import TOP_K, _unit, candidates, ranked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The centroids are fitted on the vectors with the smallest hashes of their ids, so many at most.
SAMPLE = 20_000
ROUNDS = 10
CELLS = 16
# Cells that a vector is filed in, and that a query looks into.
COPIES = 2
PROBES = 8


def fit_cells(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by k-means on the sphere, from a bounded sample. There are fewer cells than asked for in small tables."""
    chosen = vectors.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding")
    rows = _unit([row.embedding for row in chosen.toLocalIterator()])
    centres = rows[:cells].copy()
    for _ in range(rounds if len(centres) else 0):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        moved = _unit(sums)
        centres = np.where((moved != 0).any(axis=1, keepdims=True), moved, centres)
    return centres


def nearest_cells(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """The rows once for each of the `most` cells nearest to their vector, with `cell`. Rows without a vector are left out."""
    most = min(most, len(centres))

    @F.pandas_udf("array<int>")
    def cells(embedding: pd.Series) -> pd.Series:
        near = _unit(embedding, centres.shape[1]) @ centres.T
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :most].astype(np.int32)))

    return rows.filter(F.col("embedding").isNotNull()).withColumn("cell", F.explode(cells("embedding")))


class InvertedFile:
    """A stored inverted file: a table with a folder for each cell, and the centroids beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        stored = spark.read.parquet(f"{path}/_centroids").orderBy("cell").collect()
        self.centres = np.array([row.centre for row in stored])

    @classmethod
    def write(cls, vectors: DataFrame, path: str, cells: int = CELLS, copies: int = COPIES, sample: int = SAMPLE) -> "InvertedFile":
        """Fits the cells and files every vector in the `copies` nearest. Columns besides `id` and `embedding` are kept.

        A hinted rebalance brings the rows of a cell together and splits a large cell over as many tasks as its size asks for.
        """
        spark = vectors.sparkSession
        centres = fit_cells(vectors, cells, sample)
        named = [(i, centre.tolist()) for i, centre in enumerate(centres)]
        filed = nearest_cells(vectors, centres, copies) if named else vectors.limit(0).withColumn("cell", F.lit(0))
        filed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        spark.createDataFrame(named, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/_centroids")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        """The filed vectors with their cells. Each is there once for every copy."""
        return self._spark.read.parquet(self._path)

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int = PROBES, filters: tuple[str, ...] = ()) -> DataFrame:
        """As `top_k_search`, over the `probes` cells nearest to each query; with as many probes as cells it is the exact search.

        Only the folders of the cells that any query looks into are read. Within them a query is scored against the whole
        cell, tile by tile, so a cell may be of any size.
        """
        if not len(self.centres):
            none = self._spark.createDataFrame([], "id bigint, embedding array<double>")
            return ranked(candidates(none, queries.select("query_id", "embedding"), k), k)
        asked = materialised(nearest_cells(queries, self.centres, probes))
        # At most one number for each cell.
        touched = [row.cell for row in asked.select("cell").distinct().collect()]
        filed = self.rows().filter(F.col("cell").isin(touched))
        return ranked(candidates(filed, asked, k, filters, ("cell",)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the queries, their exact neighbours, and the share of those that were found."""
    hit = found.select("query_id", "id").withColumn("found", F.lit(1))
    both = exact.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("neighbours"),
        F.try_divide(F.count("found").cast("double"), F.count(F.lit(1))).alias("recall"),
    )
