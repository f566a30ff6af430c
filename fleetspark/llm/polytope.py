"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by a fast pseudo-rotation, three rounds of random signs and a Hadamard transform, and assigns each to
the nearest of the signed axes. A query looks into the buckets of its nearest few axes in every table, and what it meets there is
ranked by the exact inner product.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table, written
from .words import randoms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
# A recall of 0.9 and more by the tests, also of a few hundred vectors, whose nearest are far off, and of unlike lengths.
TABLES = 14
# A query looks into this share of a table's buckets.
PROBED = 1 / 16

# A pair of tiles is scored at once; a bucket of any size is cut into such.
VECTOR_TILE, QUERY_TILE = 4096, 1024
# Scores that are held at once.
SCORES = 1 << 20

_FOUND = "query_id long, vec_id long, score double"


def padded_size(dims: int) -> int:
    """The power of two that holds the vectors."""
    return 1 << (dims - 1).bit_length()


def turned(rows: np.ndarray, number: int) -> np.ndarray:
    """The rows under the pseudo-rotation of a table."""
    size = rows.shape[1]
    signs = np.where(randoms(3 * size, 1000 + number) >> np.uint64(63), 1.0, -1.0).reshape(3, size)
    for sign in signs:
        rows, reach = rows * sign, 1
        while reach < size:
            pairs = rows.reshape(len(rows), -1, 2, reach)
            rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(-1, size)
            reach *= 2
    return rows


def buckets(rows: np.ndarray, number: int, probes: int) -> np.ndarray:
    """The numbers of the nearest signed axes of each row in a table, the nearest first."""
    values = turned(rows, number)
    both = np.concatenate((values, -values), axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    some = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def _matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow column in double precision; a shorter one ends in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `embedding` of the vectors that take part: not null, not zero, all components finite."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    kind = own.schema["embedding"].dataType.elementType.typeName()
    if kind not in ("float", "double"):
        own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _hashed(rows: DataFrame, dims: int, tables: int, probed: float) -> DataFrame:
    """The rows with `keys`, their bucket in each table, and `probes`, the buckets that a query looks into (else null).

    Vectors are hashed at length one, so a bucket holds what lies in like directions, of any length.
    """
    size = padded_size(dims)
    most = max(1, round(2 * size * probed))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("embedding"), dims)
            # By the largest component first, so that no square overflows.
            own /= np.abs(own).max(axis=1, keepdims=True)
            rows = np.zeros((len(own), size))
            rows[:, :dims] = own / np.sqrt((own * own).sum(axis=1, keepdims=True))
            keys = [buckets(rows, t, 1) + t * 2 * size for t in range(tables)]
            asks = np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool))
            probes = [buckets(rows[asks], t, most) + t * 2 * size for t in range(tables)]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["keys"] = pa.array(list(np.concatenate(keys, axis=1).astype(np.int32)), pa.list_(pa.int32()))
            looked: list = [None] * len(own)
            for i, x in zip(asks.tolist(), np.concatenate(probes, axis=1).astype(np.int32)):
                looked[i] = x
            columns["probes"] = pa.array(looked, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(codes, f"vec_id long, embedding {kind}, row long, is_query boolean, keys array<int>, probes array<int>")


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, always added up in the same order, so that equal vectors tie."""
    return (queries * vectors).sum(axis=-1)


def _nearest(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, named: np.ndarray, k: int) -> list[tuple]:
    """Of each query, the places of the k nearest vectors but its own, and their exact inner products.

    A matrix product chooses a few more than k. Where it cannot tell the last of them from the next, all such are ranked.
    """
    scores = queries @ vectors.T
    scores[(own[:, None] == ids[None, :]) & named[None, :]] = -np.inf
    most = min(len(ids), k + 12)
    some = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most < len(ids) else np.tile(np.arange(most), (len(own), 1))
    least = np.take_along_axis(scores, some, axis=1).min(axis=1)
    reach = np.sqrt((queries * queries).sum(axis=1) * (vectors * vectors).sum(axis=1).max()) * 1e-12
    exact = _exact(queries[:, None, :], vectors[some])
    exact[np.isneginf(np.take_along_axis(scores, some, axis=1))] = -np.inf
    order_ids = np.where(named, ids, np.iinfo(np.int64).max)
    out = []
    for i in range(len(own)):
        places, values = some[i], exact[i]
        if most < len(ids) and np.partition(values, most - k)[most - k] <= least[i] + reach[i]:
            places = np.flatnonzero(scores[i] >= least[i] - 2 * reach[i])
            places = places[~np.isneginf(scores[i][places])]
            values = _exact(queries[i], vectors[places])
        best = np.lexsort((order_ids[places], -values))[:k]
        best = best[~np.isneginf(values[best])]
        out.append((places[best], values[best]))
    return out


def _scored(rows: DataFrame, per_key: DataFrame, dims: int, k: int) -> DataFrame:
    """For each query and pair of tiles, the k nearest vectors of the tile.

    `rows` has the vectors' `keys` and the queries' `probes`. The vectors of a bucket and the queries that look into it are
    cut into tiles by their numbers, each query tile meets each vector tile, and no bucket is large for a task.
    """

    def dealt(column: str, count: str, tile: int, name: str) -> DataFrame:
        own = rows.filter(F.col(column).isNotNull()).select("vec_id", "embedding", "row", F.explode(column).alias("key"))
        own = own.join(per_key, "key")
        return own.withColumn(name, F.pmod(F.xxhash64("row"), F.ceil(F.col(count) / tile)).cast("int"))

    vectors = dealt("keys", "n_vectors", VECTOR_TILE, "v")
    queries = dealt("probes", "n_queries", QUERY_TILE, "q")
    every_q = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_queries") / QUERY_TILE).cast("int") - 1)).alias("q")
    every_v = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_vectors") / VECTOR_TILE).cast("int") - 1)).alias("v")
    vectors = vectors.select("key", "v", every_q, "vec_id", "embedding")
    asked = [F.col(c).alias(name) for c, name in (("key", "ask_key"), ("v", "ask_v"), ("q", "ask_q"))]
    asked += [F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")]
    queries = queries.select("key", every_v, "q", "vec_id", "embedding").select(*asked)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        if not left.num_rows or not right.num_rows:
            return pa.schema(kinds).empty_table()
        ids = left.column("vec_id").combine_chunks()
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        own = right.column("query_id").to_numpy()
        x, y = _matrix(left.column("embedding"), dims), _matrix(right.column("asked"), dims)
        found: list[tuple] = []
        step = max(1, min(SCORES // len(x), SCORES // (dims * (k + 12))))
        for at in range(0, len(y), step):
            found += _nearest(numbers, x, y[at : at + step], own[at : at + step], named, k)
        sizes = [len(places) for places, _ in found]
        places = np.concatenate([p for p, _ in found]).astype(np.int64)
        columns = [np.repeat(own, sizes), ids.take(pa.array(places)), np.concatenate([v for _, v in found])]
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], pa.schema(kinds))

    met = queries.groupBy("ask_key", "ask_v", "ask_q")
    return vectors.groupBy("key", "v", "q").cogroup(met).applyInArrow(nearest, _FOUND)


def _counted(rows: DataFrame) -> DataFrame:
    """The vectors and queries of each bucket that has both. There are as many rows as buckets: two for each axis of each table."""
    vectors = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_vectors"))
    queries = rows.select(F.explode("probes").alias("key")).groupBy("key").agg(F.count("*").alias("n_queries"))
    return written(vectors.join(queries, "key"), "polytope-buckets")


def _ranks(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all tiles. A pair found in several tables has the same score in each, and one rank."""
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.dense_rank().over(nearest)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(
    vectors: DataFrame, is_query: str, k: int = K, tables: int = TABLES, probed: float = PROBED, exact: bool = False
) -> DataFrame:
    """query_id, rank, vec_id and score: the k vectors with the largest inner product for each row of which `is_query` is true.

    `vectors` has vec_id and embedding. Vectors that are null, zero or not wholly finite take no part. All others are
    candidates but those of the query's own id. Nearest first, ties by the smaller id, a null id last. A row without id is no
    query. Rows equal in id and vector count once; several vectors of one id are candidates each, and as queries their results
    are merged. Shorter vectors count as if they ended in zeros. An empty table gives an empty result. With `exact` every
    query is scored with every vector.

    Every vector lies in one bucket of each table. A query that finds fewer than k is scored with all
    vectors, so no result is short. Buckets are cut into tiles by the counts of their rows, and a tile passes
    on at most k for each query.
    """
    rows = usable(vectors).dropDuplicates().withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("is_query", F.coalesce(F.expr(is_query), F.lit(False)) & F.col("vec_id").isNotNull())
    rows = written(rows, "polytope-vectors")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    everything = F.array(F.lit(0))
    against_all = rows.withColumn("keys", everything).withColumn("probes", F.when(F.col("is_query"), everything))
    if exact:
        return _ranks(_scored(against_all, _counted(against_all), dims, k), k)
    hashed = written(_hashed(rows, dims, tables, probed), "polytope-hashed")
    found = written(_scored(hashed, _counted(hashed), dims, k), "polytope-found")
    ranked = written(_ranks(found, k), "polytope-ranked")
    enough = ranked.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = against_all.filter("is_query").join(enough, "vec_id", "left_anti").select("row")
    if short.isEmpty():
        return ranked
    short = written(short, "polytope-short").withColumn("_short", F.lit(True))
    again = against_all.join(short, "row", "left").withColumn("probes", F.when(F.col("_short"), everything))
    again = written(again.drop("_short"), "polytope-again")
    return _ranks(found.unionByName(_scored(again, _counted(again), dims, k)), k)


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.merge(found, on=["query_id", "vec_id"])
    return len(both) / len(exact) if len(exact) else 1.0


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
