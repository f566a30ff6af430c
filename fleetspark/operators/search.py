"""The chunk index and top-k search over vectors."""

import itertools
import sys
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import materialised
from ..functions import cited_indices, explode_rows

# The scoring functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Relevance threshold, list length, and snippet length.
MIN_SCORE = 0.30
TOP_K = 5
SNIPPET = 200

# A tile scores at most some so many queries against so many vectors; both sides of a filter value are cut into tiles.
QUERIES_PER_TILE = 512
ROWS_PER_TILE = 50_000
# Rows scored in one step, which bounds the score matrix of a task: 4,096 x 512 scores of eight bytes, 16 MB.
ROWS_PER_STEP = 4096

# A filter value is common when it holds more than one row in so many, so there are at most as many common values.
COMMON = 1000


def new_chunks(chunks: DataFrame, stored: DataFrame | None, keys: Iterable[str] = ("id",)) -> DataFrame:
    """Chunks whose id is not stored yet, each id once. Of the stored table only the key columns are read."""
    keys = list(keys)
    once = chunks.dropDuplicates(["id"])
    return once if stored is None else once.join(stored.select(*keys), keys, "left_anti")


def _unit(rows: Iterable, width: int | None = None) -> np.ndarray:
    matrix = np.array([np.asarray(row, dtype=np.float64) for row in rows])
    if matrix.size == 0:
        return np.zeros((0, width or 0))
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_rows(queries: pd.DataFrame, unit_queries: np.ndarray, docs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of `docs` for every query, ties by id."""
    if docs.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "id": [], "raw_score": []})
    # Scores are ranked at the precision at which they are reported, so that ties fall to the id wherever they are scored.
    # Score and place in the order of ids make one integer key, which makes the choice of the k largest unique.
    steps = np.floor((unit_queries @ _unit(docs["embedding"]).T) * 1e4 + 0.5 + 1e-9).astype(np.int64)
    ids, count = docs["id"].to_numpy(), len(docs)
    place = np.empty(count, dtype=np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(count)
    keys = steps * count + (count - 1 - place)[None, :]
    if count > k:
        best = np.argpartition(keys, count - k, axis=1)[:, count - k :]
    else:
        best = np.broadcast_to(np.arange(count), keys.shape)
    rows = np.broadcast_to(np.arange(len(queries))[:, None], best.shape).ravel()
    best = best.ravel()
    asked = queries["query_id"].to_numpy()
    return pd.DataFrame(
        {
            "query_id": pd.Series(asked[rows], dtype=asked.dtype),
            "id": pd.Series(ids[best], dtype=ids.dtype),
            "raw_score": steps[rows, best] / 1e4,
        }
    )


def _merge(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    merged = pd.concat(frames, ignore_index=True)
    ordered = merged.sort_values(["query_id", "raw_score", "id"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("query_id", sort=False).head(k)


def _hit_schema(docs: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("raw_score", T.DoubleType()),
        ]
    )


def _value_key(names: tuple[str, ...]) -> Column:
    """The values of the named columns as one text; a null is left out, and so matches what leaves it out as well."""
    return F.to_json(F.struct(*[F.col(name).cast("string").alias(name) for name in names])) if names else F.lit("{}")


def _keys_of_rows(filters: tuple[str, ...], always: tuple[str, ...]) -> Column:
    """The key of a row under every choice of the filters that a query may make. A row's null value matches no choice."""
    choices = [always + c for n in range(len(filters) + 1) for c in itertools.combinations(filters, n)]
    keys = []
    for chosen in choices:
        present = [F.col(name).isNotNull() for name in chosen]
        whole = _value_key(chosen)
        keys.append(F.when(reduce(Column.__and__, present), whole) if present else whole)
    return F.array_compact(F.array(*keys))


def _in_tiles(counts: DataFrame, size: int, name: str) -> tuple[DataFrame, Column]:
    """How many tiles each key's rows are cut into: a table of the common keys, and the number for all others."""
    total = counts.agg(F.sum("n")).scalar()
    common = counts.filter(F.col("n") * COMMON > total).select("key", F.ceil(F.col("n") / size).alias(name))
    others = F.ceil(F.coalesce(total, F.lit(0)) / (COMMON * size))
    return common, F.greatest(others, F.lit(1).cast("bigint"))


def top_k_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    filters: Iterable[str] = (),
    rows_per_tile: int = ROWS_PER_TILE,
    queries_per_tile: int = QUERIES_PER_TILE,
) -> DataFrame:
    """The k nearest vectors of each query by cosine, with `rank` and `score`; ties fall to the smaller id.

    See `candidates`. The tables are read once for each side of a match and for the counts, so pass a stored table where the
    vectors take work to make.
    """
    return ranked(candidates(docs, queries, k, filters, (), rows_per_tile, queries_per_tile), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's candidates. A vector that was met in several places has one rank."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
    return (
        found.withColumn("rank", F.dense_rank().over(best_first))
        .filter(F.col("rank") <= k)
        .dropDuplicates(["query_id", "rank"])
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", F.col("raw_score").alias("score"))
    )


def candidates(
    docs: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    filters: Iterable[str] = (),
    always: Iterable[str] = (),
    rows_per_tile: int = ROWS_PER_TILE,
    queries_per_tile: int = QUERIES_PER_TILE,
) -> DataFrame:
    """The k nearest vectors of each query by cosine in each tile, with `raw_score`; ties fall to the smaller id.

    `docs` has `id` and `embedding`; `queries` has `query_id` and `embedding`. For each name in `filters` both have that
    column, and a query matches equal values only, or all values when its own is null. Names in `always` are such columns that
    no query leaves null. The search is exact: every query is scored against every vector that its filters leave. Fewer than
    k rows come back when fewer match.

    Vectors meet queries by an equi join on the values that a query asks for. Both sides of a value are cut into tiles, and
    each pair of tiles is scored on its own; k candidates per query and tile reach the final ranking. Numbers of tiles follow
    from the counts. The tables of common values have at most `COMMON` rows a side and are broadcast. All of it is lazy.
    """
    filters, always = tuple(filters), tuple(always)
    rows = docs.select("id", "embedding", *always, *filters).filter(F.col("embedding").isNotNull())
    asked = queries.select("query_id", "embedding", *always, *filters).filter(F.col("embedding").isNotNull())
    asked = asked.select("query_id", "embedding", _value_key(always + filters).alias("key"))
    keyed = rows.select("id", "embedding", F.explode(_keys_of_rows(filters, always)).alias("key"))
    query_counts = asked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    row_counts = rows.select(F.explode(_keys_of_rows(filters, always)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    row_counts = row_counts.join(query_counts.select("key"), "key", "left_semi")

    common_rows, other_slices = _in_tiles(row_counts, rows_per_tile, "slices")
    common_queries, other_blocks = _in_tiles(query_counts, queries_per_tile, "blocks")

    def tiled(side: DataFrame) -> DataFrame:
        return (
            side.join(F.broadcast(common_rows), "key", "left")
            .join(F.broadcast(common_queries), "key", "left")
            .withColumns({"slices": F.coalesce("slices", other_slices), "blocks": F.coalesce("blocks", other_blocks)})
        )

    # Vectors that no query asks for go before they are copied. Common values are kept by the broadcast table.
    is_common = F.broadcast(common_rows.select("key"))
    rare = keyed.join(is_common, "key", "left_anti").join(query_counts.select("key"), "key", "left_semi")
    wanted = keyed.join(is_common, "key", "left_semi").unionByName(rare)

    def numbered(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    spread_rows = tiled(wanted).select(
        "key", "id", "embedding", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"), numbered("blocks").alias("block")
    )
    spread_queries = tiled(asked).select(
        "key", "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), numbered("slices").alias("slice")
    )

    def score(tile_of_queries: pd.DataFrame, tile_of_rows: pd.DataFrame) -> pd.DataFrame:
        kept = pd.DataFrame({"query_id": [], "id": [], "raw_score": []})
        unit_queries = _unit(tile_of_queries["embedding"])
        for start in range(0, len(tile_of_rows), ROWS_PER_STEP):
            found = _best_rows(tile_of_queries, unit_queries, tile_of_rows.iloc[start : start + ROWS_PER_STEP], k)
            kept = found if kept.empty else _merge([kept, found], k)
        # Plain objects, as joined strings would be in several pieces.
        return kept.astype({"query_id": object, "id": object})

    tile = ["key", "block", "slice"]
    return spread_queries.groupBy(*tile).cogroup(spread_rows.groupBy(*tile)).applyInPandas(score, _hit_schema(docs, queries))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vector columns of the same row, in double; null when either is a zero vector."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def gate_error(best_score: Column, min_score: float = MIN_SCORE) -> Column:
    """Error of a search whose best score is missing or below the threshold; null when it is relevant."""
    return F.when(best_score.isNull(), "no documents retrieved").when(best_score < min_score, "low relevance")


def relevance_gate(queries: DataFrame, hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Best score per query, and an error when nothing was found or the best is below the threshold."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best_score"))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        "best_score",
        gate_error(F.col("best_score"), min_score).alias("error"),
        gate_error(F.col("best_score"), min_score).isNull().alias("passed"),
    )


def source_label(fault_code: Column, manufacturer: Column, model: Column, chunk_type: Column) -> Column:
    """Label of a chunk within a numbered context."""
    code = F.coalesce(F.when(fault_code != "", fault_code), F.lit("overview"))
    return F.concat(
        F.lit("OEM Manual | "),
        F.coalesce(manufacturer, F.lit("unknown")),
        F.lit(" "),
        F.coalesce(model, F.lit("")),
        F.lit(" | "),
        code,
        F.lit(" ("),
        F.coalesce(chunk_type, F.lit("")),
        F.lit(")"),
    )


def with_content(hits: DataFrame, docs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Hits with content and metadata of their chunks. Only the k hits per query take part in this join.

    The hits are stored first, so that the planner knows how few they are and leaves the contents of all other chunks in place.
    """
    return materialised(hits).join(docs.select("id", *columns), "id")


def numbered_context(hits: DataFrame, label: Column, content: str = "page_content") -> DataFrame:
    """One numbered context per query, with the number of its chunks and their best score.

    The list holds the k hits of a query, never more.
    """
    block = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), label, F.lit("\n"), F.col(content), F.lit("\n")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda item: item["block"]), "\n---\n").alias("context"),
        F.count(F.lit(1)).alias("chunks_used"),
        F.max("score").alias("best_score"),
    )


def cited_chunks(answers: DataFrame, hits: DataFrame, content: str = "page_content", snippet: int = SNIPPET) -> DataFrame:
    """Citation records of the hits that an answer cites by number."""
    cited = explode_rows(answers, ["query_id"], cited_indices(F.col("answer")), "rank")
    return hits.join(cited, ["query_id", "rank"], "left_semi").withColumn(
        "snippet", F.concat(F.substring(content, 1, snippet), F.lit("..."))
    )


def label_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector of each label, whatever the width of the vectors.

    Means are taken by label and place, so a label's vectors never meet in one row; a list holds as many means as a vector
    has places.
    """
    places = vectors.select(label, F.posexplode("embedding").alias("place", "x"))
    means = places.groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "mean")))
    return means.groupBy(label).agg(F.transform(ordered, lambda one: one["mean"]).alias("embedding"))
