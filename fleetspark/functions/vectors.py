"""Vector columns of hashed words. Spark folds the texts, and the words of an Arrow batch are counted together."""

import hashlib
import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import explode_rows

# The counting function travels to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows and bytes of text that are counted in one step, which bounds the memory of a task. A longer text is a step of its own.
ROWS_PER_STEP = 4096
BYTES_PER_STEP = 1 << 23


def _spaced(text: Column) -> Column:
    """Lower-case runs of letters and digits, one blank between."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _buckets(text: Column, dims: int) -> Column:
    """The bucket of each word of the text: the first eight hex digits of its MD5, modulo the width."""
    words = F.filter(F.split(_spaced(text), " "), lambda word: word != "")
    return F.transform(words, lambda word: F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dims)


def _steps(texts: pa.Array) -> list[tuple[int, int]]:
    """First row and number of rows of each step."""
    sizes, steps, held = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), [], 0
    for row, size in enumerate(sizes):
        if not steps or steps[-1][1] == ROWS_PER_STEP or held + size > BYTES_PER_STEP:
            steps.append((row, 0))
            held = 0
        steps[-1] = (steps[-1][0], steps[-1][1] + 1)
        held += size
    return steps


def _unit_counts(spaced: pa.Array, dims: int, weights: np.ndarray | None) -> np.ndarray:
    """Unit vectors of the weighed counts of each text's buckets. A word of the step is hashed once."""
    words = pc.split_pattern(spaced, " ")
    rows = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    digests = b"".join([hashlib.md5(word, usedforsecurity=False).digest() for word in distinct])
    buckets = (np.frombuffer(digests, dtype=">u4")[::4] % dims).astype(np.int64)
    # The empty word of an empty text is left out.
    buckets[[place for place, word in enumerate(distinct) if not word]] = -1
    found = buckets[coded.indices.to_numpy(zero_copy_only=False)]
    places = (rows * dims + found)[found >= 0]
    values = np.bincount(places, minlength=len(words) * dims).reshape(len(words), dims).astype(np.float64)
    if weights is not None:
        values *= weights
    # Summed from left to right, so that weighed vectors too have one value.
    norms = np.sqrt(np.add.accumulate(values * values, axis=1)[:, -1:])
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0).astype(np.float32)


def hashed_vector(text: Column, dims: int = 256, weights: Sequence[float] | None = None) -> Column:
    """Unit vector of hashed word counts, over the whole text; a zero vector for text without words.

    It stands in where no embedding service is at hand. With `weights`, one for each bucket, counts are weighed first.
    """
    factors = None if weights is None else np.array([float(w) for w in weights])

    @F.arrow_udf("array<float>")
    def vectors(spaced: pa.Array) -> pa.Array:
        parts = [_unit_counts(spaced.slice(first, count), dims, factors).ravel() for first, count in _steps(spaced)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        ends = np.arange(len(spaced) + 1, dtype=np.int32) * dims
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return vectors(_spaced(text))


def inverse_frequencies(texts: DataFrame, text: str, dims: int = 256) -> list[float]:
    """How rare each bucket is: log((n + 1) / (texts with it + 1)), as weights for `hashed_vector`.

    One aggregation over all texts; `dims` counts and their total reach the driver.
    """
    rows = texts.select(F.array_distinct(_buckets(F.col(text), dims)).alias("found"))
    counts = explode_rows(rows, [], F.col("found"), "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    seen = {row["bucket"]: row["n"] for row in counts.collect()}
    total = texts.count() + 1
    return [math.log(total / (seen.get(place, 0) + 1)) for place in range(dims)]


def embed_hashed(
    chunks: DataFrame, dims: int = 256, content: str = "page_content", weights: Sequence[float] | None = None
) -> DataFrame:
    """Chunks with a hashed word-count `embedding`: the default embedder of the chunk index."""
    return chunks.withColumn("embedding", hashed_vector(F.col(content), dims, weights))
