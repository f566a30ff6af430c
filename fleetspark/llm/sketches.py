"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of the shingles. Sketches of parts merge into the sketch of the whole, and two of
them estimate resemblance, containment and the number of distinct shingles.
"""

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import NO_ID, ranked, table
from .words import mixed, shingles_of, slices, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 128
SHINGLE_WORDS = 5

_SPACE = 2.0**64


def sketches_of(texts: pa.Array, k: int = K, shingle_words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sketch of each text, sorted. A text of fewer words is one shingle; one without words has an empty sketch."""
    words = words_of(texts, seed=7)
    hashed, whole = shingles_of(words, shingle_words, seed=70)
    out = []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = last - first - shingle_words + 1
        if n > 0:
            own = hashed[first : first + n]
            if n > 4 * k:
                # Repeats may leave too few distinct ones among the smallest; then all are looked at.
                some = np.unique(own[np.argpartition(own, 2 * k)[: 2 * k]])
                own = some if len(some) >= k else own
            out.append(np.unique(own)[:k])
        elif last > first:
            factors = np.arange(1, last - first + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            out.append(mixed((words.hash[first:last] * factors).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the sketches stand for."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _SPACE / (float(sketch[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in the union; exact when both sets are small. Two empty texts are alike."""
    both = merge([a, b], k)
    if len(both) == 0:
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has too; 1 for an empty first text."""
    if len(a) == 0:
        return 1.0
    common = resemblance(a, b, k) * distinct_shingles(merge([a, b], k), k)
    return min(1.0, common / distinct_shingles(a, k))


def packed(sketch: np.ndarray) -> str:
    """The sketch as text: base64 of its little-endian 64-bit hashes."""
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    """The sketch that `packed` wrote."""
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """`doc_id`, `fingerprint` and `n_shingles` (estimated) of every document.

    Words are runs of other than ASCII white space, as they stand. Null and empty texts have the empty fingerprint. Repeated
    rows are kept; ids may be null; an empty table gives an empty result. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = sketches_of(part.column("text"), k, shingle_words)
                columns = [part.column("doc_id"), [packed(x) for x in own], [distinct_shingles(x, k) for x in own]]
                names = ["doc_id", "fingerprint", "n_shingles"]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(rows, "doc_id long, fingerprint string, n_shingles double")


def merged_fingerprints(prints: DataFrame, by: str, k: int = K) -> DataFrame:
    """One `fingerprint` for each value of `by`: that of all texts of the group together, the empty one if all are empty.

    Only the k smallest hashes of a task's share of a group are shuffled, and reduced again in parts, so no group is large.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("fingerprint").to_pylist()):
                best[key] = merge([best[key], unpacked(text)] if key in best else [unpacked(text)], k)
                if len(best) > 10_000:
                    yield _exploded(best)
                    best = {}
        if best:
            yield _exploded(best)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(int(x) & 0xFFFFFFFFFFFFFFFF for x in own) for own in batch.column("hashes").to_pylist()]
            texts = pa.array([packed(np.array(own, np.uint64)) for own in lists], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), texts], ["key", "fingerprint"])

    kind = dict(prints.dtypes)[by]
    rows = prints.select(F.col(by).alias("key"), "fingerprint").mapInArrow(hashes, f"key {kind}, hash long")
    # Unsigned order, as a signed number. The null of an empty share comes last, so it takes no hash's place.
    order = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    first = Window.partitionBy("key").orderBy(F.asc_nulls_last("order"))
    kept = rows.select("key", "hash", order.alias("order")).distinct().withColumn("place", F.row_number().over(first))
    grouped = kept.filter(F.col("place") <= k).groupBy("key").agg(F.collect_list("hash").alias("hashes"))
    out = grouped.mapInArrow(smallest, f"key {kind}, fingerprint string")
    return out.withColumnRenamed("key", by)


def _exploded(best: dict) -> pa.RecordBatch:
    """A row for each hash of each key, and one without hash for a key that has none."""
    keys = [key for key, own in best.items() for _ in range(max(1, len(own)))]
    flat = [x for own in best.values() for x in (own.view(np.int64).tolist() or [None])]
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(flat, pa.int64())], ["key", "hash"])


def _constant(values: list[int]) -> Column:
    """An array of numbers as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _cuts_before(ids: Column, ties: Column, count: int, or_equal: bool) -> Column:
    """How many of the sorted cuts (id, tie) come before the row, or are equal to it, by halving steps."""

    def step(done: Column, width: Column) -> Column:
        at = done + width - 1
        cut_id, cut_tie = F.get(ids, at), F.get(ties, at)
        last = F.col("_tie") >= cut_tie if or_equal else F.col("_tie") > cut_tie
        passed = (F.col("_id") > cut_id) | ((F.col("_id") == cut_id) & last)
        return F.when((at < count) & F.coalesce(passed, F.lit(False)), done + width).otherwise(done)

    widths = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, count.bit_length())))])
    return F.aggregate(widths, F.lit(0), step)


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """The documents in parts of ascending id, each part followed by a copy of the next part's first document.

    `part` is the number of the part, `borrowed` whether the row is such a copy. After the last comes the first of all. Parts
    hold as many rows each: they begin at every so-many-th of the sorted ids and hashes. Rows that are equal to several
    beginnings are spread over those parts, so that the last of them has one at least; which is told by the number of a row, so
    the documents must come in one order at each reading, as from a table. Only the beginnings, one a part, reach the driver.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    placed = ranked(keyed.select("_id", "_tie", "_row"), F.col("_id"), F.col("_tie"), F.col("_row"))
    size = max(1, -(-placed.count() // parts))
    begins = [tuple(r) for r in placed.filter(F.col("rank") % size == 0).orderBy("rank").select("_id", "_tie", "_row").collect()]
    cuts = begins[1:]
    ids, ties, numbers = (_constant([c[i] for c in cuts] or [0]) for i in range(3))
    keyed = keyed.withColumns(
        {"_low": _cuts_before(ids, ties, len(cuts), False), "_high": _cuts_before(ids, ties, len(cuts), True)}
    )
    several = (F.col("_high") - F.col("_low") > 1) & (F.col("_row") != F.get(numbers, F.col("_high") - 1))
    spread = F.col("_low") + 1 + F.pmod(F.xxhash64("_row"), F.greatest(F.col("_high") - F.col("_low"), F.lit(1))).cast("int")
    part = F.when(several, spread).otherwise(F.col("_high"))
    own = keyed.select(part.alias("part"), F.lit(False).alias("borrowed"), "_id", "_tie", "text")
    first = begins[0] if begins else (0, 0, 0)
    is_first = (F.col("_id") == first[0]) & (F.col("_tie") == first[1])
    heads = keyed.filter(is_first | (F.col("_low") < F.col("_high")))
    heads = heads.groupBy("_id", "_tie", "_low", "_high").agg(F.first("text").alias("text"))
    before = F.when(F.col("_low") < F.col("_high"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<int>"))
    last = F.when(is_first, F.array(F.lit(len(cuts)))).otherwise(F.array().cast("array<int>"))
    lent = heads.select(F.explode(F.concat(before, last)).alias("part"), F.lit(True).alias("borrowed"), "_id", "_tie", "text")
    return own.unionByName(lent)


def compared_with_next(docs: DataFrame, parts: int, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are to each other and to the next document's.

    In the edited text the last quarter of the code points is replaced by as many of the next document's first, by ascending
    id, after the last the first. Documents of equal id are in the order of a hash of their texts. A null id is the largest.
    Null and empty texts are empty; an only document is its own next one. Other columns are not read.

    The texts are shuffled once, into parts of ascending id, and each task walks through its part with one document in hand.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts, ids = part.column("text").to_pylist(), part.column("_id").to_pylist()
                own = sketches_of(part.column("text"), k, shingle_words)
                last = part.column("last").to_pylist()
                out, edits = [], []
                for doc_id, text, sketch, borrowed in zip(ids, texts, own, last):
                    if held is not None and not held[3]:
                        before = held[1]
                        cut = len(before) // 4
                        edits.append(before[: len(before) - cut] + text[:cut])
                        out.append((held[0], len(before), held[2], sketch))
                    held = (doc_id, text, sketch, borrowed)
                if out:
                    yield _compared(out, edits, k, shingle_words)

    # Several parts for each task, so that the tasks come out even.
    dealt = _dealt(docs, 4 * parts)
    keys = ["borrowed", "_id", "_tie"]
    walked = dealt.repartition(parts, "part").sortWithinPartitions("part", *keys)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_shingles double"
    )
    return walked.select("_id", "text", F.col("borrowed").alias("last")).mapInArrow(rows, schema)


def _compared(out: list[tuple], edits: list[str], k: int, shingle_words: int) -> pa.RecordBatch:
    edited = sketches_of(pa.array(edits, pa.string()), k, shingle_words)
    pairs = list(zip(out, edits, edited))
    columns = {
        "doc_id": pa.array([None if o[0] == NO_ID else o[0] for o in out], pa.int64()),
        "n_chars": pa.array([o[1] for o in out], pa.int64()),
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
        "fingerprint": [packed(o[2]) for o in out],
        "edited_fingerprint": [packed(x) for x in edited],
        "near_edited": [resemblance(o[2], x, k) for o, _, x in pairs],
        "near_next": [resemblance(o[2], o[3], k) for o in out],
        "n_shingles": [distinct_shingles(o[2], k) for o in out],
    }
    return pa.RecordBatch.from_pydict(columns)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    docs = table(spark, sf_dir, "documents")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return compared_with_next(docs, parts)
