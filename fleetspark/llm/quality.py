"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import Words, mixed, shingles_of, slices, text_bytes, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 18
NGRAMS = (1, 2)
CLASS_NGRAMS = (1, 2)

# The bound of the training sample: labelled rows with the smallest hash of their id.
TRAINING_ROWS = 20_000
# Independent learners, whose weights are averaged. The number is fixed so that the model does not depend on the cluster.
LEARNERS = 4
EPOCHS = 3

# The n-grams of a text weigh so much together, whatever its length.
TEXT_WEIGHT = 32.0

ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

LEAST_SCORE = 0.3


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _shapes(words: Words, raw: np.ndarray) -> np.ndarray:
    """A hash of each word's class: case of its first and second letter, its last byte if that is no letter, and whether it
    repeats the word before."""
    upper = ((raw >= 65) & (raw <= 90)).astype(np.uint64)
    last = raw[words.end - 1].astype(np.uint64)
    is_letter = (last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    second = np.minimum(words.begin + 1, words.end - 1)
    parts = np.where(is_letter, np.uint64(0), last) * 8 + upper[words.begin] * 4 + upper[second] * 2 + again
    return mixed(parts.astype(np.uint64) + np.uint64(1 << 32))


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram and the text that it is in: n-grams of the words as they stand, and of their classes."""
    words = words_of(texts, seed=5)
    if len(words.hash) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shapes = words._replace(hash=_shapes(words, text_bytes(texts)[0]))
    buckets, owners = [], []
    for channel, sizes, seed in ((words, NGRAMS, 50), (shapes, CLASS_NGRAMS, 60)):
        for n in sizes:
            hashed, whole = shingles_of(channel, n, seed=seed + n)
            buckets.append((hashed[whole] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(words.text[whole])
    return np.concatenate(buckets), np.concatenate(owners)


class _Learner:
    """FTRL-proximal with a step size for each weight."""

    def __init__(self) -> None:
        size = (1 << BUCKET_BITS) + 1
        self._z, self._n = np.zeros(size), np.zeros(size)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self._z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(self._n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        """One step along the example with the values x at the places `at`."""
        w = self._weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self._n[at]
        self._z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self._n[at] = n + g * g

    def weights(self) -> np.ndarray:
        return self._weights(np.arange(len(self._z)))


def fit(docs: DataFrame, labels: DataFrame, label: str, training_rows: int = TRAINING_ROWS, epochs: int = EPOCHS) -> Model:
    """A model of `label` (0 or 1) from at most `training_rows` labelled documents, whole texts.

    Each learner sees a fixed share of the sample in the order of a hash. Labels without a document, null labels and null ids
    are passed over; of several labels of one id the largest counts, and of several texts the one with the smallest hash. Without any label the model is neutral.
    """
    sample = labels.dropna(subset=["doc_id", label]).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # One text of each id, so the sample is bounded in rows too.
    examples = examples.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    examples = examples.withColumns({"learner": F.pmod(F.xxhash64("doc_id"), F.lit(LEARNERS)), "at": F.xxhash64("doc_id", "text")})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, owner = features_of(part.column("text"))
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
                bucket = bucket[order]
                for i, (y, learner) in enumerate(zip(part.column("label").to_pylist(), part.column("learner").to_pylist())):
                    at, count = np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True)
                    x = count * (TEXT_WEIGHT / max(1, count.sum()))
                    example = (np.r_[at, 1 << BUCKET_BITS].astype(np.int32), np.r_[x, 1.0].astype(np.float32), y)
                    own.setdefault(learner, []).append(example)
        for examples in own.values():
            learner = _Learner()
            for _ in range(epochs):
                for at, x, y in examples:
                    learner.learn(at, x.astype(np.float64), y)
            yield pa.RecordBatch.from_arrays([pa.array([learner.weights()], pa.list_(pa.float64()))], ["weights"])

    dealt = examples.repartition(LEARNERS, "learner").sortWithinPartitions("learner", "at")
    # One array of a fixed size for each learner reaches the driver.
    found = dealt.select("text", "label", "learner").mapInArrow(learn, "weights array<double>").collect()
    if not found:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    mean = np.mean([r["weights"] for r in found], axis=0)
    return Model(mean[:-1].astype(np.float32), float(mean[-1]))


def score(docs: DataFrame, model: Model, *others: str) -> DataFrame:
    """`doc_id`, other columns and `score`, from 0 to 1, of every whole text: a sparse dot product and a logistic.

    Null and empty texts have no n-grams and get the score of the bias. Repeated rows score alike; an empty table gives an
    empty result.
    """
    carried = ["doc_id", *others]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, owner = features_of(part.column("text"))
                sums = np.bincount(owner, weights=model.weights[bucket], minlength=part.num_rows)
                n = np.bincount(owner, minlength=part.num_rows)
                logit = model.bias + sums * (TEXT_WEIGHT / np.maximum(n, 1))
                scores = pa.array(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), scores], [*carried, "score"])

    named = docs.select(*carried, "text")
    kinds = dict(named.dtypes)
    return named.mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", score double")


def held_out(doc_id: Column) -> Column:
    """Whether the document is one of the fifth that labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, as the labels mark it."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels, "quality"))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"),
    )
