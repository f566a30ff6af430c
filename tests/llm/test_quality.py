import zlib

import numpy as np
import pytest
from fleetspark.llm import quality
from fleetspark.llm.shared import table

from .conftest import sentence

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = quality.op5_quality_classifier(spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    assert len(rows) == table(spark, FOLDER, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good = np.array([s for s, y in own if y == 1])
    bad = np.array([s for s, y in own if y == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in own]) > 0.95


def test_reruns_and_labels_alone(spark):
    rows = [(i, ("good word " if i % 2 else "BAD!! ") * 20 + sentence(i, 20)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    model = quality.fit(docs.repartition(5), labels, "quality")
    again = quality.fit(docs, labels.repartition(3), "quality")
    assert (model.weights == again.weights).all() and model.bias == again.bias
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(150, 200))


def test_one_update_equals_its_definition():
    learner = quality._Learner()
    at, x = np.array([3, 7]), np.array([2.0, 1.0])
    z, n, w = np.zeros(2), np.zeros(2), np.zeros(2)
    for label in (1.0, 0.0, 1.0):
        p = 1 / (1 + np.exp(-w @ x))
        g = (p - label) * x
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * w
        n += g * g
        w = np.where(
            abs(z) <= quality.L1, 0.0, -(z - np.sign(z) * quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2)
        )
        learner.learn(at, x, label)
    assert learner.weights()[at] == pytest.approx(w) and np.count_nonzero(learner.weights()) == np.count_nonzero(w)


def test_hard_rows(spark, hard, hard_rows, empty):
    labels = spark.createDataFrame([(1, 1), (10, 0), (6, 0)], "doc_id long, quality int")
    model = quality.fit(hard, labels, "quality")
    rows = quality.score(hard, model, "_hash", "words").collect()
    assert len(rows) == len(hard_rows) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[6] == by_id[7] == by_id[8] and by_id[1] == by_id[2]
    neutral = quality.fit(empty, labels, "quality")
    assert {r.score for r in quality.score(hard, neutral).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_scores_by_brute_force(spark):
    """Weights by plain loops over dictionaries, text by text, and scores by sums over the n-grams of one text."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rows = [(i, ("good Word " if i % 3 else "BAD!! ") * (i % 5) + sentence(i, 12)) for i in range(60)] + [(60, ""), (61, None), (62, "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(60, 0), (61, 1)], "doc_id long, quality int")

    def grams(text):
        buckets = quality.features_of(pa.array([text], pa.string()))[0].tolist()
        counts = {b: buckets.count(b) for b in buckets}
        values = {b: float(np.float32(n * quality.TEXT_WEIGHT / len(buckets))) for b, n in counts.items()}
        return values, counts, len(buckets)

    deal = F.pmod(F.xxhash64("doc_id"), F.lit(quality.LEARNERS)).alias("learner")
    dealt = docs.select("doc_id", "text", deal, F.xxhash64("doc_id", "text").alias("at")).join(labels, "doc_id").collect()
    sums, bias, learners = {}, 0.0, {r.learner for r in dealt}
    for learner in learners:
        own = sorted((r for r in dealt if r.learner == learner), key=lambda r: r["at"])
        z, n = {}, {}

        def weight(k):
            past = z.get(k, 0.0)
            if abs(past) <= quality.L1:
                return 0.0
            return -(past - np.sign(past) * quality.L1) / ((quality.BETA + n.get(k, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

        for _ in range(quality.EPOCHS):
            for r in own:
                x = {**grams(r.text)[0], "bias": 1.0}
                w = {k: weight(k) for k in x}
                gap = 1 / (1 + np.exp(-sum(w[k] * x[k] for k in x))) - r.quality
                for k in x:
                    g, past = gap * x[k], n.get(k, 0.0)
                    z[k] = z.get(k, 0.0) + g - ((past + g * g) ** 0.5 - past**0.5) / quality.ALPHA * w[k]
                    n[k] = past + g * g
        for k in z:
            sums[k] = sums.get(k, 0.0) + weight(k)
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, "quality")).collect()}
    assert len(scores) == len(rows)
    for i, text in rows:
        _, counts, size = grams(text)
        logit = sum(sums.get(b, 0.0) * c for b, c in counts.items()) * quality.TEXT_WEIGHT / max(1, size) + sums["bias"]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-logit / len(learners))), abs=1e-4)


def test_features_are_the_n_grams(spark):
    """Texts share a bucket for each run of words that they share, and have as many buckets as runs."""
    import pyarrow as pa

    for text in ("one two three four", "One one", "x", "", None, "a  b\tc"):
        n = len((text or "").split())
        runs = sum(max(0, n - k + 1) for k in quality.NGRAMS) + sum(max(0, n - k + 1) for k in quality.CLASS_NGRAMS)
        assert len(quality.features_of(pa.array([text], pa.string()))[0]) == runs
    alone = set(quality.features_of(pa.array(["two three"], pa.string()))[0].tolist())
    within, owner = quality.features_of(pa.array(["one two three four", "two three"], pa.string()))
    assert alone == set(within[owner == 1].tolist())
