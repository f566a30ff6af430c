import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import polytope
from fleetspark.llm.queries import QUERIES

ASK = "vec_id % 20 = 0"


def brute(rows, k=20, every=20):
    """{(query, rank): (vec_id, score)} of (vec_id, vector) rows, by comparing every pair."""
    good = [(i, tuple(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = list(dict.fromkeys(good))
    width = max((len(v) for _, v in good), default=0)
    matrix = np.array([list(v) + [0.0] * (width - len(v)) for _, v in good]).reshape(len(good), width)
    out = {}
    for query in {i for i, _ in good if i is not None and i % every == 0}:
        pairs = set()
        for own in [j for j, (i, _) in enumerate(good) if i == query]:
            scores = (matrix * matrix[own]).sum(axis=1)
            pairs |= {(-s, i is None, i or 0) for s, (i, _) in zip(scores.tolist(), good) if i != query}
        for rank, (score, unnamed, i) in enumerate(sorted(pairs)[:k]):
            out[query, rank + 1] = (None if unnamed else i, -score)
    return out


def found(df):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in df.collect()}


def share(got, want):
    """The share of the neighbours that were found."""
    pairs = {(q, i) for (q, _), (i, _) in got.items()}
    return sum((q, i) in pairs for (q, _), (i, _) in want.items()) / len(want)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_and_scores_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), found(QUERIES["op13_nearest_neighbours"](spark, f"/root/testdata/sf{sf}"))
    assert got.keys() == want.keys()
    exact = {(q, i): s for (q, _), (i, s) in want.items()}
    hits = [(q, i, s) for (q, _), (i, s) in got.items() if (q, i) in exact]
    assert len(hits) / len(want) >= 0.9
    assert all(s == pytest.approx(exact[q, i], abs=1e-12) for q, i, s in hits)


def test_the_exact_search_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = found(polytope.search(df, ASK, exact=True))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_the_pseudo_rotation_keeps_inner_products():
    rows = np.random.default_rng(1).normal(size=(50, 128))
    turned = polytope.turned(rows, 3) / 128**1.5
    assert np.allclose(turned @ turned.T, rows @ rows.T)
    one = polytope.buckets(np.vstack((rows, -rows)), 0, 1)[:, 0]
    assert ((one[:50] + 128) % 256 == one[50:]).all()


def test_probes_come_in_the_order_of_nearness():
    rows = np.random.default_rng(2).normal(size=(30, 64))
    turned = polytope.turned(rows, 5)
    both = np.concatenate((turned, -turned), axis=1)
    assert (polytope.buckets(rows, 5, 9) == np.argsort(-both, axis=1)[:, :9]).all()


def test_hard_vectors(spark):
    """Nulls, zeros, infinities, short vectors, repeated rows, ids that repeat or lack, lengths that differ; fewer than k."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (40, [0.0, 0.0, 0.0]), (60, None), (80, [nan, 1.0, 1.0]),
        (100, [inf, 1.0, 1.0]), (120, [1.0, None, 1.0]), (140, []), (160, [5.0]), (1, [1e3, -1e3, 2.0]), (2, [1e-9, 0.0, 0.0]),
        (3, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (4, [-1.0, -2.0, -3.0]), (180, [3.0, 2.0, 1.0]),
        (180, [1.0, 2.0, 3.0]), (5, [0.1, 0.2, 0.30000000000000004]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, keys string, row int").repartition(4)
    want = brute(rows)
    assert found(polytope.search(df, ASK)) == want == found(polytope.search(df, ASK, exact=True))


def test_copies_beyond_a_tile_tie_by_id(spark, monkeypatch):
    """A third of the vectors are copies, in more tiles than one; the smallest ids come first."""
    monkeypatch.setattr(polytope, "VECTOR_TILE", 64)
    monkeypatch.setattr(polytope, "QUERY_TILE", 8)
    rng = np.random.default_rng(3)
    same = (rng.normal(size=16) * 3).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    want, got = brute(rows), found(polytope.search(df, ASK))
    assert got.keys() == want.keys()
    copies = {k: v for k, v in want.items() if k[0] % 3 == 0}
    assert {k: got[k] for k in copies} == copies
    assert share(got, want) >= 0.9


def test_lengths_decide_the_inner_product(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=24) * rng.lognormal(0, 0.5)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), found(polytope.search(df, ASK))
    assert share(got, want) >= 0.9


def test_an_empty_table_and_an_only_vector(spark):
    schema = "vec_id long, embedding array<float>"
    assert polytope.search(spark.createDataFrame([], schema), ASK).count() == 0
    assert polytope.search(spark.createDataFrame([(0, [1.0, 2.0])], schema), ASK).count() == 0
    assert polytope.search(spark.createDataFrame([(0, None)], schema), ASK).count() == 0
