import hashlib

import numpy as np
import pyarrow as pa
import pytest
from fleetspark.llm import sketches

from .conftest import sentence, words_of


def shingles(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates_against_exact_sets():
    texts = [sentence(1, 900), sentence(1, 900) + " " + sentence(2, 300), sentence(3, 40), "a b", "", None, "x " * 5000]
    sets = [shingles(t) for t in texts]
    found = sketches.sketches_of(pa.array(texts))
    for own, a in zip(found, sets):
        assert (np.diff(own.astype(object)) > 0).all() and len(own) == min(len(a), sketches.K)
        assert sketches.distinct_shingles(own) == pytest.approx(len(a), rel=0.3)
        assert (sketches.unpacked(sketches.packed(own)) == own).all()
        for other, b in zip(found, sets):
            assert sketches.resemblance(own, other) == pytest.approx(likeness(a, b), abs=0.15)
            share = len(a & b) / len(a) if a else 1.0
            assert sketches.containment(own, other) == pytest.approx(share, abs=0.25)


def test_sketches_merge():
    parts = ["one two three four five six", "six seven eight nine ten", "one two three four five six"]
    found = sketches.sketches_of(pa.array(parts))
    assert (sketches.merge(found[:2]) == sketches.merge(found)).all()
    exact = set().union(*map(shingles, parts))
    assert sketches.distinct_shingles(sketches.merge(found)) == len(exact)
    assert len(sketches.merge([])) == 0


def test_merged_fingerprints(small):
    docs, texts = small
    prints = sketches.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: r.fingerprint for r in sketches.merged_fingerprints(prints, "source").collect()}
    by_source = {}
    for r in docs.collect():
        by_source.setdefault(r.source, []).append(r.text)
    assert set(got) == set(by_source)
    for source, own in by_source.items():
        assert (sketches.unpacked(got[source]) == sketches.merge(sketches.sketches_of(pa.array(own)))).all()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_texts(small, parts):
    docs, texts = small
    rows = {r.doc_id: r for r in sketches.compared_with_next(docs.repartition(4), parts).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for doc_id, after in zip(ids, ids[1:] + ids[:1]):
        text, row = texts[doc_id], rows[doc_id]
        n = len(text) // 4
        edited = text[: len(text) - n] + texts[after][:n]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(likeness(shingles(text), shingles(edited)), abs=0.2)
        assert row.near_next == pytest.approx(likeness(shingles(text), shingles(texts[after])), abs=0.2)
        assert row.fingerprint == sketches.packed(sketches.sketches_of(pa.array([text]))[0])
        assert row.edited_fingerprint == sketches.packed(sketches.sketches_of(pa.array([edited]))[0])


def test_hard_rows(spark, hard, hard_rows, empty):
    rows = sketches.compared_with_next(hard, 3).collect()
    texts = sorted(len(r[1] or "") for r in hard_rows)
    # A row that comes twice next to itself is its own next one in the walk, so it is there twice as well.
    assert sorted(r.n_chars for r in rows) == texts
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert sketches.fingerprints(hard).count() == len(hard_rows)
    only = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    (row,) = sketches.compared_with_next(only, 4).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest()
    assert sketches.compared_with_next(empty, 2).count() == 0
    assert sketches.merged_fingerprints(sketches.fingerprints(empty), "doc_id").count() == 0


def test_merged_fingerprints_of_groups_without_words(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three", "b"), (4, "", "b"), (5, " ", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = sketches.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: r.fingerprint for r in sketches.merged_fingerprints(prints, "source").collect()}
    own = sketches.packed(sketches.sketches_of(pa.array(["one two three"]))[0])
    assert got == {"a": "", "b": own, "c": ""}


def test_rows_without_id_and_repeated_rows_fill_all_parts(spark):
    """All ids null, a third of the rows equal: no part holds much more than its share, and each row has its result."""
    rows = [(None, f"text number {i} of many words" if i % 3 else "the same words again and again") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = [r["count"] for r in sketches._dealt(docs, 16).filter("NOT borrowed").groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * 3000 / 16
    found = sketches.compared_with_next(docs, 4).collect()
    assert len(found) == 3000 and all(r.doc_id is None for r in found)
    assert sum(r.near_next == 1.0 for r in found) >= 998
