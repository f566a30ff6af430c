import pytest
from fleetspark.llm import mixing

from .conftest import words_of


def plain_targets(sizes, weights, most):
    names = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, rest, target = sum(sizes.values()), set(names), {}
    while rest:
        level = left / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in rest}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        rest -= over
    return target


def test_targets_and_takes(small):
    docs, texts = small
    rows = mixing.mixture(docs).collect()
    sizes, largest = {}, {}
    for r in rows:
        assert r.size == len(words_of(texts[r.doc_id]))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    wanted = plain_targets(sizes, mixing.WEIGHTS, 3)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source]
        own = sum(t.words for t in r.takes)
        assert own <= 3 * r.size and all(0 < t.words <= r.size for t in r.takes)
        taken[r.source] += own
    assert sum(taken.values()) == sum(sizes.values())
    # By finish time, a source is off by one document at most, and the whole by one of each source.
    assert all(taken[s] >= wanted[s] - largest[s] - 1 or largest[s] > wanted[s] / 2 for s in sizes)


def test_takes_are_a_prefix_of_the_finish_times(small):
    docs, _ = small
    rows = mixing.mixture(docs).collect()
    offers = []
    for source in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r["_at"] % 2**64 >> 54, r["_at"], r.doc_id))
        upto = 0
        for r in own:
            upto += r.size
            taken = {t.turn: t.words for t in r.takes}
            for turn in range(3 if r.size else 0):
                offers.append(((turn * r.source_size + upto) / r.target, r.size, taken.get(turn, 0)))
    left = sum(r.size for r in rows)
    for _, size, taken in sorted(offers):
        assert taken == min(size, left)
        left -= taken
    assert left == 0


def test_bounds_are_shared_out(spark):
    rows = [(i, "w " * 10, "big", i) for i in range(50)] + [(100, "v w", "tiny", 0), (101, "u", None, 0), (102, "", "void", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = {r.source: r for r in mixing.mixture(docs, (1.0,)).collect()}
    assert got["tiny"].target == 6 and got[None].target == 3 and got["void"].target == 0
    assert got["big"].target == pytest.approx(503 - 9)
    assert [t.words for t in got["tiny"].takes] == [2, 2, 2] and not got["void"].takes


def test_mixed_rows(spark, small):
    docs, texts = small
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(words_of(r.text)) for r in rows) == sum(len(words_of(t)) for t in texts.values())
    cut = [r for r in rows if r.text != texts[r.doc_id]]
    assert len(cut) <= 1 and all(words_of(texts[r.doc_id])[: len(words_of(r.text))] == words_of(r.text) for r in cut)


def test_hard_rows_and_reruns(hard, hard_rows):
    rows = mixing.mixture(hard).collect()
    assert len(rows) == len(hard_rows)
    assert sum(t.words for r in rows for t in r.takes) == sum(r.size for r in rows)
    again = mixing.mixture(hard.repartition(5)).collect()
    key = lambda r: str((r.doc_id, r["_at"], r.takes))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    mixed = mixing.mixed(hard)
    assert mixed.columns == hard.columns
    assert mixed.count() == sum(len(r.takes) for r in rows)


def test_empty_table(empty):
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_only_dataframe_functions(small):
    for df in (mixing.mixture(small[0]), mixing.mixed(small[0])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_budget_may_end_late_when_a_source_is_bounded(spark):
    rows = [(i, "w " * 22, "a") for i in range(4)] + [(10 + i, "w", "b") for i in range(10)]
    rows = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1.0, 2.0)).collect()
    assert {(r.source, round(r.target, 6)) for r in rows} == {("a", 68), ("b", 30)}
    assert sum(t.words for r in rows for t in r.takes) == 98
    assert sum(t.words for r in rows if r.source == "b" for t in r.takes) == 30


def test_one_document_far_above_its_target(spark):
    rows = [(1, "w " * 3000, "a")] + [(10 + i, "w w", f"b{i:02d}") for i in range(30)]
    rows = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1.0,)).collect()
    assert sum(t.words for r in rows for t in r.takes) == 3060
    assert all(sum(t.words for t in r.takes) == 6 for r in rows if r.size == 2)


def test_many_identical_rows_are_mixed_each(spark):
    """Rows equal in everything are no key: 100,000 of them are dealt as any others."""
    same = spark.range(100_000).selectExpr("7L AS doc_id", "'one two three' AS text", "'a' AS source", "13L AS n_chars")
    other = spark.range(50).selectExpr("id AS doc_id", "'x y' AS text", "'b' AS source", "3L AS n_chars")
    docs = same.unionByName(other).repartition(8)
    takes = mixing.mixture(docs).selectExpr("source", "explode(takes) AS t").groupBy("source").agg({"t.words": "sum", "*": "count"}).collect()
    found = mixing.mixed(docs).selectExpr("source", "size(split(text, ' ')) AS n").groupBy("source").agg({"n": "sum", "*": "count"}).collect()
    assert sorted(map(tuple, takes)) == sorted(map(tuple, found))
