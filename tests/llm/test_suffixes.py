from collections import defaultdict

import pytest
from fleetspark.llm import suffixes
from fleetspark.llm.shared import written
from pyspark.sql import functions as F

from .conftest import sentence, words_of


def plain(texts, n=50):
    """The words in repeated windows, and in those that occur earlier, of each document."""
    places = defaultdict(list)
    for i in sorted(texts):
        words = words_of(texts[i])
        for k in range(len(words) - n + 1):
            places[tuple(words[k : k + n])].append((i, k))
    repeated, later = defaultdict(set), defaultdict(set)
    for found in places.values():
        for at, (i, k) in enumerate(found if len(found) > 1 else []):
            repeated[i].update(range(k, k + n))
            if at:
                later[i].update(range(k, k + n))
    return repeated, later


def covered(spans):
    return {w for s in spans for w in range(s.begin, s.end)}


def check(found, texts, n=50):
    repeated, later = plain(texts, n)
    rows = {r["_id"]: r for r in found.collect()}
    assert set(rows) == set(repeated)
    for i, row in rows.items():
        assert covered(row.repeated) == repeated[i] and covered(row.later) == later.get(i, set())


def test_passages_equal_brute_force(small):
    docs, texts = small
    check(suffixes.repeated_passages(docs), texts)


@pytest.mark.parametrize("n, prefix", [(5, 1), (5, 5), (12, 4)])
def test_short_passages_and_periodic_texts(spark, n, prefix):
    texts = {
        0: "a " * 40,
        1: "a b " * 20,
        2: "x " + "a b " * 9 + "y",
        3: sentence(1, 60),
        4: sentence(2, 30) + " " + " ".join(words_of(sentence(1, 60))[17:17 + n]) + " " + sentence(3, 30),
        5: " ".join(words_of(sentence(1, 60))[20:19 + n]),
        6: None,
        7: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check(suffixes.repeated_passages(docs, n, prefix), texts, n)


def test_cut(small):
    docs, texts = small
    cut = suffixes.cut_passages(docs, written(suffixes.repeated_passages(docs), "test"))
    assert cut.columns == docs.columns
    _, later = plain(texts)
    got = {r.doc_id: r for r in cut.collect()}
    for i, text in texts.items():
        left = [w for k, w in enumerate(words_of(text)) if k not in later.get(i, ())]
        assert (i in got) == (bool(left) or not words_of(text))
        if i in got:
            assert words_of(got[i].text) == left and got[i].n_chars == len(got[i].text)
        if i not in later:
            assert got[i].text == text


def test_a_text_is_cut_once_and_shuffled_once(small, capsys):
    docs, _ = small
    suffixes.cut_passages(docs, written(suffixes.repeated_passages(docs), "test")).explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython [") == 1
    # What the join shuffles is the key and the row.
    keyed = next(line for line in plan.split("\n") if "struct(doc_id" in line)
    assert " AS text#" not in keyed


def test_hard_rows(hard, hard_rows):
    found = written(suffixes.repeated_passages(hard), "test")
    rows = {r["_id"]: r for r in found.collect()}
    assert {1, 2, 3, 4, 5, 10} <= set(rows) and not {6, 7, 8, 9, 12} & set(rows) - {12}
    assert rows[2].copy and not rows[1].copy and not rows[4].later and covered(rows[5].later) == set(range(60))
    cut = suffixes.cut_passages(hard, found)
    assert cut.columns == hard.columns
    ids = [r.doc_id for r in cut.collect()]
    # Without its copied passage, document 2 has no words; document 3 appears twice as before.
    assert 2 not in ids and ids.count(3) == 2 and ids.count(None) == 3 and {6, 7, 8, 9} <= set(ids)


def test_empty_table(empty):
    found = written(suffixes.repeated_passages(empty), "test")
    assert found.count() == 0 and suffixes.cut_passages(empty, found).columns == empty.columns


def test_null_ids_with_hashes_that_begin_alike(spark):
    ends = F.concat(F.lit(sentence(7, 60) + " t"), F.col("id").cast("string"))
    texts = spark.range(20_000).select(ends.alias("text"))
    alike = texts.groupBy(F.shiftrightunsigned(F.xxhash64("text"), 40)).agg(F.sort_array(F.collect_list("text")).alias("own"))
    own = alike.filter("size(own) > 1").first()["own"][:2]
    docs = spark.createDataFrame([(None, text) for text in own], "doc_id long, text string")
    found = written(suffixes.repeated_passages(docs), "test")
    assert [covered(r.repeated) for r in found.collect()] == [set(range(60))] * 2
    assert sorted(len(words_of(r.text)) for r in suffixes.cut_passages(docs, found).collect()) == [1, 61]
