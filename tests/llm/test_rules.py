import random
import re
from collections import Counter

from fleetspark.llm import rules
from fleetspark.llm.shared import table
from pyspark.sql import functions as F

from .conftest import words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_statistics_equal_brute_force(spark, small):
    chance = random.Random(2)
    odd = [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a", "\n\n", " x\ny\nx\n x\r\n", "\U0001f600 é" * 3]
    odd += ["".join(chance.choice("ab \n\té#|") for _ in range(chance.randrange(60))) for _ in range(300)]
    texts = dict(enumerate(odd)) | {1000 + i: t for i, t in small[1].items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in rules.statistics(docs).collect()}
    assert got == {i: plain(t) for i, t in texts.items()}


def test_a_very_long_text(spark):
    """Over a million windows, so that short hashes of unlike ones agree, and a few real repeats far apart."""
    words = [f"w{i}" for i in range(1_100_000)]
    words[900_000:900_007] = words[5:12]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b c a b c")], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.statistics(docs).collect()}
    assert got == {1: 14, 2: 6}


def test_learned_verdicts(spark):
    rows = rules.op9_quality_rules(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if not r.base_failed and labels.get(r.doc_id) is not None]
    good, bad = [k for k, y in judged if y == 1], [k for k, y in judged if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_conjunctions_in_order(spark):
    chance = random.Random(4)
    rows = []
    for i in range(3000):
        a, b = chance.random(), chance.random()
        rows.append((i, a, b, int(not ((a > 0.7 and b <= 0.4) or b > 0.9))))
    frame = spark.createDataFrame(rows, "doc_id long, a double, b double, good int")
    found = rules.learn(frame, "good", ("a", "b"))
    wrong = frame.filter((rules.verdict(found) == 0) != (F.col("good") == 1)).count()
    assert wrong < 0.06 * len(rows) and any(len(r) == 2 for r in found)
    assert all(" > " in x or " <= " in x for x in rules.described(found))


def test_pruning_drops_what_does_not_help(spark):
    rows = [(i, float(i % 100), float(i * 7919 % 101), int(i % 100 < 80)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, a double, b double, good int")
    found = rules.learn(frame, "good", ("a", "b"))
    assert found and all(c.name == "a" for c in found[0])
    assert rules.learn(frame.withColumn("good", F.lit(1)), "good", ("a", "b")) == []


def test_hard_rows(spark, hard, hard_rows, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (10, None)], "doc_id long, quality int")
    rows = rules.rated(hard, labels).collect()
    assert len(rows) == len(hard_rows)
    got = {r.doc_id: r for r in rows}
    assert got[6].n_words == got[7].n_words == got[8].n_words == 0 and got[6].base_failed and got[10].base_failed
    assert got[1].kept and got[4].kept
    assert rules.rated(empty, labels).count() == 0
    assert rules.rated(hard, labels.limit(0)).count() == len(hard_rows)


def test_only_dataframe_functions(hard, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for df in (rules.statistics(hard), rules.rated(hard, labels)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
