import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _hash int, words string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """The folder that tables are written to."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def sentence(seed: int, n: int) -> str:
    """Words that depend on the seed alone."""
    words, state = [], seed * 7919 + 1
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        words.append(["the", "of", "and"][state % 3] if state % 5 == 0 else f"w{(state >> 8) % 997}")
    return " ".join(words)


@pytest.fixture(scope="session")
def hard_rows():
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and columns of odd names."""
    base, passage = sentence(1, 300), sentence(2, 60)
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, base + " end", "en", "b", None),
        (3, base + " end", "en", "b", None),
        (4, f"{sentence(3, 80)}\n{passage} {sentence(4, 90)}", None, None, 5),
        (5, f"{passage}\t{sentence(5, 200)}", "de", "", 5),
        (6, None, "en", "a", 0),
        (7, "", "en", None, 0),
        (8, " \n\t ", None, "b", 4),
        (9, "one", "xx", "b", 3),
        (None, sentence(6, 120), "fr", "b", 1),
        (None, sentence(7, 120), "fr", "b", 1),
        (None, None, None, None, None),
        (10, "same " * 400, "en", "c", 2000),
        (11, sentence(8, 20_000), "en", "c", 1),
        (11, "another text of an equal id", "en", "c", 1),
        (12, "é漢 #*$ | <b> \U0001f600 " * 30, "es", "c", 1),
    ]
    return [(*row, "x", None, "y", i) for i, row in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given documents, and all their texts by id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words_of(text):
    return WORD.findall(text or "")
