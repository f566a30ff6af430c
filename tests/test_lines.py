import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import chunking, lines
from fleetspark.sources import read_manual_lines


def whole(df, rows):
    return rows(df.withColumn("position", F.col("position").cast("bigint")), "doc_id", "position", "block", "manufacturer", "model", "fault_code")


@pytest.fixture(scope="module")
def texts():
    """Headers at line ends and within lines, dashed lines, sections in between, odd line ends, no headers at all."""
    chance = random.Random(7)
    parts = [
        "FAULT CODE: E-1001", "FAULT CODE: none", "SECTION 1: a", "SECTION 3 b", "SECTION 2", "SECTION 4", "-" * 12, "-" * 9, "words and words " * 3,
        "\r", "\x85", " FAULT CODE: E-7 FAULT CODE: E-8 tail", "----------FAULT CODE: E-9 after dashes", "",
    ]
    made = ["\n".join(chance.choice(parts) for _ in range(chance.randrange(40))) for _ in range(150)]
    made += ["", "FAULT CODE: E-1", "no headers\n" * 50, "\n" * 30, ("FAULT CODE: E-2 " + "x" * 60 + "\n") * 30]
    return list(enumerate(made))


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_blocks_of_lines_are_those_of_whole_texts(spark, rows, texts, parts):
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = whole(lines.fault_blocks_of_lines(lines.lines_of(documents)), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == whole(chunking.fault_blocks(documents), rows) and len(found) > 200


def test_one_document_over_many_tasks(spark, rows, tmp_path):
    """A file of a few MB is read, sorted and segmented by many tasks; a section holds over many of them."""
    text = "SECTION 2: far away\n" + "".join(
        f"FAULT CODE: E-{i}\nName: {'long line ' * 20}{i}\nmore\n" + ("-" * 20 + f"\nbetween {i}\n" if i % 3 else "") for i in range(8000)
    )
    (tmp_path / "manual.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = read_manual_lines(spark, str(tmp_path / "manual.txt"))
        assert read.rdd.getNumPartitions() > 20
        found = lines.fault_blocks_of_lines(read).cache()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    documents = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert rows(found, "position", "block", "manufacturer") == rows(
        chunking.fault_blocks(documents).withColumn("position", F.col("position").cast("int")), "position", "block", "manufacturer"
    )


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id bigint, line_no int, line string")
    assert lines.fault_blocks_of_lines(none).count() == 0


def test_lines_are_shuffled_once_for_the_join_and_the_window(spark):
    text = "FAULT CODE: E-1\n" + "words of the block, long enough to be kept\n" * 3 + "-----------\n"
    documents = spark.createDataFrame([(1, text), (None, text)], "doc_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lines.fault_blocks_of_lines(lines.lines_of(documents))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id is None, r.fault_code) for r in found.collect()) == [(False, "E-1"), (True, "E-1")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Totals by document and part, by document, and for the join; lines for the join; rows of a block.
    assert plan.count("Exchange hashpartitioning") <= 5
