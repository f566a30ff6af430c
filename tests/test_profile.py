import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.operators import profile


def column(spark, values):
    return spark.createDataFrame([(None if value is None else float(value),) for value in values], "x double")


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 10, 33, 1000])
def test_quantiles_are_exact(spark, size):
    generator = random.Random(size)
    values = [generator.choice([generator.gauss(0, 1), 0.0, 1.0]) for _ in range(size)]
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    found = profile.exact_quantiles(column(spark, [*values, None]), ["x"], probabilities).collect()
    assert {row.probability: row.value for row in found} == pytest.approx(
        {p: float(np.quantile(values, p)) for p in probabilities}
    )


def test_quantiles_of_many_rows_keep_few(spark):
    values = spark.range(500_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    found = {row.probability: row.value for row in profile.exact_quantiles(values, ["x"]).collect()}
    exact = values.agg(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
    assert [found[p] for p in (0.25, 0.5, 0.75)] == pytest.approx(exact)


def test_describe(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    found = profile.describe(df, ["a", "b"]).collect()
    assert [row.column for row in found] == ["a"]
    assert (found[0]["count"], found[0]["min"], found[0]["max"], found[0].p50) == (3, 1.0, 4.0, 2.0)


def test_histogram_edges(spark):
    found = {row.bin: row.rows for row in profile.histogram(column(spark, [0, 1, 14.99, 15, None]), "x").collect()}
    assert found == {1: 1, 2: 1, 15: 2}
    assert [row.rows for row in profile.histogram(column(spark, [3, 3]), "x").collect()] == [2]


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert [tuple(row) for row in profile.value_counts(df, "k").collect()] == [("a", 2), (None, 1), ("b", 1)]
    assert {row.k: row.share for row in profile.value_shares(df, "k").collect()} == {"a": 0.5, "b": 0.25, None: 0.25}
    assert profile.null_counts(df).first().k == 1


def test_fault_rate_counts_empty_codes(spark):
    df = spark.createDataFrame(
        [("A", date(2024, 1, 1), ""), ("A", date(2024, 1, 2), None)], "asset_id string, date date, fault_code string"
    )
    row = profile.fault_rate(df).first()
    assert (row.fault_rows, row.fault_rate) == (1, 0.5)
    whole = profile.span(df).first()
    assert (whole.row_count, whole.column_count, whole.asset_count) == (2, 3, 1)
    assert [row.date for row in profile.preview(df, ["date"], 1).collect()] == [date(2024, 1, 1)]
