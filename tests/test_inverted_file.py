import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.operators import inverted_file, search

SCHEMA = "id bigint, embedding array<float>, code string"


@pytest.fixture(scope="module")
def data(spark):
    """Vectors around 40 centres, with ties, a zero, a null and columns to filter by; and queries near and far."""
    generator = np.random.default_rng(5)
    centres = generator.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.5 * generator.normal(size=12)).tolist(), f"E-{i % 3}") for i in range(2000)]
    rows += [(3000 + i, rows[0][1], "E-0") for i in range(6)] + [(4000, [0.0] * 12, None), (4001, None, "E-1")]
    asked = [(i, (centres[i % 40] + 0.5 * generator.normal(size=12)).tolist(), [None, "E-1"][i % 2]) for i in range(60)]
    asked += [(90, rows[0][1], None), (91, [0.0] * 12, None), (92, None, None)]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<float>, code string")
    return spark.createDataFrame(rows, SCHEMA).repartition(4), queries


@pytest.fixture(scope="module")
def filed(data, tmp_path_factory):
    return inverted_file.InvertedFile.write(data[0], str(tmp_path_factory.mktemp("ivf") / "v"), cells=32)


@pytest.mark.parametrize("filters", [(), ("code",)])
def test_all_probes_are_the_exact_search(data, filed, rows, filters):
    docs, queries = data
    assert rows(filed.search(queries, 5, 32, filters)) == rows(search.top_k_search(docs, queries, 5, filters))


def test_few_probes_find_most(data, filed):
    docs, queries = data
    exact = search.top_k_search(docs, queries.filter("query_id < 90"), 5)
    measured = inverted_file.recall(filed.search(queries.filter("query_id < 90"), 5, 6), exact).first()
    assert measured.queries == 60 and measured.neighbours == 300 and measured.recall >= 0.9


def test_only_the_cells_that_are_asked_for_are_read(data, filed):
    found = filed.search(data[1].filter("query_id = 90"), 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert [row.id for row in sorted(found.collect(), key=lambda r: r["rank"])][0] == 0


def test_every_vector_is_filed_in_the_nearest_cells(data, filed):
    stored = filed.rows().groupBy("id").agg(F.collect_set("cell").alias("cells"), F.first("embedding").alias("embedding")).collect()
    assert len(stored) == 2007
    for row in stored:
        near = np.argsort(-(np.array(row.embedding) @ filed.centres.T), kind="stable")[:2]
        assert not any(row.embedding) or set(row.cells) == set(near.tolist())


def test_the_sample_is_bounded_and_reruns_agree(data):
    first = inverted_file.fit_cells(data[0], 8, sample=100)
    assert first.shape == (8, 12) and (first == inverted_file.fit_cells(data[0].repartition(3), 8, sample=100)).all()


def test_empty_tables(spark, data, tmp_path):
    none = inverted_file.InvertedFile.write(data[0].filter("false"), str(tmp_path / "none"))
    assert none.search(data[1], 5).count() == 0
    assert inverted_file.InvertedFile(spark, str(tmp_path / "none")).search(data[1].filter("false")).count() == 0
