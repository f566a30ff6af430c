import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.functions.vectors import embed_hashed, hashed_vector
from fleetspark.operators import search
from fleetspark.sources import append_new_chunks, build_if_absent, read_index
from fleetspark.sources.vector_table import BUCKETS, appended_batches, stored_ids
from fleetspark.streaming import index_new_documents

VECTORS = "id bigint, embedding array<float>, code string, maker string"
QUERIES = "query_id bigint, embedding array<float>, code string, maker string"


def brute_force(docs, queries, k, filters):
    found = []
    for query_id, vector, *wanted in queries:
        scored = []
        for one, other, *present in docs:
            if any(w is not None and p != w for w, p, use in zip(wanted, present, filters) if use):
                continue
            a, b = np.array(vector, dtype=np.float32).astype(float), np.array(other, dtype=np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b / norm) if norm else 0.0, 4), one))
        found += [(query_id, rank, one, -score) for rank, (score, one) in enumerate(sorted(scored)[:k], 1)]
    return found


@pytest.fixture(scope="module")
def data():
    generator = np.random.default_rng(3)
    docs = [(i, generator.normal(size=6).tolist(), f"E-{i % 3}", ["x", "y", None][i % 3]) for i in range(300)]
    docs += [(300 + i, docs[0][1], "E-0", "x") for i in range(5)] + [(400, [0.0] * 6, "E-0", "x")]
    queries = [
        (0, docs[0][1], None, None),
        (1, generator.normal(size=6).tolist(), "E-1", None),
        (2, generator.normal(size=6).tolist(), "E-0", "x"),
        (3, generator.normal(size=6).tolist(), "E-9", None),
        (4, [0.0] * 6, None, "x"),
    ]
    return docs, queries


@pytest.mark.parametrize("tiles", [(search.ROWS_PER_TILE, search.QUERIES_PER_TILE), (70, 2), (1, 1)])
@pytest.mark.parametrize("k", [1, 5, 1000])
@pytest.mark.parametrize("filters", [(), ("code", "maker")])
def test_search_equals_brute_force(spark, data, tiles, k, filters, monkeypatch):
    monkeypatch.setattr(search, "ROWS_PER_STEP", 64)
    docs, queries = data
    found = search.top_k_search(
        spark.createDataFrame(docs, VECTORS).repartition(5),
        spark.createDataFrame(queries, QUERIES),
        k,
        filters,
        *tiles,
    )
    assert sorted(tuple(row) for row in found.collect()) == brute_force(docs, queries, k, [bool(filters)] * 2)


def test_search_is_lazy_and_reads_what_it_needs(spark, data, tmp_path):
    docs, queries = data
    spark.createDataFrame(docs, VECTORS).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("search", "")
    before = len(jobs("search"))
    found = search.top_k_search(stored, spark.createDataFrame(queries, QUERIES), 5, ("code",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(jobs("search")) == before and "ReadSchema: struct<id:bigint,embedding:array<float>,code:string>" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_without_a_vector_are_left_out(spark):
    docs = spark.createDataFrame([(1, [1.0], None, None), (2, None, None, None)], VECTORS)
    asked = spark.createDataFrame([(1, [1.0], None, None), (2, None, None, None)], QUERIES)
    assert [tuple(row) for row in search.top_k_search(docs, asked).collect()] == [(1, 1, 1, 1.0)]


def test_empty_sides(spark, data):
    docs, queries = data
    vectors, asked = spark.createDataFrame(docs, VECTORS), spark.createDataFrame(queries, QUERIES)
    assert search.top_k_search(vectors, asked.filter("false")).count() == 0
    assert search.top_k_search(vectors.filter("false"), asked).count() == 0
    assert search.top_k_search(vectors.filter("false"), asked, 5, ("code",)).count() == 0


def test_gate(spark, rows):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    hits = spark.createDataFrame([(1, 0.3), (1, 0.1), (2, 0.2999)], "query_id bigint, score double")
    assert rows(search.relevance_gate(queries, hits)) == [
        (1, 0.3, None, True),
        (2, 0.2999, "low relevance", False),
        (3, None, "no documents retrieved", False),
    ]


def test_context_and_citations(spark, rows):
    hits = spark.createDataFrame(
        [(1, 2, 0.5, "b", None, "V", "M", "narrative"), (1, 1, 0.7, "a", "E-1", "V", "M", "fault_code")],
        "query_id bigint, rank bigint, score double, page_content string, fault_code string, manufacturer string, model string, chunk_type string",
    )
    label = search.source_label(F.col("fault_code"), F.col("manufacturer"), F.col("model"), F.col("chunk_type"))
    context = search.numbered_context(hits, label).first()
    assert context.context == (
        "[Source 1] OEM Manual | V M | E-1 (fault_code)\na\n\n---\n[Source 2] OEM Manual | V M | overview (narrative)\nb\n"
    )
    assert (context.chunks_used, context.best_score) == (2, 0.7)
    answers = spark.createDataFrame([(1, "yes [Source 2] [Source 2] [Source 9]")], "query_id bigint, answer string")
    assert rows(search.cited_chunks(answers, hits), "rank", "snippet") == [(2, "b...")]


def test_hashed_vectors_are_unit_or_zero(spark):
    texts = spark.createDataFrame([("Gear box, gear!",), ("gear GEAR box",), ("...",), (None,)], "text string")
    vectors = [row[0] for row in texts.select(hashed_vector(F.col("text"), 16)).collect()]
    assert vectors[0] == vectors[1]
    assert np.linalg.norm(vectors[0]) == pytest.approx(1.0, abs=1e-6)
    assert vectors[2] == vectors[3] == [0.0] * 16


def chunks(spark, *ids):
    return spark.createDataFrame([(one, f"text of {one}") for one in ids], "id string, page_content string")


def test_index_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    append_new_chunks(spark, chunks(spark, "a", "b", "a"), path, embed_hashed)
    append_new_chunks(spark, chunks(spark, "b", "c"), path, embed_hashed)
    append_new_chunks(spark, chunks(spark, "a", "b", "c"), path, embed_hashed)
    assert sorted(row.id for row in read_index(spark, path).collect()) == ["a", "b", "c"]
    assert build_if_absent(spark, chunks(spark, "z"), path, embed_hashed).count() == 3
    assert build_if_absent(spark, chunks(spark, "z"), str(tmp_path / "other"), embed_hashed).count() == 1


def test_stream_indexes_each_document_once(spark, tmp_path):
    source, index = tmp_path / "documents", str(tmp_path / "index")
    chunks(spark, "a", "b").coalesce(1).write.parquet(str(source))

    def run():
        stream = spark.readStream.schema("id string, page_content string").parquet(str(source))
        query = index_new_documents(stream, lambda batch: batch, embed_hashed, index, str(tmp_path / "state"))
        query.awaitTermination(120)

    run()
    chunks(spark, "b", "c").coalesce(1).write.mode("append").parquet(str(source))
    run()
    run()
    assert sorted(row.id for row in read_index(spark, index).collect()) == ["a", "b", "c"]


def test_an_append_reads_the_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    append_new_chunks(spark, chunks(spark, *[f"c{i}" for i in range(300)]), path, embed_hashed)
    held = stored_ids(spark, path, [3, 5])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<id:string>" in plan
    assert {row.bucket for row in held.collect()} == {3, 5}
    assert len({row.bucket for row in spark.read.parquet(path).select("bucket").collect()}) == BUCKETS


def test_a_batch_is_known_by_the_manifest(spark, tmp_path):
    """A batch that is done is passed over unread; one that was cut off before the manifest adds what is missing."""
    path = str(tmp_path / "index")
    append_new_chunks(spark, chunks(spark, "a", "b"), path, embed_hashed, "one#0")
    append_new_chunks(spark, chunks(spark, "never read"), path, lambda df: 1 / 0, "one#0")
    # Cut off: the chunks are there, the manifest is not.
    append_new_chunks(spark, chunks(spark, "c"), path, embed_hashed)
    append_new_chunks(spark, chunks(spark, "c", "d"), path, embed_hashed, "one#1")
    assert sorted(row.id for row in read_index(spark, path).collect()) == ["a", "b", "c", "d"]
    assert sorted(map(tuple, appended_batches(spark, path).collect())) == [("one#0", 2), ("one#1", 1)]


def test_an_append_shuffles_texts_and_no_vectors(spark, tmp_path):
    """The embedding step gets rows that are dealt to their buckets already, after two shuffles of texts."""
    path, plans = str(tmp_path / "index"), []

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return embed_hashed(df)

    append_new_chunks(spark, chunks(spark, "a", "b"), path, noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        append_new_chunks(spark, chunks(spark, "b", "c"), path, noted, "one#0")
        append_new_chunks(spark, chunks(spark, "b", "d", None), path, noted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(plan.startswith("RebalancePartitions [bucket") for plan in plans[::2])
    # Each id once, the stored ids, and the buckets: the first serves the join too.
    assert plans[-1].count("Exchange hashpartitioning") == 3
    assert sorted((row.id or "", len(row.embedding)) for row in read_index(spark, path).collect()) == [("", 256), *((i, 256) for i in "abcd")]


def test_hashed_vectors_are_those_of_a_plain_count(spark):
    texts = [None, "", "..", "a", "b a B", "Ünï " * 3000 + "x", *(" ".join(f"w{j % 7}{i}" for j in range(i)) for i in range(40))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    for weights in (None, [0.1 * k for k in range(16)]):
        plan = rows.select("id", hashed_vector(F.col("text"), 16, weights).alias("v"))
        assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
        for row in plan.collect():
            counts = np.zeros(16)
            for word in re.findall(r"\w+", (texts[row.id] or "").lower()):
                counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16] += 1
            counts = counts if weights is None else counts * np.array(weights)
            norm = np.linalg.norm(counts)
            assert row.v == pytest.approx(counts / norm if norm else counts, abs=1e-6)


def test_contents_of_chunks_without_a_hit_stay_in_place(spark, tmp_path):
    spark.range(2000).selectExpr("cast(id as string) AS id", "repeat(sha2(cast(id as string), 512), 200) AS page_content").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    # The planner cannot tell that these are few.
    few = spark.range(10_000_000).filter("id < 40")
    hits = few.select((F.col("id") % 8).alias("query_id"), F.col("id").cast("string").alias("id"), F.lit(1).alias("rank"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        joined = search.with_content(hits, docs, ["page_content"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert joined.count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
