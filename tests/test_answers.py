import json
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.functions import extract_numbers
from fleetspark.operators import evaluate, grounding, shape

RESULTS = "request_id bigint, source_index int, tool string, status string, error string, data_json string"


def numbers_in(spark, text, significant_only=True):
    return spark.createDataFrame([(text,)], "t string").select(extract_numbers(F.col("t"), significant_only)).first()[0]


def test_numbers(spark):
    text = "9.99 10 1999 2000 2030 2031 1,234.5 -45 10 WT-123 7"
    assert numbers_in(spark, text) == [10.0, 1999.0, 2031.0, 1234.5, 45.0, 123.0]
    assert numbers_in(spark, "2024 3.5", significant_only=False) == [2024.0, 3.5]
    assert numbers_in(spark, "none") == []


def test_band_equals_the_formula(spark):
    generator = random.Random(11)
    answers, sources = [], []
    for key in range(60):
        base = generator.choice([10.0, 99.5, 1234.5, 5e6, 7e11])
        mine = [max(10.0, base * generator.uniform(0.9, 1.1)) for _ in range(6)]
        edge = mine[0]
        theirs = [max(10.0, base * generator.uniform(0.9, 1.1)) for _ in range(generator.randrange(1, 6))]
        theirs += generator.choice([[edge / 1.015], [edge / 0.985], [edge / 1.015 * 0.99999], [edge / 0.985 * 1.00001], []])
        answers += [(key, n) for n in mine]
        sources += [(key, n) for n in theirs]
    schema = "request_id bigint, number double"
    found = grounding.numeric_matches(spark.createDataFrame(answers, schema), spark.createDataFrame(sources, schema))
    expected = {
        (key, n): any(abs(n - s) / max(abs(s), 1) <= 0.015 for other, s in sources if other == key) for key, n in answers
    }
    assert {(row.request_id, row.number): row.matched for row in found.collect()} == expected
    assert len(set(expected.values())) == 2


def test_band_meets_a_fixed_number_of_rows_per_number(spark):
    sources = spark.range(200_000).select(F.lit(1).cast("bigint").alias("request_id"), (F.col("id") / 100 + 10).alias("number"))
    answers = spark.createDataFrame([(1, 500.0), (1, 1e9)], "request_id bigint, number double")
    assert {row.number: row.matched for row in grounding.numeric_matches(answers, sources).collect()} == {500.0: True, 1e9: False}
    buckets = sources.groupBy(F.floor(F.log("number") / 0.015)).count().count()
    assert buckets < 1000


def results(spark, *rows):
    return spark.createDataFrame(list(rows), RESULTS)


def answers(spark, *rows, judge=False):
    schema = "request_id bigint, answer string" + (", judge_score double" if judge else "")
    return spark.createDataFrame(list(rows), schema)


OK = (1, 1, "telemetry_tool", "ok", None, '{"status":"ok","data":{"asset_id":"WT-1","kwh":1000}}')


@pytest.mark.parametrize(
    ("text", "deltas", "confidence", "checks"),
    [
        ("It made 1,010 kWh [Source 1]", (0.2, 0.1, 0.1, 0.1, 0.0, 0.1), 1.0, "all checks passed"),
        ("It made kWh [Source 1]", (0.2, 0.1, 0.1, 0.1, 0.0, 0.0), 1.0, "all checks passed"),
        ("It made 1,020 kWh", (0.0, 0.1, 0.1, 0.1, 0.0, -0.2), 0.6, "warnings: 2 checks failed"),
        ("Made [Source 2]", (0.2, -0.1, 0.1, 0.1, 0.0, 0.0), 0.8, "warning: valid source indices"),
        ("I'm not sure [Source 1]", (0.2, 0.1, 0.1, 0.0, 0.0, 0.0), 0.9, "warning: no uncertainty phrases"),
        ("I invented 2025-01-02 [Source 1]", (0.2, 0.1, 0.1, 0.1, -0.4, 0.0), 0.6, "warning: no suspicious patterns"),
    ],
)
def test_rubric(spark, text, deltas, confidence, checks):
    row = grounding.confidence(answers(spark, (1, text)), results(spark, OK)).first()
    names = ("citations", "indices", "data", "phrases", "patterns", "numeric")
    assert tuple(row[f"delta_{name}"] for name in names) == deltas
    assert row.confidence == confidence and row.checks == checks
    assert row.judge_status == "skip"


@pytest.mark.parametrize(
    ("judge", "confidence", "status"), [(0.8, 0.5, "pass"), (0.5, 0.4, "pass"), (0.49, 0.25, "fail"), (None, 0.3, "fail")]
)
def test_judge_is_asked_below_the_trigger(spark, judge, confidence, status):
    low = grounding.confidence(answers(spark, (1, "I invented 1,020 of it", judge), judge=True), results(spark, OK)).first()
    assert (low.confidence, low.judge_status) == (confidence, status)
    high = grounding.confidence(answers(spark, (1, "fine [Source 1]", judge), judge=True), results(spark, OK)).first()
    assert high.judge_status == "skip" and high.confidence == 1.0


def test_no_data_counts_as_data_and_errors_do_not(spark):
    asked = answers(spark, (1, "x"), (2, "x"), (3, "x"))
    found = grounding.confidence(
        asked,
        results(
            spark,
            (1, 1, "t", "ok", None, '{"status":"no_data"}'),
            (2, 1, "t", "error", "bad", None),
        ),
    )
    assert {row.request_id: row.delta_data for row in found.collect()} == {1: 0.1, 2: 0.0, 3: 0.0}


def test_citation_records(spark, rows):
    found = grounding.citations(
        answers(spark, (1, "[Source 1] [Source 2] [Source 7]")),
        results(spark, OK, (1, 2, "rag_tool", None, "failed", None), (1, 3, "x", "ok", None, "{}")),
    )
    assert rows(found, "index", "tool", "asset_id", "score", "snippet") == [
        (1, "telemetry_tool", "WT-1", 1.0, OK[5]),
        (2, "rag_tool", None, 0.0, ""),
    ]
    assert rows(grounding.orphan_citations(answers(spark, (1, "[Source 1] [Source 7]")), results(spark, OK))) == [(1, 7)]


CASES = (
    "id string, expected_tools array<string>, expected_keywords array<string>, expected_numbers array<double>, "
    "expected_error boolean, checks_degradation boolean"
)
OUTPUTS = "id string, answer string, confidence double, tools_used array<string>, latency_s double"


def test_cases(spark):
    cases = spark.createDataFrame(
        [
            ("all", ["a"], ["Gear", "oil"], [100.0], None, None),
            ("half", ["a"], ["gear", "none"], [100.0, 5.0], None, None),
            ("routing", ["a", "b"], [], [], None, None),
            ("unsure", ["a"], None, None, None, None),
            ("sure", ["a"], None, None, None, None),
            ("error", ["a"], [], [], True, None),
            ("no error", ["a"], [], [], True, None),
            ("named", ["a"], [], [], None, True),
            ("unnamed", ["a"], [], [], None, True),
            ("missing", [], ["x"], [], None, None),
        ],
        CASES,
    )
    outputs = spark.createDataFrame(
        [
            ("all", "gear OIL 101.4", 0.9, ["a", "b"], 1.0),
            ("half", "Gear 98.6", 0.9, ["a"], 1.0),
            ("routing", "x", 0.9, ["a"], 1.0),
            ("unsure", "x", 0.399, ["a"], 1.0),
            ("sure", "x", 0.4, ["a"], 1.0),
            ("error", "WT-9 was NOT FOUND", 0.9, ["a"], 1.0),
            ("no error", "all fine", 0.9, ["a"], 1.0),
            ("named", "pv-004, PV-005", 0.9, ["a"], 1.0),
            ("unnamed", "PV-004", 0.9, ["a"], 2.05),
        ],
        OUTPUTS,
    )
    scored = evaluate.score_cases(cases, outputs, ("PV-005", "PV-004"))
    found = {row.id: row for row in scored.collect()}
    assert {name for name, row in found.items() if row.passed} == {"all", "half", "sure", "error", "named", "unnamed"}
    assert (found["half"].keyword_recall, found["half"].numeric_recall) == (0.5, 0.5)
    assert found["unsure"].keyword_recall == 1.0 and found["unsure"].numeric_recall == 1.0
    assert found["named"].degradation_detected and not found["unnamed"].degradation_detected
    assert found["all"].notes == [] and found["unnamed"].notes == ["degraded assets not named: PV-005"]
    assert found["half"].notes == ["number not stated: 5.0"] and found["routing"].notes == ["tools not used: b"]
    assert found["no error"].notes == ["no graceful error"] and found["missing"].notes == ["keywords found: 0 of 1"]
    assert found["missing"].confidence == 0.0 and found["missing"].keyword_recall == 0.0
    summary = evaluate.evaluation_summary(scored).first()
    assert (summary.total, summary.passed, summary.pass_rate) == (10, 6, 0.6)
    assert summary.low_confidence_rate == 0.3 and summary.avg_latency_s == 1.01
    assert evaluate.evaluation_summary(scored.filter("false")).count() == 0


def test_number_bound_is_strict(spark):
    df = spark.createDataFrame([("1015 and 985.1", [1000.0]), ("1015", [1000.0]), ("0.5", [-0.2])], "a string, n array<double>")
    assert [row[0] for row in df.select(evaluate.numeric_recall(F.col("a"), F.col("n"))).collect()] == [1.0, 0.0, 0.0]


def test_json_report(spark, tmp_path):
    from fleetspark.sources import write_json_report

    summary = spark.createDataFrame([(1,)], "total bigint")
    write_json_report(summary, spark.createDataFrame([("Q1", True)], "id string, passed boolean"), str(tmp_path))
    assert spark.read.json(str(tmp_path / "summary")).first().total == 1
    assert spark.read.json(str(tmp_path / "per_question")).first().id == "Q1"


def test_lists_are_cut_with_totals(spark):
    items = spark.createDataFrame([("a", i) for i in range(12)] + [("b", 1)], "key string, n bigint")
    found = {row.key: row for row in shape.capped_lists(items, "key", [F.desc("n")], ["n"]).collect()}
    assert [one.n for one in found["a"].items] == list(range(11, 1, -1))
    assert found["a"].total_count == 12 and found["a"].note == "list truncated: showing top 10 of 12"
    assert found["b"].note is None and found["b"].total_count == 1
    plan = shape.first_rows_of_lists(items, "key", [F.desc("n")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_text_caps(spark):
    row = spark.createDataFrame([("x" * 50,)], "a string").select(
        shape.as_json(F.struct("a"), 10).alias("cut"),
        shape.as_json(F.struct("a"), 58).alias("whole"),
        shape.with_note(F.lit("{}"), F.lit("cut")).alias("noted"),
        shape.with_note(F.lit("{}"), F.lit(None)).alias("plain"),
    ).first()
    assert row.cut == '{"a":"xxxx\n... [truncated]' and json.loads(row.whole) == {"a": "x" * 50}
    assert row.noted == "cut\n\n{}" and row.plain == "{}"


def test_evidence(spark, rows):
    table = results(
        spark,
        (1, 1, "a", "ok", None, '{"x":1}'),
        (1, 2, "b", None, "bad", None),
        (1, 3, "c", "ok", None, "y" * 50),
        (1, 4, "d", "ok", None, None),
    )
    assert rows(shape.numbered_results(table, 20), "source_index", "block") == [
        (1, '[Source 1] a:\n{"x":1}'),
        (2, "[Source 2] b ERROR: bad"),
        (3, "[Source 3] c:\n" + "y" * 20 + "\n... [truncated]"),
    ]
    evidence = '[Source 1] a:\n{"x":1}\n\n[Source 3] c:\n' + "y" * 50
    assert shape.judge_evidence(table).first().evidence == evidence
    assert shape.judge_evidence(table, 30).first().evidence == evidence[:30]


def test_evidence_of_a_request_with_very_many_results(spark):
    table = spark.range(1, 20_001).select(
        F.lit(1).cast("bigint").alias("request_id"),
        F.col("id").cast("int").alias("source_index"),
        F.lit("t").alias("tool"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit("{}").alias("data_json"),
    )
    whole = "\n\n".join(f"[Source {i}] t:\n{{}}" for i in range(1, 1001))
    assert shape.judge_evidence(table).first().evidence == whole[:6000]


def test_results_are_read_once(spark, tmp_path):
    """The checks share one pass over the results; what they need of them is stored."""
    results(spark, OK).write.parquet(str(tmp_path / "results"))
    stored, written = spark.read.parquet(str(tmp_path / "results")), answers(spark, (1, "5,000 and 77 [Source 1]"), (2, "none"))
    for found in (grounding.confidence(written, stored), grounding.numeric_faithfulness(written, stored)):
        assert found.count() == 2
        assert not [file for file in found.inputFiles() if "/results/" in file]


def test_source_numbers_are_distinct_over_results(spark):
    """A number that several results have counts once, and numbers of one bucket count each."""
    found = grounding.numeric_faithfulness(
        answers(spark, (1, "500 and 9000"), (2, "12")),
        results(spark, *[(1, i, "rag_tool", "ok", None, data) for i, data in enumerate(['{"a": 500, "b": 501}', '{"a": 500}', None])]),
    )
    shown = {r.request_id: (r.answer_numbers, r.source_numbers, r.mismatches) for r in found.collect()}
    assert shown == {1: (2, 2, 1), 2: (1, 0, 0)}
