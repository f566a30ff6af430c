import itertools
import random
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetspark.operators import intent, resolve


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id bigint, question string")


@pytest.mark.parametrize(
    ("text", "window"),
    [
        ("output last month in March", ((6, 1), (6, 30))),
        ("the past 6 months", ((1, 1), (6, 30))),
        ("the past 3 months", ((4, 1), (6, 30))),
        ("16 months ago", ((1, 1), (6, 30))),
        ("past 30 days", ((4, 1), (6, 30))),
        ("in Q2", ((4, 1), (6, 30))),
        ("in Q1", ((1, 1), (3, 31))),
        ("between January and March", ((1, 1), (1, 31))),
        ("since FEBRUARY", ((2, 1), (2, 29))),
        ("maybe soon", ((5, 1), (5, 31))),
        ("in june", ((6, 1), (6, 30))),
        ("whenever", ((1, 1), (6, 30))),
    ],
)
def test_windows(spark, text, window):
    row = intent.with_intent(questions(spark, text)).first()
    assert (row.date_start, row.date_end) == tuple(date(2024, *day) for day in window)


def test_intent(spark):
    found = intent.with_intent(
        questions(
            spark,
            "Which assets underperform in northern spain last month?",
            "Which assets are below 90?",
            "Which assets are declining in availability in Murcia and Galicia?",
            "Which assets look like wt-001 or PV-2, WT-001?",
            "How is WT-7x or AWT-8?",
        )
    ).collect()
    assert [row.kind for row in found] == ["declining_energy", "low_availability", "combined", "per_asset", "per_asset"]
    assert [row.location for row in found] == ["Northern Spain", None, "Galicia", None, None]
    assert [row.comparison_month for row in found] == ["2024-06", None, None, None, None]
    assert [row.mentioned_ids for row in found][3:] == [["WT-001", "PV-2"], []]


def test_search_filters(spark):
    found = intent.with_search_filters(
        questions(spark, "e-1001 and E-2 by Siemens", "Gamesa or Vestas?", "hi-mo panels", "E-x")
    ).collect()
    assert [(row.fault_code, row.manufacturer) for row in found] == [
        ("E-1001", "Siemens Gamesa"),
        (None, "Vestas"),
        (None, "LONGi Solar"),
        (None, None),
    ]


def test_gate_and_requested_assets(spark, rows):
    results = spark.createDataFrame(
        [(1, 1, "asset_lookup", "oops"), (1, 2, "rag_tool", None), (2, 1, "asset_lookup", None), (3, 1, "rag_tool", "oops")],
        "request_id bigint, source_index int, tool string, error string",
    )
    assert rows(intent.upstream_gate(results)) == [(1, True, "oops"), (2, False, None), (3, False, None)]
    asked = questions(spark, "wt-2 please", "WT-9")
    lookups = spark.createDataFrame([(0, ["WT-002"]), (1, [])], "request_id bigint, asset_ids array<string>")
    assert rows(intent.requested_assets(asked, lookups)) == [(0, ["WT-002"]), (1, ["WT-9"])]


IDS = [f"WT-{n:03d}" for n in range(1, 31)] + [f"PV-{n:03d}" for n in range(1, 21)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def brute_force(raw, ids):
    query = raw.strip().upper()
    if query in ids:
        return query, 0, 1
    prefix = query[:3] if query[:3] in ("WT-", "PV-") else ""
    close = sorted(one for one in ids if one.startswith(prefix) and edit_distance(query, one) == 1)
    return (close[0], 1, len(close)) if close else (None, None, 0)


def resolved(spark, raws, ids):
    queries = spark.createDataFrame([(raw,) for raw in raws], "raw_id string")
    registry = spark.createDataFrame([(one,) for one in ids], "asset_id string")
    return {
        row.raw_id: (row.asset_id, row.distance, row.n_ties) for row in resolve.resolve_ids(queries, registry).collect()
    }


def test_resolve_equals_brute_force(spark):
    generator = random.Random(7)
    raws = {" wt-001 ", "WT-099", "PV-099", "WT001", "WT-1", "XT-001", "PV-0021", "", "-", "WT-", "W", "WT-0O1"}
    for one in IDS:
        place, letter = generator.randrange(len(one)), generator.choice("0123456789WP-")
        raws |= {one[:place] + one[place + 1 :], one[:place] + letter + one[place:], one[:place] + letter + one[place + 1 :]}
    found = resolved(spark, sorted(raws), IDS)
    assert found == {raw: brute_force(raw, IDS) for raw in raws}
    assert found["WT-099"] == ("WT-009", 1, 3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("AB", min_size=1, max_size=4), min_size=1, max_size=12))
def test_resolve_any_strings(spark, ids):
    raws = {"".join(letters) for size in range(5) for letters in itertools.product("AB", repeat=size)}
    ids = sorted(ids)
    assert resolved(spark, sorted(raws), ids) == {raw: brute_force(raw, ids) for raw in raws}


def test_repeated_misspellings_are_resolved_once(spark):
    queries = spark.createDataFrame([("WT-01",)] * 500 + [("WT-001",)], "raw_id string")
    registry = spark.createDataFrame([(one,) for one in IDS], "asset_id string")
    assert resolve.resolve_ids(queries, registry).count() == 2


def test_lookup_statuses(spark):
    asked = questions(spark, "Compare WT-002 and wt-001", "WT-001 and WT-777", "WT-777?", "nothing", "pv-5 WT-099")
    registry = spark.createDataFrame([(one,) for one in IDS], "asset_id string")
    found = {row.request_id: row for row in resolve.lookup_requests(asked, registry).collect()}
    assert [found[i].status for i in range(5)] == ["ok", "partial", "error", "error", "partial"]
    assert found[0].asset_ids == ["WT-002", "WT-001"] and found[0].error is None
    assert found[1].asset_ids == ["WT-001"] and found[1].error == "Asset 'WT-777' not found"
    assert found[3].error == "No asset id in the question" and found[3].asset_ids == []
    assert found[4].asset_ids == ["WT-009"] and found[4].ambiguous_ids == 1


def test_no_side_of_a_resolution_is_broadcast(spark):
    queries, registry = spark.range(9).selectExpr("concat('wt-', id) AS raw_id"), spark.range(5).selectExpr("concat('WT-', id) AS asset_id")
    assert "Broadcast" not in resolve.resolve_ids(queries, registry)._jdf.queryExecution().executedPlan().toString()
