"""Queries over answers: citations, grounding, evaluation and shaping."""

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import evaluate, grounding, shape
from .registry import Registry, shown

DEGRADED = ("Th", "an", "zzz")

CITED_SQL = r"""
    cited AS (
        SELECT DISTINCT request_id, CAST(unnest(regexp_extract_all(answer, '\[Source (\d+)\]', 1)) AS BIGINT) AS source_index FROM answers)
"""

NUMBERS_SQL = r"""
    answer_numbers AS (
        SELECT DISTINCT request_id, number FROM (
            SELECT request_id, TRY_CAST(replace(unnest(regexp_extract_all(answer, '\b(\d[\d,]*(?:\.\d+)?)\b', 1)), ',', '') AS DOUBLE) AS number FROM answers)
        WHERE number >= 10 AND NOT number BETWEEN 2000 AND 2030),
    source_numbers AS (
        SELECT DISTINCT request_id, number FROM (
            SELECT request_id, TRY_CAST(replace(unnest(regexp_extract_all(data_json, '\b(\d[\d,]*(?:\.\d+)?)\b', 1)), ',', '') AS DOUBLE) AS number
            FROM tool_results WHERE data_json IS NOT NULL)
        WHERE number >= 10 AND NOT number BETWEEN 2000 AND 2030),
    matches AS (
        SELECT a.request_id, a.number, coalesce(bool_or(abs(a.number - s.number) / greatest(abs(s.number), 1) <= 0.015), false) AS matched
        FROM answer_numbers a LEFT JOIN source_numbers s ON a.request_id = s.request_id GROUP BY ALL),
    tallies AS (
        SELECT an.request_id, coalesce(a.n, 0) AS answer_numbers, coalesce(s.n, 0) AS source_numbers, coalesce(a.misses, 0) AS misses
        FROM answers an
        LEFT JOIN (SELECT request_id, count(*) AS n, count(*) FILTER (WHERE NOT matched) AS misses FROM matches GROUP BY request_id) a ON an.request_id = a.request_id
        LEFT JOIN (SELECT request_id, count(*) AS n FROM source_numbers GROUP BY request_id) s ON an.request_id = s.request_id),
    faithful AS (
        SELECT request_id, answer_numbers, source_numbers, CASE WHEN answer_numbers > 0 AND source_numbers > 0 THEN misses ELSE 0 END AS mismatches,
            CAST(CASE WHEN answer_numbers = 0 OR source_numbers = 0 THEN 0 WHEN misses > 0 THEN -0.2 ELSE 0.1 END AS DOUBLE) AS delta_numeric
        FROM tallies)
"""

UNCERTAIN = "|".join(
    (
        "i don''t have access",
        "i cannot access",
        "i''m unable to",
        "as of my knowledge cutoff",
        "i don''t know",
        "cannot be determined",
        "i''m not sure",
        "i am not able",
        "i have no information",
    )
)


def _confidence_sql(with_judge: bool) -> str:
    names = "array_to_string(failed, ',') AS failed_checks," if with_judge else ""
    judge = (
        "CASE WHEN NOT judge_asked THEN 0 WHEN judge_score IS NULL THEN -0.1 WHEN judge_score >= 0.8 THEN 0.1 WHEN judge_score >= 0.5 THEN 0 ELSE -0.15 END"
        if with_judge
        else "0"
    )
    return rf"""
        WITH {CITED_SQL}, {NUMBERS_SQL},
        orphans AS (
            SELECT request_id, count(*) AS n FROM cited c WHERE NOT EXISTS (
                SELECT 1 FROM tool_results r WHERE r.request_id = c.request_id AND r.source_index = c.source_index) GROUP BY request_id),
        data_found AS (SELECT request_id, bool_or(data_json IS NOT NULL AND status <> 'error') AS found FROM tool_results GROUP BY request_id),
        deltas AS (
            SELECT a.request_id, judge_score,
                CASE WHEN a.request_id IN (SELECT request_id FROM cited) THEN 0.2e0 ELSE 0e0 END AS delta_citations,
                CASE WHEN o.n IS NULL THEN 0.1e0 ELSE -0.1e0 END AS delta_indices,
                CASE WHEN coalesce(d.found, false) THEN 0.1e0 ELSE 0e0 END AS delta_data,
                CASE WHEN regexp_matches(lower(answer), '{UNCERTAIN}') THEN 0e0 ELSE 0.1e0 END AS delta_phrases,
                round(-0.2e0 * (CASE WHEN regexp_matches(lower(answer), '\b202[56]-\d{{2}}-\d{{2}}\b') THEN 1 ELSE 0 END
                           + CASE WHEN regexp_matches(lower(answer), 'i (made up|fabricated|invented)') THEN 1 ELSE 0 END), 2) + 0.0 AS delta_patterns,
                f.delta_numeric
            FROM answers a LEFT JOIN orphans o ON a.request_id = o.request_id LEFT JOIN data_found d ON a.request_id = d.request_id
            JOIN faithful f ON a.request_id = f.request_id),
        summed AS (
            SELECT *, round(0.5 + delta_citations + delta_indices + delta_data + delta_phrases + delta_patterns + delta_numeric, 6) AS so_far,
                {"so_far < 0.6" if with_judge else "false"} AS judge_asked, CAST({judge} AS DOUBLE) AS delta_judge FROM deltas),
        final AS (
            SELECT *, {shown("greatest(0, least(1, so_far + delta_judge))", 3)} AS confidence,
                list_filter([CASE WHEN delta_citations = 0 THEN 'citations present' END, CASE WHEN delta_indices < 0 THEN 'valid source indices' END,
                    CASE WHEN delta_data = 0 THEN 'real data returned' END, CASE WHEN delta_phrases = 0 THEN 'no uncertainty phrases' END,
                    CASE WHEN delta_patterns < 0 THEN 'no suspicious patterns' END, CASE WHEN delta_numeric < 0 THEN 'numeric faithfulness' END,
                    CASE WHEN delta_judge < 0 THEN 'semantic judge' END], lambda x: x IS NOT NULL) AS failed
            FROM summed)
        SELECT request_id, confidence, CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level,
            delta_citations, delta_indices, delta_data, delta_phrases, delta_patterns, delta_numeric, delta_judge,
            CASE WHEN delta_numeric > 0 THEN 'pass' WHEN delta_numeric < 0 THEN 'fail' ELSE 'skip' END AS numeric_status,
            CASE WHEN NOT judge_asked THEN 'skip' WHEN delta_judge < 0 THEN 'fail' ELSE 'pass' END AS judge_status,
            {names} CASE len(failed) WHEN 0 THEN 'all checks passed' WHEN 1 THEN 'warning: ' || failed[1] ELSE 'warnings: ' || len(failed) || ' checks failed' END AS checks
        FROM final
    """


CASES_SQL = r"""
    joined AS (
        SELECT c.*, coalesce(o.answer, 'ERROR: no output') AS answer, coalesce(o.confidence, 0) AS confidence, coalesce(o.latency_s, 0) AS latency_s,
               coalesce(o.tools_used, []) AS tools_used
        FROM eval_cases c LEFT JOIN eval_outputs o ON c.id = o.id),
    graded AS (
        SELECT *, list_has_all(tools_used, expected_tools) AS tool_routing_correct,
            len(list_filter(expected_keywords, lambda w: contains(lower(answer), lower(w)))) / len(expected_keywords) AS keyword_recall,
            list_transform(regexp_extract_all(answer, '\b(\d[\d,]*(?:\.\d+)?)\b', 1), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS stated,
            len(list_filter(expected_numbers, lambda e: len(list_filter(stated, lambda s: abs(e - s) / greatest(abs(e), 1) < 0.015)) > 0)) / len(expected_numbers) AS numeric_recall,
            expected_error AND regexp_matches(lower(answer), 'not found|doesn''t exist|did you mean|invalid|check|typo|no asset|skipped') AS has_error_handling,
            checks_degradation AND contains(lower(answer), 'th') AND contains(lower(answer), 'an') AND contains(lower(answer), 'zzz') AS degradation_detected,
            list_filter(expected_tools, lambda w: NOT list_contains(tools_used, w)) AS unused,
            list_filter(expected_numbers, lambda e: len(list_filter(stated, lambda s: abs(e - s) / greatest(abs(e), 1) < 0.015)) = 0) AS unfound,
            list_sort(list_filter(['Th', 'an', 'zzz'], lambda w: checks_degradation AND NOT contains(lower(answer), lower(w)))) AS unnamed
        FROM joined),
    scored AS (
        SELECT id, confidence, latency_s, tool_routing_correct, keyword_recall, numeric_recall, has_error_handling, degradation_detected, unfound,
            concat_ws('; ', CASE WHEN len(unused) > 0 THEN 'tools not used: ' || array_to_string(unused, ', ') END,
                CASE WHEN keyword_recall < 0.5 THEN 'keywords found: ' || CAST(round(keyword_recall * len(expected_keywords)) AS BIGINT) || ' of ' || len(expected_keywords) END,
                nullif(array_to_string(list_transform(unfound, lambda x: 'number not stated: ' || x), '; '), ''),
                CASE WHEN expected_error AND NOT has_error_handling THEN 'no graceful error' END,
                CASE WHEN len(unnamed) > 0 THEN 'degraded assets not named: ' || array_to_string(unnamed, ', ') END) AS notes,
            tool_routing_correct AND keyword_recall >= 0.5 AND numeric_recall >= 0.5 AND confidence >= 0.4 AND (NOT expected_error OR has_error_handling) AS passed
        FROM graded)
"""


def scored_cases(t):
    """The evaluation cases, scored."""
    return evaluate.score_cases(t.eval_cases, t.eval_outputs, DEGRADED)


def register(registry: Registry) -> None:
    """Add the answer queries."""
    both = "answers tool_results"
    registry.add(
        "citations",
        lambda t: grounding.citations(t.answers, t.tool_results),
        f"""WITH {CITED_SQL}
            SELECT r.request_id, CAST(r.source_index AS BIGINT) AS index, tool, tool AS doc_type,
                coalesce(json_extract_string(data_json, '$.data.asset_id'), json_extract_string(data_json, '$.asset_id')) AS asset_id,
                coalesce(json_extract_string(data_json, '$.data.fault_code'), json_extract_string(data_json, '$.fault_code')) AS fault_code,
                CAST(json_extract_string(data_json, '$.manufacturer') AS VARCHAR) AS manufacturer,
                CASE WHEN data_json IS NOT NULL AND error IS NULL THEN 1e0 ELSE 0e0 END AS score, substring(coalesce(data_json, ''), 1, 200) AS snippet
            FROM tool_results r JOIN cited c ON r.request_id = c.request_id AND r.source_index = c.source_index""",
        both,
    )
    registry.add(
        "orphan_citations",
        lambda t: grounding.orphan_citations(t.answers, t.tool_results),
        f"""WITH {CITED_SQL} SELECT request_id, source_index FROM cited c
            WHERE NOT EXISTS (SELECT 1 FROM tool_results r WHERE r.request_id = c.request_id AND r.source_index = c.source_index)""",
        both,
    )
    registry.add(
        "numeric_faithfulness",
        lambda t: grounding.numeric_faithfulness(t.answers, t.tool_results),
        f"WITH {NUMBERS_SQL} SELECT * FROM faithful",
        both,
    )
    registry.add(
        "confidence_score",
        lambda t: grounding.confidence(t.answers, t.tool_results).withColumn("failed_checks", F.array_join("failed_checks", ",")),
        _confidence_sql(True),
        both,
    )
    registry.add(
        "confidence_without_judge",
        lambda t: grounding.confidence(t.answers.drop("judge_score"), t.tool_results).drop("failed_checks"),
        _confidence_sql(False),
        both,
    )
    registry.add(
        "judge_band",
        lambda t: t.answers.select("request_id", grounding.judge_delta(F.col("judge_score")).alias("delta")),
        """SELECT request_id, CAST(CASE WHEN judge_score IS NULL THEN -0.1 WHEN judge_score >= 0.8 THEN 0.1 WHEN judge_score >= 0.5 THEN 0
                  ELSE -0.15 END AS DOUBLE) AS delta FROM answers""",
        "answers",
    )
    registry.add(
        "uncertain_phrases",
        lambda t: grounding.phrase_hits(t.answers),
        """SELECT request_id, 'i''m not sure' AS phrase FROM answers WHERE contains(lower(answer), 'i''m not sure')""",
        "answers",
    )
    registry.add(
        "eval_cases",
        lambda t: scored_cases(t).withColumn("notes", F.array_join("notes", "; ")),
        f"WITH {CASES_SQL} SELECT * EXCLUDE (unfound) FROM scored",
        "eval_cases eval_outputs",
    )
    registry.add(
        "eval_summary",
        lambda t: evaluate.evaluation_summary(scored_cases(t)),
        f"""WITH {CASES_SQL}
            SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, {shown("avg(CAST(passed AS DOUBLE))", 3)} AS pass_rate,
                {shown("avg(confidence)", 3)} AS avg_confidence, {shown("avg(keyword_recall)", 3)} AS avg_keyword_recall,
                {shown("avg(numeric_recall)", 3)} AS avg_numeric_recall, {shown("avg(CAST(tool_routing_correct AS DOUBLE))", 3)} AS tool_routing_accuracy,
                {shown("avg(latency_s)", 2)} AS avg_latency_s, {shown("avg(CASE WHEN confidence < 0.5 THEN 1e0 ELSE 0e0 END)", 3)} AS low_confidence_rate
            FROM scored""",
        "eval_cases eval_outputs",
    )
    registry.add(
        "list_cap_totals",
        lambda t: shape.first_rows_of_lists(
            t.maintenance.select("asset_id", "log_id", "date", "cost_eur"), "asset_id", [F.col("date"), F.col("log_id")]
        ),
        """SELECT asset_id, log_id, date, cost_eur, row_number() OVER (PARTITION BY asset_id ORDER BY date, log_id) AS position,
                count(*) OVER (PARTITION BY asset_id) AS total_count, least(count(*) OVER (PARTITION BY asset_id), 10) AS showing_top
           FROM maintenance QUALIFY position <= 10""",
        "maintenance",
    )
    registry.add(
        "capped_lists",
        lambda t: shape.capped_lists(t.maintenance, "asset_id", [F.col("date"), F.col("log_id")], ["log_id"]).select(
            "asset_id", F.array_join("items.log_id", ",").alias("log_ids"), "total_count", "note"
        ),
        """SELECT asset_id, string_agg(log_id, ',' ORDER BY position) FILTER (WHERE position <= 10) AS log_ids, count(*) AS total_count,
                CASE WHEN count(*) > 10 THEN 'list truncated: showing top 10 of ' || count(*) END AS note
           FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date, log_id) AS position FROM maintenance) GROUP BY asset_id""",
        "maintenance",
    )
    registry.add(
        "truncate_json",
        lambda t: t.raw("documents").select("doc_id", shape.as_json(F.struct("doc_id", "source"), 20).alias("data_json")),
        """SELECT doc_id, CASE WHEN length(j) > 20 THEN substring(j, 1, 20) || chr(10) || '... [truncated]' ELSE j END AS data_json
           FROM (SELECT doc_id, '{"doc_id":' || doc_id || ',"source":"' || source || '"}' AS j FROM documents)""",
    )
    registry.add(
        "numbered_results",
        lambda t: shape.numbered_results(t.tool_results, 40),
        """SELECT request_id, CAST(source_index AS BIGINT) AS source_index,
                CASE WHEN error IS NOT NULL THEN '[Source ' || source_index || '] ' || tool || ' ERROR: ' || error
                     ELSE '[Source ' || source_index || '] ' || tool || ':' || chr(10) ||
                          CASE WHEN length(data_json) > 40 THEN substring(data_json, 1, 40) || chr(10) || '... [truncated]' ELSE data_json END END AS block
           FROM tool_results WHERE error IS NOT NULL OR data_json IS NOT NULL""",
        "tool_results",
    )
    registry.add(
        "answer_context",
        lambda t: shape.answer_context(t.tool_results, 40),
        """WITH blocks AS (
                SELECT request_id, source_index, CASE WHEN error IS NOT NULL THEN '[Source ' || source_index || '] ' || tool || ' ERROR: ' || error
                     ELSE '[Source ' || source_index || '] ' || tool || ':' || chr(10) ||
                          CASE WHEN length(data_json) > 40 THEN substring(data_json, 1, 40) || chr(10) || '... [truncated]' ELSE data_json END END AS block
                FROM tool_results WHERE error IS NOT NULL OR data_json IS NOT NULL)
            SELECT request_id, string_agg(block, chr(10) || chr(10) ORDER BY source_index) AS context FROM blocks GROUP BY request_id""",
        "tool_results",
    )
    registry.add(
        "judge_evidence",
        lambda t: shape.judge_evidence(t.tool_results, 120),
        """SELECT request_id, substring(string_agg('[Source ' || source_index || '] ' || tool || ':' || chr(10) || data_json, chr(10) || chr(10) ORDER BY source_index), 1, 120) AS evidence
           FROM tool_results WHERE error IS NULL AND data_json IS NOT NULL GROUP BY request_id""",
        "tool_results",
    )
    registry.add(
        "recalls",
        lambda t: t.eval_cases.join(t.eval_outputs, "id").select(
            "id",
            rounded(evaluate.keyword_recall(F.col("answer"), F.col("expected_keywords")), 4).alias("keyword_recall"),
            rounded(evaluate.numeric_recall(F.col("answer"), F.col("expected_numbers")), 4).alias("numeric_recall"),
        ),
        f"""WITH {CASES_SQL} SELECT id, {shown("keyword_recall", 4)} AS keyword_recall, {shown("numeric_recall", 4)} AS numeric_recall
            FROM graded WHERE id IN (SELECT id FROM eval_outputs)""",
        "eval_cases eval_outputs",
    )
