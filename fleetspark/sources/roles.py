"""Role views: the fleet tables as projections of the supplied star schema.

Each view is one SELECT that Spark and DuckDB both understand; `{table}` stands for a table of the schema. Spark reads the
table lazily, so filters and columns still reach the parquet scan.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TELEMETRY_COLUMNS = """
    CAST(l_shipdate AS DATE) AS date,
    l_extendedprice AS energy_kwh,
    CAST(floor(100.5E0 - 100 * l_discount) AS DOUBLE) AS availability_pct,
    CASE WHEN l_linestatus = 'O' THEN l_quantity END AS avg_wind_speed_ms,
    CASE WHEN l_linestatus = 'F' THEN l_quantity END AS irradiance_wm2,
    l_tax AS temperature_c,
    CASE l_returnflag WHEN 'R' THEN concat('E-', CAST(1000 + l_linenumber AS STRING)) WHEN 'A' THEN '' END AS fault_code,
    CASE WHEN l_returnflag = 'R' THEN concat('fault on line ', CAST(l_linenumber AS STRING)) END AS fault_description
"""

MAINTENANCE_COLUMNS = """
    CAST(o_orderdate AS DATE) AS date,
    CASE o_orderstatus WHEN 'F' THEN 'scheduled' WHEN 'O' THEN 'corrective' ELSE 'other' END AS type,
    concat('Fault E-', CAST(1000 + o_orderkey % 9 AS STRING), ' handled') AS description,
    CAST(o_orderkey % 24 AS DOUBLE) AS duration_hours,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'none' ELSE o_orderpriority END AS parts_replaced,
    o_totalprice AS cost_eur
"""

ROLES = {
    # Products as assets: six large classes, and locations of which one may be part of another's name.
    "part_assets": """
        SELECT p_partkey AS asset_id, p_name AS name, p_type AS type, p_brand AS location,
               p_retailprice AS capacity_mw, p_brand AS manufacturer, p_name AS model,
               DATE '1990-01-01' + CAST((p_partkey * 37) % 3650 AS INT) AS install_date,
               CASE WHEN p_size > 40 THEN 'maintenance' ELSE 'operational' END AS status
        FROM {part}
    """,
    "part_telemetry": f"SELECT l_partkey AS asset_id, {TELEMETRY_COLUMNS} FROM {{lineitem}}",
    # Suppliers as assets: few of them, in small classes.
    "supplier_assets": """
        SELECT s_suppkey AS asset_id, s_name AS name, r_name AS type, n_name AS location
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """,
    "supplier_telemetry": f"SELECT l_suppkey AS asset_id, {TELEMETRY_COLUMNS} FROM {{lineitem}}",
    "maintenance": f"SELECT o_orderkey AS log_id, o_custkey AS asset_id, {MAINTENANCE_COLUMNS} FROM {{orders}}",
    # Sparse daily telemetry of one month, for reports whose window is a short one.
    "event_telemetry": """
        SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, value AS energy_kwh,
               100 - value % 20 AS availability_pct,
               CASE WHEN event_type = 'error' THEN 'E-2001' END AS fault_code,
               CASE WHEN event_type = 'error' THEN 'error event' END AS fault_description
        FROM {events}
    """,
    # Text columns as a CSV reader yields them, with padding, bad dates, bad numbers and nulls.
    "raw_assets": """
        SELECT concat(' wt-', CAST(p_partkey AS STRING), ' ') AS asset_id, p_name AS name,
               CASE p_type WHEN 'ECONOMY' THEN 'solar_plant' WHEN 'PROMO' THEN 'wind_turbine' ELSE p_type END AS type,
               p_brand AS location,
               CASE WHEN p_size = 7 THEN 'n/a' WHEN p_size = 8 THEN NULL
                    ELSE CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS STRING) END AS capacity_mw,
               p_brand AS manufacturer, p_name AS model,
               CASE WHEN p_size = 9 THEN 'bad' WHEN p_size = 10 THEN NULL
                    ELSE CAST(DATE '2015-01-01' + CAST((p_partkey * 37) % 3650 AS INT) AS STRING) END AS install_date,
               CASE WHEN p_size > 40 THEN 'maintenance' ELSE 'operational' END AS status
        FROM {part}
    """,
    "raw_telemetry": """
        SELECT concat('pv-', CAST(l_partkey AS STRING), ' ') AS asset_id,
               CASE WHEN l_linenumber = 7 AND l_quantity < 10 THEN 'not a date'
                    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date,
               CASE WHEN l_quantity = 13 THEN 'err' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) END AS energy_kwh,
               CAST(CAST(100 * (1 - l_discount) AS DECIMAL(9, 2)) AS STRING) AS availability_pct,
               CASE WHEN l_linestatus = 'O' THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS avg_wind_speed_ms,
               CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS INT) AS STRING) ELSE 'nan' END AS irradiance_wm2,
               '' AS temperature_c,
               CASE l_returnflag WHEN 'R' THEN concat('E-', CAST(1000 + l_linenumber AS STRING)) WHEN 'A' THEN '' END AS fault_code,
               CASE WHEN l_returnflag = 'R' THEN 'fault' END AS fault_description
        FROM {lineitem}
    """,
    "raw_maintenance": """
        SELECT CAST(o_orderkey AS STRING) AS log_id, concat(' pv-', CAST(o_custkey AS STRING)) AS asset_id,
               CASE WHEN o_orderkey % 50 = 3 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
               CASE o_orderstatus WHEN 'F' THEN 'scheduled' WHEN 'O' THEN 'corrective' ELSE 'other' END AS type,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE concat('Fault E-', CAST(1000 + o_orderkey % 9 AS STRING), ' handled') END AS description,
               CAST(o_orderkey % 24 AS STRING) AS duration_hours,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS parts_replaced,
               CASE WHEN o_orderkey % 11 = 5 THEN 'free' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS cost_eur
        FROM {orders}
    """,
    # Named assets and the questions that name them: some ids are exact, some have a character changed, dropped or added.
    "named_assets": "SELECT concat('WT-', lpad(CAST(c_custkey AS STRING), 9, '0')) AS asset_id FROM {customer}",
    "misspelt_ids": """
        SELECT o_orderkey AS request_id,
               CASE o_orderpriority
                    WHEN '1-URGENT' THEN concat('WT-', lpad(CAST(o_custkey AS STRING), 9, '0'))
                    WHEN '2-HIGH' THEN concat('wt-', lpad(CAST(o_custkey * 10 AS STRING), 9, '0'), ' ')
                    WHEN '3-MEDIUM' THEN concat('WT-', lpad(CAST(o_custkey AS STRING), 8, '0'))
                    WHEN '5-LOW' THEN concat('WT-', lpad(CAST(o_custkey AS STRING), 9, '0'), '7')
                    ELSE concat('PV-', lpad(CAST(o_custkey AS STRING), 9, '0')) END AS raw_id
        FROM {orders}
    """,
    # Questions over the supplier assets, one per event.
    "question_assets": """
        SELECT concat('WT-', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS asset_id, s_name AS name, r_name AS type,
               CASE n_nationkey % 4 WHEN 0 THEN 'Galicia' WHEN 1 THEN 'Northern Spain' WHEN 2 THEN 'Aragon' ELSE 'La Rioja' END AS location
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """,
    "question_telemetry": f"SELECT concat('WT-', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS asset_id, {TELEMETRY_COLUMNS} FROM {{lineitem}}",
    "question_maintenance": f"""
        SELECT o_orderkey AS log_id, concat('WT-', lpad(CAST(o_custkey AS STRING), 5, '0')) AS asset_id, {MAINTENANCE_COLUMNS}
        FROM {{orders}}
    """,
    "questions": """
        SELECT event_id AS request_id,
               concat(
                   CASE event_type
                       WHEN 'view' THEN concat('What is the availability of wt-', lpad(CAST(user_id AS STRING), 5, '0'))
                       WHEN 'click' THEN concat('Compare WT-', lpad(CAST(user_id AS STRING), 5, '0'), ' with WT-', lpad(CAST(event_id % 97 AS STRING), 5, '0'), ' and WT-', lpad(CAST(user_id AS STRING), 5, '0'))
                       WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Which assets underperform' WHEN 1 THEN 'Which assets are below 90 uptime' ELSE 'Which assets are declining in availability' END
                       WHEN 'signup' THEN concat('How much energy did the fleet of E-', CAST(1000 + event_id % 9 AS STRING), ' make, says the Vestas manual')
                       ELSE concat('Is WT-', CAST(event_id AS STRING), ' due, and what does LONGi say on e-', CAST(event_id % 9 AS STRING)) END,
                   CASE event_id % 5 WHEN 0 THEN ' in Galicia' WHEN 1 THEN ' in Southern Spain' ELSE '' END,
                   CASE event_id % 9 WHEN 0 THEN ' last month?' WHEN 1 THEN ' over the past 6 months?' WHEN 2 THEN ' in Q2?'
                       WHEN 3 THEN ' in q1?' WHEN 4 THEN ' in January and March?' WHEN 5 THEN ' since May?'
                       WHEN 6 THEN ' in June?' WHEN 7 THEN ' over the last 3 months?' ELSE '?' END
               ) AS question
        FROM {events}
    """,
    # Manual-like documents around the whole text of each document.
    "manuals": """
        SELECT doc_id,
               concat(
                   'Introduction ', source, chr(10), '----------------', chr(10),
                   CASE WHEN doc_id % 2 = 0 THEN concat('SECTION 1: FIRST', chr(10)) ELSE '' END,
                   '1.1  PERFORMANCE OVERVIEW', chr(10), text, chr(10),
                   '1.2  FAULT CODES', chr(10),
                   'FAULT CODE: E-', CAST(1000 + doc_id % 7 AS STRING), chr(10), 'Name: ', text, chr(10),
                   CASE doc_id % 3 WHEN 0 THEN concat('SECTION 2: SECOND', chr(10)) WHEN 1 THEN concat('SECTION 3: THIRD', chr(10)) ELSE '' END,
                   'FAULT CODE: E-', CAST(2000 + doc_id % 5 AS STRING), chr(10), 'Trigger: ', source, ' is ', lang, chr(10),
                   '----------------', chr(10), 'SECTION 4: GENERAL', chr(10),
                   'FAULT CODE: E-3001', chr(10), text, chr(10), '----------------', chr(10), 'END'
               ) AS text
        FROM {documents}
    """,
    # Search questions: every benchmark passage, some with a fault code or a manufacturer to narrow by.
    "manual_questions": """
        SELECT item_id AS query_id,
               concat(text, CASE item_id % 4 WHEN 0 THEN ' What does E-3001 mean?' WHEN 1 THEN ' What does the Vestas manual say?'
                                             WHEN 2 THEN ' Does LONGi know e-3001?' ELSE '' END) AS question
        FROM {benchmark}
    """,
    # Answers written from results: numbers near and far from the source, and citations with and without one.
    "answers": """
        SELECT o_orderkey AS request_id,
               concat(
                   'The total was ', CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING), ' EUR [Source 1]',
                   CASE WHEN o_orderpriority = '1-URGENT' THEN ' and 77,001.5 more [Source 9]' ELSE '' END,
                   CASE WHEN o_orderpriority = '2-HIGH' THEN concat(' on 2025-07-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')) ELSE '' END,
                   CASE WHEN o_orderpriority = '3-MEDIUM' THEN ' but I''m not sure, I made up 2024 and 7' ELSE '' END,
                   CASE WHEN o_orderstatus = 'F' THEN ' [Source 2] [Source 2]' ELSE '' END
               ) AS answer,
               CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE (o_orderkey % 11) / 10.0E0 END AS judge_score
        FROM {orders}
    """,
    "tool_results": """
        SELECT l_orderkey AS request_id, l_linenumber AS source_index,
               CASE l_linenumber WHEN 1 THEN 'asset_lookup' WHEN 2 THEN 'telemetry_tool' WHEN 3 THEN 'maintenance_tool' ELSE 'rag_tool' END AS tool,
               CASE WHEN failed = 1 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN failed = 1 THEN 'lookup failed' END AS error,
               CASE WHEN failed = 1 THEN NULL
                    WHEN is_open = 1 THEN concat('{{"asset_id":"WT-', CAST(l_partkey AS STRING), '","total":', CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING), '}}')
                    ELSE concat('{{"status":"ok","data":{{"asset_id":"PV-', CAST(l_partkey AS STRING), '","fault_code":"E-', CAST(l_suppkey AS STRING), '","kwh":', CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING), '}}}}') END AS data_json
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
                     min(l_extendedprice) AS l_extendedprice, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS failed,
                     max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS is_open
              FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS numbered
    """,
    # Evaluation: documents as answers, with the labels deciding routing and confidence.
    "eval_cases": """
        SELECT doc_id AS id,
               CASE WHEN doc_id % 4 = 0 THEN array['rag_tool'] WHEN doc_id % 4 = 1 THEN array['asset_lookup', 'telemetry_tool'] ELSE array['telemetry_tool'] END AS expected_tools,
               CASE WHEN doc_id % 5 = 0 THEN array[lang] WHEN doc_id % 5 = 1 THEN array['The', 'tion', source, 'zzz'] ELSE array['er', 'An'] END AS expected_keywords,
               array[CAST(n_chars AS DOUBLE), 12.0E0] AS expected_numbers,
               doc_id % 6 = 0 AS expected_error,
               doc_id % 8 = 0 AS checks_degradation
        FROM {documents}
    """,
    "eval_outputs": """
        SELECT l.doc_id AS id, d.text AS answer, 0.3E0 + 0.3E0 * quality + 0.2E0 * toxic AS confidence,
               CASE WHEN quality = 1 THEN array['asset_lookup', 'telemetry_tool', 'rag_tool'] ELSE array['rag_tool'] END AS tools_used,
               n_chars / 1000.0E0 AS latency_s
        FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id
    """,
}

_TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the schema."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role view as a DataFrame."""
    text = ROLES[name]
    tables = {found: table(spark, sf_dir, found) for found in set(_TABLE.findall(text))}
    return spark.sql(spark_text(text), **tables)


def spark_text(text: str) -> str:
    """The SELECT for Spark, whose array literal is a function call."""
    return re.sub(r"array\[([^\]]*)\]", r"array(\1)", text)


def role_sql(name: str) -> str:
    """The SELECT over the plain table names, for an engine that has them as views."""
    text = ROLES[name]
    return text.format(**{found: found for found in set(_TABLE.findall(text))})
