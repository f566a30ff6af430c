"""Queries that write files and read them back: the CSV readers, the partitioned fact, the chunk index, the JSON sink."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checkpoints import materialised
from ..functions import chunk_id, rounded
from ..functions.vectors import embed_hashed
from ..operators import chunking, clean, distinct, evaluate, telemetry, value_cells
from ..sources import (
    append_new_chunks,
    build_if_absent,
    load_all,
    read_assets_csv,
    read_index,
    read_maintenance_csv,
    read_manuals,
    read_telemetry_csv,
    write_documents,
    write_json_report,
)
from ..sources.tables import write_profiled_telemetry, write_telemetry
from ..streaming import index_new_documents
from . import answers, fleet, texts
from .registry import Registry, shown


def _as_csv(df: DataFrame, path: str) -> str:
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)
    return path


def _stored_month_rows(t):
    path = t.folder("telemetry")
    write_telemetry(t.part_telemetry, path)
    return t.part_telemetry.sparkSession.read.parquet(path)


NUMBERS = ["energy_kwh", "availability_pct", "avg_wind_speed_ms"]
# A window that begins and ends within a month, and has whole months between.
WINDOW = ("1995-11-10", "1996-06-20")


def _described_window(t) -> DataFrame:
    """The description of one window, out of the stored cells of its months and the stored readings."""
    stored = _stored_month_rows(t)
    cells = materialised(value_cells.value_cells(stored, NUMBERS))
    return value_cells.describe_window(stored, cells, NUMBERS, *WINDOW)


def _asset_bitmaps(t) -> DataFrame:
    """Stored bitmaps of the assets of each place and month."""
    numbers = distinct.dense_numbers(t.part_telemetry.select("asset_id"))
    return materialised(distinct.asset_bitmaps(t.part_telemetry, numbers, t.part_assets))


def _windows(bitmaps: DataFrame) -> DataFrame:
    """Windows of one, three and twelve months from each month on."""
    months = bitmaps.select("month").distinct().withColumn("length", F.explode(F.array(*map(F.lit, (1, 3, 12)))))
    last = F.last_day(F.add_months("month", F.col("length") - 1))
    return months.select(F.col("month").alias("date_start"), last.alias("date_end"))


WINDOWS_SQL = """
    windows AS (
        SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date_start,
               last_day(date_trunc('month', date) + to_months(length - 1)) AS date_end
        FROM part_telemetry, (VALUES (1), (3), (12)) v(length)),
    seen AS (
        SELECT DISTINCT t.asset_id, location, t.date FROM part_telemetry t LEFT JOIN part_assets a ON t.asset_id = a.asset_id)
"""


def _document_chunks(documents: DataFrame) -> DataFrame:
    return chunking.window_chunks(documents).select(
        chunk_id(F.col("lang"), F.lit(None).cast("string"), F.col("chunk")).alias("id"),
        "lang",
        F.col("chunk").alias("page_content"),
    )


def _indexed(t):
    """Chunks of the English documents first, then those of all; the index holds each id once."""
    chunks = _document_chunks(t.raw("documents").select("doc_id", "lang", "text"))
    spark, path = chunks.sparkSession, t.folder("index")
    build_if_absent(spark, chunks.filter("lang = 'en'"), path, embed_hashed)
    append_new_chunks(spark, chunks, path, embed_hashed)
    return read_index(spark, path)


def _stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A table as a stream of its files; the table is either one file or a folder of them."""
    reader, path = spark.readStream.schema(schema), f"{folder}/{name}.parquet"
    first = spark.read.parquet(path).inputFiles()[0]
    if first.endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def _streamed(t):
    """The same index, filled by a stream over the documents."""
    documents = t.raw("documents").select("doc_id", "lang", "text")
    spark, path = documents.sparkSession, t.folder("index")
    arriving = _stream(spark, t.sf_dir, "documents", documents.schema)
    index_new_documents(arriving, _document_chunks, embed_hashed, path, t.folder("progress")).awaitTermination()
    return read_index(spark, path)


def _report(t, half: str) -> DataFrame:
    """One half of the written report, read back."""
    scored, path = answers.scored_cases(t), t.folder("report")
    write_json_report(evaluate.evaluation_summary(scored), scored, path)
    return scored.sparkSession.read.json(f"{path}/{half}")


def _filed(documents: DataFrame, path: str) -> str:
    """The documents in few text files."""
    write_documents(documents, path)
    return path


def _loaded(t) -> DataFrame:
    """The four sources of one data folder, written as files, loaded together and counted."""
    spark, folder = t.raw_assets.sparkSession, t.folder("fleet")
    _as_csv(t.raw_assets, f"{folder}/assets.csv")
    _as_csv(t.raw_telemetry, f"{folder}/telemetry.csv")
    _as_csv(t.raw_maintenance, f"{folder}/maintenance_logs.csv")
    _filed(t.manuals, f"{folder}/manuals")
    counts = [
        rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("row_count")) for name, rows in load_all(spark, folder, manuals="manuals").items()
    ]
    return reduce(DataFrame.unionByName, counts)


def register(registry: Registry) -> None:
    """Add the queries over stored files."""

    def from_csv(name, read, role, sql):
        registry.add(
            name, lambda t: read(getattr(t, role).sparkSession, _as_csv(getattr(t, role), t.folder(role))), sql, role
        )

    from_csv("assets_from_csv", read_assets_csv, "raw_assets", f"WITH {fleet.CLEAN_ASSETS_SQL} SELECT * FROM assets")
    # An empty field of a CSV file is null, also where the table had an empty string.
    from_csv(
        "telemetry_from_csv",
        lambda spark, path: read_telemetry_csv(spark, path).withColumn("fault_code", F.nullif("fault_code", F.lit(""))),
        "raw_telemetry",
        f"WITH {fleet.CLEAN_TELEMETRY_SQL} SELECT * REPLACE (nullif(fault_code, '') AS fault_code) FROM cleaned",
    )
    from_csv(
        "maintenance_from_csv",
        read_maintenance_csv,
        "raw_maintenance",
        f"WITH {fleet.CLEAN_MAINTENANCE_SQL} SELECT * FROM cleaned",
    )
    registry.add(
        "telemetry_stored_by_month",
        lambda t: telemetry.telemetry_summary(telemetry.select_rows(_stored_month_rows(t), None, "1996-03-01", "1996-06-30")),
        f"SELECT {fleet.SUMMARY_SQL} FROM part_telemetry WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'",
        "part_telemetry",
    )
    registry.add(
        "describe_window",
        lambda t: _described_window(t).select(
            "column",
            "count",
            *[rounded(F.col(name), 4).alias(name) for name in ("mean", "std", "min", "max", "p25", "p50", "p75")],
        ),
        " UNION ALL ".join(
            f"""SELECT '{name}' AS "column", count({name}) AS count, {shown(f"avg({name})", 4)} AS mean,
                {shown(f"stddev_samp({name})", 4)} AS std, {shown(f"min({name})", 4)} AS min, {shown(f"max({name})", 4)} AS max,
                {shown(f"quantile_cont({name}, 0.25)", 4)} AS p25, {shown(f"quantile_cont({name}, 0.5)", 4)} AS p50,
                {shown(f"quantile_cont({name}, 0.75)", 4)} AS p75 FROM part_telemetry
                WHERE date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"""
            for name in NUMBERS
        ),
        "part_telemetry",
    )
    for name, place in (("assets_per_window", []), ("assets_per_place_and_window", ["location"])):

        def per_window(t, place=place):
            bitmaps = _asset_bitmaps(t)
            return distinct.assets_per_window(bitmaps, _windows(bitmaps), place)

        columns = ", ".join(["date_start", "date_end", *place])
        registry.add(
            name,
            per_window,
            f"""WITH {WINDOWS_SQL} SELECT {columns}, count(DISTINCT asset_id) AS asset_count
                FROM windows JOIN seen ON date BETWEEN date_start AND date_end GROUP BY ALL""",
            "part_telemetry part_assets",
        )
    registry.add(
        "observed_profile",
        lambda t: write_profiled_telemetry(clean.clean_telemetry(t.raw_telemetry), t.folder("telemetry")),
        f"""WITH {fleet.CLEAN_TELEMETRY_SQL} SELECT count(*) AS row_count, count(DISTINCT asset_id) AS asset_count,
                min(date) AS first_date, max(date) AS last_date, count(fault_code) AS fault_rows FROM cleaned""",
        "raw_telemetry",
    )
    for name, build in (("index_build_and_append", _indexed), ("index_from_stream", _streamed)):
        registry.add(
            name,
            lambda t, build=build: build(t).select("id", "page_content", F.size("embedding").cast("bigint").alias("dims")),
            f"""WITH {texts.CHUNKS_SQL} SELECT concat('manual_', lang, '_overview_', md5(chunk)) AS id,
                    min(chunk) AS page_content, CAST(256 AS BIGINT) AS dims FROM chunks GROUP BY ALL""",
        )
    registry.add(
        "index_is_complete",
        lambda t: _indexed(t).agg(
            F.count(F.lit(1)).alias("chunks"),
            F.count_distinct("id").alias("ids"),
            F.count_distinct("lang", "page_content").alias("contents"),
        ),
        f"""WITH {texts.CHUNKS_SQL}, once AS (SELECT DISTINCT lang, chunk FROM chunks)
            SELECT count(*) AS chunks, count(*) AS ids, count(*) AS contents FROM once""",
    )
    registry.add(
        "report_summary",
        lambda t: _report(t, "summary").select("total", "passed", "pass_rate", "avg_confidence"),
        f"""WITH {answers.CASES_SQL}
            SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, {shown("avg(CAST(passed AS DOUBLE))", 3)} AS pass_rate,
                {shown("avg(confidence)", 3)} AS avg_confidence FROM scored""",
        "eval_cases eval_outputs",
    )
    registry.add(
        "manual_from_text",
        lambda t: read_manuals(t.manuals.sparkSession, _filed(t.manuals, t.folder("manuals")))
        .withColumn("doc_id", F.col("doc_id").cast("bigint"))
        .drop("doc_type"),
        f"WITH {texts.MANUAL_SQL} SELECT * FROM manual_chunks",
        "manuals",
    )
    registry.add(
        "load_all_profile",
        _loaded,
        f"""WITH {fleet.CLEAN_ASSETS_SQL}, {fleet.CLEAN_TELEMETRY_SQL.replace("cleaned", "readings")},
                {fleet.CLEAN_MAINTENANCE_SQL.replace("cleaned", "events")}, {texts.MANUAL_SQL}
            SELECT 'assets' AS source, count(*) AS row_count FROM assets UNION ALL SELECT 'telemetry', count(*) FROM readings
            UNION ALL SELECT 'maintenance', count(*) FROM events UNION ALL SELECT 'manual', count(*) FROM manual_chunks""",
        "raw_assets raw_telemetry raw_maintenance manuals",
    )
    registry.add(
        "json_report",
        lambda t: _report(t, "per_question").select("id", "passed", "confidence"),
        f"WITH {answers.CASES_SQL} SELECT id, passed, confidence FROM scored",
        "eval_cases eval_outputs",
    )
