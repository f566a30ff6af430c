"""Readers for the three CSV tables and the text manual. Every column is read as text and cast in `operators.clean`."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, clean

# The columns of each file.
ASSET_COLUMNS = (
    "asset_id",
    "name",
    "type",
    "location",
    "latitude",
    "longitude",
    "capacity_mw",
    "manufacturer",
    "model",
    "install_date",
    "status",
)
REQUIRED_ASSET_COLUMNS = (
    "asset_id",
    "type",
    "location",
    "capacity_mw",
    "manufacturer",
    "model",
    "install_date",
    "status",
)


def _read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    # Without inferSchema a header read yields STRING columns and looks at one line only.
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_assets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned asset dimension. Raises when a required column is missing or an asset id occurs twice."""
    raw = _read_text_columns(spark, path)
    clean.require_columns(raw, REQUIRED_ASSET_COLUMNS)
    assets = clean.clean_assets(raw)
    clean.require_unique(assets, "asset_id")
    return assets


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned telemetry fact; rows without a readable date are dropped."""
    return clean.clean_telemetry(_read_text_columns(spark, path))


def read_maintenance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned maintenance fact; rows without a readable date are kept with a null date."""
    return clean.clean_maintenance(_read_text_columns(spark, path))


def read_manual(spark: SparkSession, path: str, size: int = 600, overlap: int = 100) -> DataFrame:
    """Chunks of every text file under the path; one document per file."""
    documents = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc_id"), F.col("value").alias("text")
    )
    return chunking.manual_chunks(documents, size=size, overlap=overlap)


def read_manual_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of every text file under the path: `doc_id` (the file), `line_no` (which orders its lines) and `line`.

    A file is read by as many tasks as its size asks for. A line is placed by where its split begins and by its number there.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("doc_id"), place.alias("line_no"), F.col("value").alias("line"))


# Marks of a file of many documents: between documents, between id and text, and before a mark that is part of a document.
_RECORD, _FIELD, _ESCAPE = "\x1e", "\x1f", "\x1b"
_WRITTEN_AS = {_ESCAPE: "\x1b[", _RECORD: "\x1b^", _FIELD: "\x1b_"}


def _where_any(name: str, marks: Iterable[str], replaced: Column) -> Column:
    """`replaced` where the column holds one of the marks, else the column itself; to find none takes far less than to replace none."""
    found = reduce(Column.__or__, [F.contains(F.col(name), F.lit(mark)) for mark in marks])
    return F.when(found, replaced).otherwise(F.col(name))


def write_documents(documents: DataFrame, path: str) -> None:
    """Store `doc_id` and `text` of many documents in few text files.

    A document ends in a mark of its own, so its lines stay as they are and its end is found from any byte on. Marks within a
    document are escaped. Null text is empty.
    """

    def escaped(name: str) -> Column:
        value = F.col(name)
        for mark, shown in _WRITTEN_AS.items():
            value = F.replace(value, F.lit(mark), F.lit(shown))
        return _where_any(name, _WRITTEN_AS, value)

    fields = documents.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("doc_id", "text")])
    records = fields.select(F.concat(escaped("doc_id"), F.lit(_FIELD), escaped("text")).alias("value"))
    records.write.option("lineSep", _RECORD).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id` (text) and `text` of what `write_documents` stored.

    Spark splits files at any byte and each task begins at the next mark, so neither many documents in a file nor a large file
    keep to one task.
    """

    def plain(name: str) -> Column:
        value = F.col(name)
        for mark, shown in reversed(_WRITTEN_AS.items()):
            value = F.replace(value, F.lit(shown), F.lit(mark))
        return _where_any(name, [_ESCAPE], value).alias(name)

    # A regular expression would have the whole document decoded to cut it at its first mark.
    stored = spark.read.option("lineSep", _RECORD).text(path).withColumn("at", F.instr("value", _FIELD))
    cut = F.col("at") > 0
    fields = stored.select(
        F.when(cut, F.substring("value", F.lit(1), F.col("at") - 1)).otherwise(F.col("value")).alias("doc_id"),
        F.when(cut, F.substring("value", F.col("at") + 1, F.length("value"))).alias("text"),
    )
    return fields.select(plain("doc_id"), plain("text"))


def read_manuals(spark: SparkSession, path: str, size: int = 600, overlap: int = 100) -> DataFrame:
    """Chunks of many manuals in few files, as `write_documents` stores them."""
    return chunking.manual_chunks(read_documents(spark, path), size=size, overlap=overlap)


def load_all(
    spark: SparkSession, data_dir: str, size: int = 600, overlap: int = 100, manuals: str | None = None
) -> dict[str, DataFrame]:
    """The four sources of a data folder, by role. They are lazy; persist the ones that several reports share.

    The manual is one text file, or with `manuals` a folder of many manuals, by its name in the data folder.
    """
    if manuals is None:
        manual = read_manual(spark, f"{data_dir}/manual_excerpts.txt", size, overlap)
    else:
        manual = read_manuals(spark, f"{data_dir}/{manuals}", size, overlap)
    return {
        "assets": read_assets_csv(spark, f"{data_dir}/assets.csv"),
        "telemetry": read_telemetry_csv(spark, f"{data_dir}/telemetry.csv"),
        "maintenance": read_maintenance_csv(spark, f"{data_dir}/maintenance_logs.csv"),
        "manual": manual,
    }


def _by_month(telemetry: DataFrame) -> DataFrame:
    by_month = telemetry.withColumn("month", F.date_format("date", "yyyy-MM"))
    return by_month.hint("rebalance", "month")


def write_telemetry(telemetry: DataFrame, path: str) -> None:
    """Store the fact as parquet partitioned by month, so that date filters prune whole folders.

    The rebalance hint brings the rows of a month together and lets adaptive execution split a large month over as many
    tasks, and thus files, as the advisory partition size asks for.
    """
    _by_month(telemetry).write.mode("overwrite").partitionBy("month").parquet(path)


def write_profiled_telemetry(telemetry: DataFrame, path: str) -> DataFrame:
    """Store the fact by month and return its load profile, as `telemetry_profile` gives it, out of the pass that writes.

    The figures are observed in the stage that writes, whose tasks count once however often executors are lost. Distinct assets
    cannot be observed; they come from the id column of what was stored, so the source is read once.
    """
    seen = Observation()
    observed = _by_month(telemetry).observe(
        seen,
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("fault_code").alias("fault_rows"),
    )
    observed.write.mode("overwrite").partitionBy("month").parquet(path)
    figures = seen.get
    stored = telemetry.sparkSession.read.schema(telemetry.schema).parquet(path)
    return stored.agg(F.countDistinct("asset_id").alias("asset_count")).select(
        F.lit(figures["row_count"]).cast("bigint").alias("row_count"),
        "asset_count",
        *[F.lit(figures[name]).cast("date").alias(name) for name in ("first_date", "last_date")],
        F.lit(figures["fault_rows"]).cast("bigint").alias("fault_rows"),
    )
