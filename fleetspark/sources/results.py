"""JSON sink of evaluation results."""

from pyspark.sql import DataFrame


def write_json_report(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """Write the one-row summary and the per-case detail as JSON lines under `path`."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/per_question")
