"""Readers, writers and the role views that map tables onto the fleet model."""

from .results import write_json_report
from .tables import (
    load_all,
    read_assets_csv,
    read_documents,
    read_maintenance_csv,
    read_manual,
    read_manual_lines,
    read_manuals,
    read_telemetry_csv,
    write_documents,
)
from .vector_table import append_new_chunks, build_if_absent, read_index

__all__ = [
    "append_new_chunks",
    "build_if_absent",
    "load_all",
    "read_assets_csv",
    "read_documents",
    "read_index",
    "read_maintenance_csv",
    "read_manual",
    "read_manual_lines",
    "read_manuals",
    "read_telemetry_csv",
    "write_documents",
    "write_json_report",
]
