"""Column functions shared by the operators. All are built from Spark's own expressions."""

from .dates import date_range_error, infer_date_range, month_label
from .arrays import explode_rows, once
from .numeric import clamp01, rounded
from .text import (
    asset_ids,
    chunk_id,
    cited_indices,
    clean_text,
    contains_any,
    extract_numbers,
    fault_code_in,
    manufacturer_in,
    matching,
    normalise_key,
    truncate_with_marker,
)

__all__ = [
    "asset_ids",
    "chunk_id",
    "cited_indices",
    "clamp01",
    "clean_text",
    "contains_any",
    "date_range_error",
    "explode_rows",
    "extract_numbers",
    "fault_code_in",
    "infer_date_range",
    "manufacturer_in",
    "matching",
    "month_label",
    "normalise_key",
    "once",
    "rounded",
    "truncate_with_marker",
]
