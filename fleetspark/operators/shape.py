"""Shaping of results for display: list caps with totals, JSON, and numbered evidence."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import truncate_with_marker

# List cap, text caps, and the mark of a cut text.
LIST_CAP = 10
MAX_CHARS = 8000
JUDGE_CHARS = 6000
TRUNCATED = "\n... [truncated]"
SEPARATOR = "\n\n"


def first_rows_of_lists(
    items: DataFrame, keys: str | list[str], order: Iterable[Column], cap: int = LIST_CAP
) -> DataFrame:
    """The first rows of each list, with `position`, `showing_top` and `total_count`.

    The rank filter limits each list before the shuffle, and totals are a separate aggregate. A count over the same
    window would carry every row of a long list to one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranked = items.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    totals = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"))
    return (
        ranked.filter(F.col("position") <= cap)
        .withColumn("position", F.col("position").cast("bigint"))
        .join(totals, keys)
        .withColumn("showing_top", F.least(F.col("total_count"), F.lit(cap).cast("bigint")))
    )


def capped_lists(
    items: DataFrame, keys: str | list[str], order: Iterable[Column], columns: Iterable[str], cap: int = LIST_CAP
) -> DataFrame:
    """One row per list: the first rows as an array of at most `cap` structs, the total, and a note when it was cut."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    shown = first_rows_of_lists(items, keys, order, cap)
    return (
        shown.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("position", *columns))).alias("items"),
            F.max("total_count").alias("total_count"),
        )
        .withColumn(
            "note",
            F.when(
                F.col("total_count") > cap,
                F.concat(F.lit(f"list truncated: showing top {cap} of "), F.col("total_count").cast("string")),
            ),
        )
    )


def as_json(value: Column, max_chars: int = MAX_CHARS) -> Column:
    """JSON text of nested data, cut at `max_chars` with a mark."""
    return truncate_with_marker(F.to_json(value), max_chars, TRUNCATED)


def with_note(json_text: Column, note: Column) -> Column:
    """JSON text headed by a note when there is one."""
    return F.when(note.isNotNull(), F.concat(note, F.lit(SEPARATOR), json_text)).otherwise(json_text)


def numbered_results(tool_results: DataFrame, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """One numbered block per result of a request: its data, or its error. Results with neither have no block.

    Data is cut at `max_chars`, if given. Blocks stay rows, to be joined in the order of `source_index` where they are shown, so a request may have any number.
    """
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    head = F.concat(F.lit("[Source "), F.col("source_index").cast("string"), F.lit("] "), F.col("tool"))
    data = F.col("data_json") if max_chars is None else truncate_with_marker(F.col("data_json"), max_chars, TRUNCATED)
    return (
        tool_results.withColumn(
            "block",
            F.when(failed, F.concat(head, F.lit(" ERROR: "), F.col("error"))).when(
                F.col("data_json").isNotNull(),
                F.concat(head, F.lit(":\n"), data),
            ),
        )
        .filter(F.col("block").isNotNull())
        .select("request_id", F.col("source_index").cast("bigint").alias("source_index"), "block")
    )


def answer_context(tool_results: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """One text per request: the numbered blocks of its results in order, errors included.

    A result whose data has notes on cut lists is headed by them. A request has as many results as its plan has tools, which
    bounds its list.
    """
    notes = F.array_distinct(F.regexp_extract_all("data_json", F.lit(r'"note":"([^"]*)"'), F.lit(1)))
    headed = tool_results.withColumn("notes", F.nullif(F.array_join(notes, "\n"), F.lit("")))
    blocks = numbered_results(headed.withColumn("data_json", _cut_below_note(max_chars)), None)
    ordered = F.array_sort(F.collect_list(F.struct("source_index", "block")))
    return blocks.groupBy("request_id").agg(
        F.array_join(F.transform(ordered, lambda item: item["block"]), SEPARATOR).alias("context")
    )


def _cut_below_note(max_chars: int) -> Column:
    return with_note(truncate_with_marker(F.col("data_json"), max_chars, TRUNCATED), F.col("notes"))


def judge_evidence(tool_results: DataFrame, max_chars: int = JUDGE_CHARS) -> DataFrame:
    """The sources that a judge sees, as one text per request: results with data and no error, cut at `max_chars`.

    Every block has at least `len("[Source 1] :") + len(SEPARATOR)` characters, so blocks past a known rank start after
    the cut. The rank filter drops them before the shuffle, which bounds the list of each request.
    """
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    most = max_chars // (len("[Source 1] :") + len(SEPARATOR)) + 1
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("source_index"))
    blocks = (
        tool_results.filter(F.col("data_json").isNotNull() & ~failed)
        .select(
            "request_id",
            "source_index",
            F.substring(
                F.concat(
                    F.lit("[Source "),
                    F.col("source_index").cast("string"),
                    F.lit("] "),
                    F.col("tool"),
                    F.lit(":\n"),
                    F.col("data_json"),
                ),
                1,
                max_chars,
            ).alias("block"),
        )
        .withColumn("rank", rank)
        .filter(F.col("rank") <= most)
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy("request_id").agg(
        F.substring(
            F.array_join(F.transform(ordered, lambda item: item["block"]), SEPARATOR), 1, max_chars
        ).alias("evidence")
    )
