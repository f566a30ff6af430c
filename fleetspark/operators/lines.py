"""Segmentation of documents that come as lines, so that one document may fill many tasks.

Lines are dealt by ranges of (document, line). What a line must know of the text before it, such as the number of headers, the
section in force, and whether a block is open, is carried in two steps: totals for each document and partition are summed up over
the partitions, and a running window stays within one partition.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import materialised
from ..functions import clean_text
from .chunking import FAULT_HEADER, MIN_BLOCK, SECTION_MARKERS, _code_of


def lines_of(documents: DataFrame) -> DataFrame:
    """`doc_id`, `line_no` and `line` of whole documents; for texts that already are in one row each."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _last_marker(text: Column, markers: tuple) -> Column:
    """The number of the last marker of the list that a text holds, 0 for none."""
    return reduce(lambda found, i: F.when(F.contains(text, F.lit(markers[i][0])), i + 1).otherwise(found), range(len(markers)), F.lit(0))


def _fragments(markers: tuple) -> Column:
    """The fragments of a line between headers: text up to a dashed line, whether there is one, and the last marker."""

    def fragment(piece: Column, place: Column) -> Column:
        # A dashed line begins a line, so only the first fragment, or one after another line end, can hold it.
        cut = F.split(piece, r"(?m)^-{10,}", 2)
        return F.struct(
            place.alias("place"), F.get(cut, F.lit(0)).alias("body"), (F.size(cut) > 1).alias("ended"), _last_marker(piece, markers).alias("mark")
        )

    return F.transform(F.split("line", rf"{FAULT_HEADER}(?=E-\d)"), fragment)


def _carried(lines: DataFrame) -> DataFrame:
    """The lines with what the text before each has: `headers`, the last `mark`, and whether a block is `open`."""
    # The id within a struct equals itself also when it is null, so one shuffle serves the join and the window.
    lines = lines.withColumn("_doc", F.struct("doc_id"))
    last = F.max(F.when(F.col("event").isNotNull(), F.struct("line_no", "event")))["event"]
    totals = lines.groupBy("_doc", "part").agg(F.sum("own_headers").alias("h"), F.max("own_mark").alias("m"), last.alias("e"))
    # One row for each partition that a document reaches into.
    sooner = Window.partitionBy("_doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_doc",
        "part",
        F.coalesce(F.sum("h").over(sooner), F.lit(0)).alias("earlier_headers"),
        F.coalesce(F.max("m").over(sooner), F.lit(0)).alias("earlier_mark"),
        F.coalesce(F.last("e", ignorenulls=True).over(sooner), F.lit(False)).alias("earlier_open"),
    )
    joined = lines.join(totals, ["part", "_doc"])
    within = Window.partitionBy("part", "_doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        "doc_id",
        "line_no",
        "fragments",
        (F.col("earlier_headers") + F.coalesce(F.sum("own_headers").over(within), F.lit(0))).alias("headers"),
        F.greatest("earlier_mark", F.coalesce(F.max("own_mark").over(within), F.lit(0))).alias("mark"),
        F.coalesce(F.last("event", ignorenulls=True).over(within), F.col("earlier_open")).alias("open"),
    )


def fault_blocks_of_lines(
    lines: DataFrame, markers: tuple[tuple[str, str, str], ...] = SECTION_MARKERS, min_chars: int = MIN_BLOCK
) -> DataFrame:
    """As `chunking.fault_blocks`, for documents that come as lines: `doc_id`, `line_no` (orders the lines) and `line`.

    The lines are written once, sorted by document and number, so that a line's partition is settled. Only the lines of a block
    meet, as a block is a row of the result; what lies outside of blocks is dropped before.
    """
    order = ["doc_id", "line_no"]
    dealt = lines.select(*order, "line").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialised(dealt.withColumn("part", F.spark_partition_id()))
    located = placed.withColumn("fragments", _fragments(markers)).withColumns(
        {
            "own_headers": F.size("fragments") - 1,
            "own_mark": F.array_max(F.transform("fragments", lambda f: f["mark"])),
            # Whether a block is open after the line; null where the line changes nothing.
            "event": F.when(
                (F.size("fragments") > 1) | F.get("fragments", F.lit(0))["ended"], ~F.element_at("fragments", -1)["ended"]
            ),
        }
    )
    carried = _carried(located.drop("line"))

    def marked(place: Column) -> Column:
        """The section in force at a header: of the text before the line, and of the line before the header."""
        before = F.transform(F.slice("fragments", F.lit(1), place), lambda f: f["mark"])
        return F.greatest(F.col("mark"), F.coalesce(F.array_max(before), F.lit(0)))

    part_of_block = F.transform(
        F.filter("fragments", lambda f: (f["place"] > 0) | F.col("open")),
        lambda f: F.struct(
            (F.col("headers") + f["place"]).alias("position"),
            F.when(f["place"] > 0, marked(f["place"])).alias("section"),
            F.when(f["place"] > 0, F.concat(F.lit(FAULT_HEADER), f["body"])).otherwise(f["body"]).alias("text"),
        ),
    )
    rows = carried.select("doc_id", "line_no", F.explode(part_of_block).alias("f")).select("doc_id", "line_no", "f.*")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    blocks = rows.groupBy("doc_id", "position").agg(F.max("section").alias("section"), F.array_join(texts, "\n").alias("text"))
    names = [F.array(*[F.lit(x) for x in ("Unknown", *(m[i] for m in markers))]) for i in (1, 2)]
    return (
        blocks.withColumn("block", clean_text(F.col("text")))
        .filter(F.length("block") >= min_chars)
        .select(
            "doc_id",
            "position",
            "block",
            F.get(names[0], F.col("section")).alias("manufacturer"),
            F.get(names[1], F.col("section")).alias("model"),
            _code_of(F.col("block")).alias("fault_code"),
        )
    )
