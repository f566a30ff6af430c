"""Cuts documents into tagged chunks. Everything works within one row, so no document is shuffled."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunk_id, clean_text, explode_rows

# Section markers in order, each with the manufacturer and model that hold from there on.
SECTION_MARKERS = (
    ("SECTION 1", "Vestas", "V150-4.5"),
    ("SECTION 2", "Siemens Gamesa", "SG-6.6-170"),
    ("SECTION 3", "LONGi Solar", "Hi-MO 6"),
    ("SECTION 4", "General", "All models"),
)

# Block headers, titles of the narrative sections, and the least lengths that are kept.
FAULT_HEADER = "FAULT CODE: "
NARRATIVE_TITLES = ("PERFORMANCE OVERVIEW", "MAINTENANCE SCHEDULING", "DATA QUALITY", "ESCALATION MATRIX")
MIN_BLOCK = 50
MIN_SECTION = 100
MIN_CHUNK = 80


def window_pieces(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that start every `size - overlap` characters, as an array.

    Each match consumes one step and captures a whole window by lookahead, so the text is walked once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))


def _windows(text: Column, size: int, overlap: int, min_chars: int) -> Column:
    """The stripped windows of a text that are long enough, with their numbers."""
    numbered = F.transform(
        window_pieces(text, size, overlap),
        lambda piece, number: F.struct(number.cast("bigint").alias("window_no"), clean_text(piece).alias("chunk")),
    )
    return F.filter(numbered, lambda window: F.length(window["chunk"]) >= min_chars)


def window_chunks(
    documents: DataFrame, size: int = 600, overlap: int = 100, min_chars: int = MIN_CHUNK, text: str = "text"
) -> DataFrame:
    """One row per window of each document, stripped; windows shorter than `min_chars` are left out."""
    others = [name for name in documents.columns if name != text]
    windows = _windows(F.col(text), size, overlap, min_chars)
    return explode_rows(documents, others, windows).select(*others, "item.window_no", "item.chunk")


def _first_seen(pieces: Column, markers: tuple[tuple[str, str, str], ...]) -> Column:
    """For each marker, the number of the first piece that holds it (0 for none), with what it stands for."""

    def first_piece(marker: str) -> Column:
        return F.array_position(F.transform(pieces, lambda piece: F.contains(piece, F.lit(marker))), True)

    return F.array(
        *[
            F.struct(
                first_piece(marker).alias("seen"),
                F.lit(manufacturer).alias("manufacturer"),
                F.lit(model).alias("model"),
            )
            for marker, manufacturer, model in markers
        ]
    )


def _section_at(marks: Column, position: Column) -> Column:
    """Manufacturer and model in force at a piece: the last marker that first occurs in an earlier piece."""
    unknown = F.struct(
        F.lit(0).cast("bigint").alias("seen"), F.lit("Unknown").alias("manufacturer"), F.lit("Unknown").alias("model")
    )
    passed = F.filter(marks, lambda mark: (mark["seen"] > 0) & (mark["seen"] <= position))
    return F.coalesce(F.try_element_at(passed, F.lit(-1)), unknown)


def _with_blocks(
    documents: DataFrame,
    name: str,
    delimiter: str,
    block: Callable[[Column, Column], Column],
    markers: tuple[tuple[str, str, str], ...],
    min_chars: int,
) -> DataFrame:
    """Documents with an array `name` of their blocks: place, text, manufacturer and model.

    The text is cut at the delimiter; `block` turns a piece and its place into a block, or null. Everything happens while
    the pieces are one array of their document.
    """
    blocks = F.transform(
        F.col("pieces"),
        lambda piece, position: F.struct(
            position.cast("bigint").alias("position"), clean_text(block(piece, position)).alias("block")
        ),
    )

    def tagged(one: Column) -> Column:
        section = _section_at(F.col("marks"), one["position"])
        return F.struct(
            one["position"].alias("position"),
            one["block"].alias("block"),
            section["manufacturer"].alias("manufacturer"),
            section["model"].alias("model"),
        )

    return (
        documents.withColumn("pieces", F.split("text", delimiter))
        .withColumns(
            {
                name: F.filter(blocks, lambda one: F.length(one["block"]) >= min_chars),
                "marks": _first_seen(F.col("pieces"), markers),
            }
        )
        .withColumn(name, F.transform(name, tagged))
        .drop("pieces", "marks")
    )


def _with_fault_blocks(
    documents: DataFrame, markers: tuple[tuple[str, str, str], ...], min_chars: int = MIN_BLOCK
) -> DataFrame:
    def upto_dashes(piece: Column, position: Column) -> Column:
        # What precedes the first header is no block. Splitting took the words of the header off the others.
        body = F.get(F.split(piece, r"(?m)^-{10,}", 2), F.lit(0))
        return F.when(position > 0, F.concat(F.lit(FAULT_HEADER), body))

    return _with_blocks(documents, "faults", rf"{FAULT_HEADER}(?=E-\d)", upto_dashes, markers, min_chars)


def _with_sections(
    documents: DataFrame,
    markers: tuple[tuple[str, str, str], ...],
    titles: tuple[str, ...] = NARRATIVE_TITLES,
    min_chars: int = MIN_SECTION,
    anchored: bool = True,
) -> DataFrame:
    start = "(?m)^" if anchored else r"(?<!\d)"
    next_heading = r"(?m)^\d+\.\d+\s+[A-Z]" if anchored else r"\d+\.\d+\s+[A-Z]"
    heading = rf"\d+\.\d+\s+(?:{'|'.join(titles)})"

    def upto_next(piece: Column, _: Column) -> Column:
        # A piece starts with its own heading, which is not to end it; one that does not is no section.
        found = F.regexp_extract(piece, rf"(?s)\A({heading}.*?)(?:{next_heading}|-{{10,}}|\z)", 1)
        return F.when(F.rlike(piece, F.lit(rf"\A{heading}")), found)

    # The start stands before the lookahead, which is then tried at starts of lines only.
    return _with_blocks(documents, "sections", f"{start}(?={heading})", upto_next, markers, min_chars)


def _code_of(block: Column) -> Column:
    return F.regexp_extract(block, rf"\A{FAULT_HEADER}(E-\d+)", 1)


def _title_of(block: Column) -> Column:
    return clean_text(F.get(F.split(block, "\n", 2), F.lit(0)))


def fault_blocks(
    documents: DataFrame, markers: tuple[tuple[str, str, str], ...] = SECTION_MARKERS, min_chars: int = MIN_BLOCK
) -> DataFrame:
    """One row per fault block: from its header to the next header, a dashed line, or the end of the text."""
    located = _with_fault_blocks(documents.select("doc_id", "text"), markers, min_chars)
    return (
        explode_rows(located, ["doc_id"], F.col("faults"))
        .select("doc_id", "item.*")
        .withColumn("fault_code", _code_of(F.col("block")))
    )


def narrative_sections(
    documents: DataFrame,
    markers: tuple[tuple[str, str, str], ...] = SECTION_MARKERS,
    titles: tuple[str, ...] = NARRATIVE_TITLES,
    min_chars: int = MIN_SECTION,
    anchored: bool = True,
) -> DataFrame:
    """One row per named section, up to the next numbered heading or dashed line; the title is its first line.

    `anchored` requires headings to start a line. Without it any `7.2 Abc` within a sentence ends the section.
    """
    located = _with_sections(documents.select("doc_id", "text"), markers, titles, min_chars, anchored)
    return (
        explode_rows(located, ["doc_id"], F.col("sections"))
        .select("doc_id", "item.*")
        .withColumn("section", _title_of(F.col("block")))
        .withColumnRenamed("block", "body")
    )


def manual_chunks(
    documents: DataFrame,
    size: int = 600,
    overlap: int = 100,
    markers: tuple[tuple[str, str, str], ...] = SECTION_MARKERS,
    anchored: bool = True,
) -> DataFrame:
    """Chunk records of manuals: whole fault blocks, and windows over the narrative sections.

    Both kinds are gathered in one array per document before they become rows, so the documents are read once.
    """

    def record(kind: str, code: Column, section: Column, one: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("chunk_type"),
            code.alias("fault_code"),
            section.alias("section"),
            one["manufacturer"].alias("manufacturer"),
            one["model"].alias("model"),
            text.alias("text"),
        )

    none = F.lit(None).cast("string")
    faults = F.transform("faults", lambda one: record("fault_code", _code_of(one["block"]), none, one, one["block"]))
    titled = F.transform("sections", lambda one: one.withField("title", _title_of(one["block"])))
    narrative = F.transform(
        titled,
        lambda one: F.transform(
            _windows(one["block"], size, overlap, MIN_CHUNK),
            lambda window: record("narrative", none, one["title"], one, window["chunk"]),
        ),
    )
    located = _with_sections(
        _with_fault_blocks(documents.select("doc_id", "text"), markers), markers, anchored=anchored
    ).select("doc_id", faults.alias("faults"), F.flatten(narrative).alias("narrative"))
    tag = F.concat(F.lit("[OEM Manual | "), F.concat_ws(" ", "manufacturer", "model"), F.lit("]\n"))
    rows = (
        explode_rows(located, ["doc_id"], F.concat("faults", "narrative"))
        .select("doc_id", "item.*")
        .withColumn("page_content", F.concat(tag, F.col("text")))
    )
    return rows.select(
        chunk_id(F.col("manufacturer"), F.col("fault_code"), F.col("page_content")).alias("id"),
        "doc_id",
        "page_content",
        F.lit("manual").alias("doc_type"),
        "chunk_type",
        "fault_code",
        "manufacturer",
        "model",
        "section",
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each type."""
    return chunks.groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunk_count"))


def headings(documents: DataFrame) -> DataFrame:
    """Fault codes and section headings that each document lists, one row each in order."""
    found = F.concat(
        F.transform(
            F.regexp_extract_all("text", F.lit(rf"{FAULT_HEADER}(E-\d+)"), F.lit(1)),
            lambda value: F.struct(F.lit("fault_code").alias("kind"), value.alias("value")),
        ),
        F.transform(
            F.regexp_extract_all("text", F.lit(r"(SECTION \d+)"), F.lit(1)),
            lambda value: F.struct(F.lit("section").alias("kind"), value.alias("value")),
        ),
    )
    return explode_rows(documents, ["doc_id"], found).select("doc_id", "item.kind", "item.value")
