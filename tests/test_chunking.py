import hashlib

import pytest

from fleetspark.operators import chunking
from fleetspark.sources import read_documents, read_manual, read_manuals, write_documents

LONG = "some words that fill the block well beyond its least length. "


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("length", [0, 79, 80, 500, 501, 579, 580, 600, 601, 1300])
@pytest.mark.parametrize(("size", "overlap"), [(600, 100), (100, 90), (7, 0)])
def test_windows_equal_slices(spark, length, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(length))
    least = min(80, size)
    expected = [
        (i // (size - overlap), text[i : i + size])
        for i in range(0, length, size - overlap)
        if len(text[i : i + size]) >= least
    ]
    found = chunking.window_chunks(documents(spark, text), size, overlap, least).orderBy("window_no").collect()
    assert [(row.window_no, row.chunk) for row in found] == expected


def test_windows_count_characters_and_strip(spark):
    text = "é\U0001f600" * 50 + "\n  \u00a0" + " " * 600
    found = chunking.window_chunks(documents(spark, text)).collect()
    assert [row.chunk for row in found] == ["é\U0001f600" * 50]


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2345))
    chunks = [row.chunk for row in chunking.window_chunks(documents(spark, text), min_chars=1).orderBy("window_no").collect()]
    rebuilt = chunks[0] + "".join(chunk[100:] for chunk in chunks[1:])
    assert rebuilt.startswith(text)


def test_bad_overlap(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunking.window_chunks(documents(spark, "x"), 100, 100)


def test_fault_blocks_and_their_sections(spark):
    text = (
        f"FAULT CODE: E-1\n{LONG}\nSECTION 1: V\nFAULT CODE: E-2\n{LONG}\n----------\nnot in a block {LONG}\n"
        f"SECTION 2\nFAULT CODE: E-3\nshort\nFAULT CODE: none\nFAULT CODE: E-4\n{LONG} see SECTION 4"
    )
    found = chunking.fault_blocks(documents(spark, text)).orderBy("position").collect()
    assert [(row.fault_code, row.manufacturer, row.model) for row in found] == [
        ("E-1", "Unknown", "Unknown"),
        ("E-2", "Vestas", "V150-4.5"),
        ("E-4", "Siemens Gamesa", "SG-6.6-170"),
    ]
    assert found[1].block == f"FAULT CODE: E-2\n{LONG}".strip()
    assert "E-3" not in found[2].block and found[2].block.endswith("see SECTION 4")


def test_first_occurrence_of_a_marker_counts_and_text_without_headers_has_no_blocks(spark):
    text = f"see SECTION 4 and SECTION 1\nFAULT CODE: E-1\n{LONG}SECTION 2\n{LONG}"
    found = chunking.fault_blocks(documents(spark, text, LONG, "", None)).collect()
    assert [(row.doc_id, row.manufacturer) for row in found] == [(0, "General")]


def test_narrative_sections_end_at_line_starts_or_anywhere(spark):
    text = (
        "SECTION 2\n2.1  PERFORMANCE OVERVIEW\nproduction up to 7.2 MW is allowed. " + LONG * 3
        + "\n2.2  FAULT CODES\nno section\n4.1  MAINTENANCE SCHEDULING\n" + LONG * 2 + "\n----------\ntail"
    )
    found = chunking.narrative_sections(documents(spark, text)).orderBy("position").collect()
    assert [row.section for row in found] == ["2.1  PERFORMANCE OVERVIEW", "4.1  MAINTENANCE SCHEDULING"]
    assert found[0].body.endswith("least length.") and found[0].manufacturer == "Siemens Gamesa"
    cut = chunking.narrative_sections(documents(spark, text), anchored=False, min_chars=10).orderBy("position").collect()
    assert cut[0].body.endswith("production up to")


def test_manual_chunks(spark, tmp_path):
    path = tmp_path / "manual.txt"
    path.write_text(f"SECTION 1\n1.1  PERFORMANCE OVERVIEW\n{LONG * 12}\n1.2  X\nFAULT CODE: E-1\n{LONG}\n", encoding="utf-8")
    found = read_manual(spark, str(path)).collect()
    assert sorted(row.chunk_type for row in found) == ["fault_code", "narrative", "narrative"]
    fault = next(row for row in found if row.chunk_type == "fault_code")
    assert fault.page_content == f"[OEM Manual | Vestas V150-4.5]\nFAULT CODE: E-1\n{LONG}".strip()
    assert fault.id == "manual_Vestas_E-1_" + hashlib.md5(fault.page_content.encode()).hexdigest()
    narrative = next(row for row in found if row.chunk_type == "narrative")
    assert narrative.fault_code is None and narrative.section == "1.1  PERFORMANCE OVERVIEW"
    assert narrative.id.startswith("manual_Vestas_overview_")
    counts = {row.chunk_type: row.chunk_count for row in chunking.chunk_counts(read_manual(spark, str(path))).collect()}
    assert counts == {"fault_code": 1, "narrative": 2}


def test_many_documents_a_file(spark, tmp_path):
    """Marks, line ends and escapes of a document come back, and one file is read by many tasks, a document by one."""
    marks = "\x1b \x1e\x1f \x1b[ \x1b^\x1b_ \r\n\x1b\x1b^"
    rows = [(i, f"line {i}\n\n{marks * (i % 4)} é\U0001f600") for i in range(400)] + [(500, "long\n" * 60_000), (501, ""), (502, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    write_documents(frame.coalesce(1), str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = read_documents(spark, str(tmp_path / "d"))
        assert found.rdd.getNumPartitions() > 10
        assert sorted((int(r.doc_id), r.text) for r in found.collect()) == [(i, t or "") for i, t in rows]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stored_documents_are_cut_without_a_regular_expression(spark, tmp_path, capsys):
    (tmp_path / "d.txt").write_text("no mark\x1e\x1e7\x1fa\x1b_b\x1e8\x1f\x1e\u00e99\x1f\u00e9\x1b[")
    found = read_documents(spark, str(tmp_path / "d.txt"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [("no mark", None), ("", None), ("7", "a\x1fb"), ("8", ""), ("\u00e99", "\u00e9\x1b")], key=repr
    )
    found.explain()
    assert "split(" not in capsys.readouterr().out


def test_sections_are_looked_for_at_starts_of_lines_only(spark, capsys):
    text = "1.1  PERFORMANCE OVERVIEW\n" + "a " * 60 + "1.2  DATA QUALITY " + "b " * 60 + "\r\n2.1 DATA QUALITY\n" + "c " * 60
    documents = spark.createDataFrame([("d", text)], "doc_id string, text string")
    for anchored, sections in ((True, 2), (False, 3)):
        found = chunking.narrative_sections(documents, anchored=anchored)
        assert len(found.collect()) == sections
        found.explain()
        assert "split(text" not in (plan := capsys.readouterr().out) or "(?=(?m)^" not in plan


def test_chunks_of_stored_manuals(spark, rows, tmp_path):
    text = "SECTION 1: A\nFAULT CODE: E-1001\n" + "Name: x " * 20 + "\n----------------\n1.1  PERFORMANCE OVERVIEW\n" + "words " * 200
    frame = spark.createDataFrame([(str(i), f"{text} {i}") for i in range(9)], "doc_id string, text string")
    write_documents(frame, str(tmp_path / "d"))
    assert rows(read_manuals(spark, str(tmp_path / "d"))) == rows(chunking.manual_chunks(frame))
