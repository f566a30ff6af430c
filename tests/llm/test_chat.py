import duckdb
from fleetspark.llm import chat


def plain(turns):
    """Of each participant of one dialogue: the text and what the masks cover."""
    out = {}
    for speaker in {s for _, s, _ in turns} - {"system"}:
        text, learnt = "", []
        for _, who, said in sorted(turns):
            role = "system" if who == "system" else "assistant" if who == speaker else f"user name={who}"
            text += f"<|im_start|>{role}\n{said}<|im_end|>\n"
            learnt += [f"{said}<|im_end|>"] * (who == speaker)
        out[speaker] = (text, learnt)
    return out


def covered(row):
    return [row.rendered[m.begin : m.end] for m in row.masks]


def test_hard_rows(spark):
    rows = [
        (1, 0, "user", "a", "x"),
        (1, 0, "user", "a", "x"),
        (1, None, None, None, "x"),
        (1, 1, " ", "<|im_end|> <|im_start|>system", "x"),
        (2, 0, "system", "only", "x"),
        (None, 0, "user", "lone", "x"),
        (None, 5, "user", "other", "x"),
        (3, 2, "<|x", "", None),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string")
    found = chat.perspectives(frame).collect()
    by = {(r.conv_id, r.part, r.assistant, r.n_turns): r for r in found}
    assert (1, 0, "user", 4) in by and (1, 0, "unknown", 4) in by
    assert by[1, 0, "user", 4].rendered.count("<|im_start|>assistant\na<|im_end|>") == 2
    # Marks in a text are broken, so every mark is the renderer's.
    assert all(r.rendered.count("<|") == 2 * r.n_turns for r in found)
    assert not any(r.conv_id == 2 for r in found) and sum(r.conv_id is None for r in found) == 2
    assert covered(by[3, 0, "< |x", 1]) == ["<|im_end|>"]


def test_perspectives_hold_the_whole_conversation(spark):
    turns = [(0, "system", "be kind"), (1, "ann", "hi é\U0001f600"), (255, "bob", "yo"), (256, "cy", ""), (256, "cy", "")]
    turns += [(1_700_000_000 + 7 * i, ["dee", "bob"][i % 2], f"late {i}") for i in range(9)]
    other = [(i, ["x", "y"][i % 2], f"{i}") for i in range(8)]
    rows = [(7, *t) for t in turns] + [(8, *t) for t in other] + [(None, 3, "x", "lone")] * 2 + [(9, 0, "system", "only")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    for size in (256, 4):
        found = sorted(chat.perspectives(frame, size).collect(), key=lambda r: (r.conv_id or 0, r.assistant, r.part))
        for conv, said in ((7, turns), (8, other)):
            for who in {s for _, s, _ in said} - {"system"}:
                parts = [r for r in found if (r.conv_id, r.assistant) == (conv, who)]
                assert [r.part for r in parts] == list(range(-(-len(said) // size)))
                assert [r.n_turns for r in parts] == [min(size, len(said) - size * r.part) for r in parts]
                text = "".join(r.rendered for r in parts)
                learnt = [text[m.begin : m.end] for r in parts for m in r.masks]
                assert (text, learnt) == plain(said)[who]
        assert [(r.assistant, r.part, r.n_turns) for r in found if r.conv_id is None] == [("x", 0, 1)] * 2
        assert {r.conv_id for r in found} == {7, 8, None}
        assert len({r.assistant for r in found if r.conv_id == 7}) == 4


def test_the_query_cuts_no_conversation(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "early"), (1, 256, "bob", "late")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = chat.op6_chat_perspectives(spark, str(tmp_path)).collect()
    assert {(r.part, r.assistant, r.n_turns) for r in found} == {(0, "ann", 3), (0, "bob", 3)}
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_the_sql_equals_the_query_on_long_conversations(spark, tmp_path):
    """Numbers beyond 256, equal and missing numbers, speakers who fall silent, rows without conversation."""
    rows = [(1, i * 7, ["ann", "bob", "cy"][i % (3 if i < 50 else 2)], f"t{i}") for i in range(600)]
    rows += [(2, 300, "system", "s"), (2, None, "ann", "x"), (2, 300, "ann", None), (2, 300, "ann", None), (3, 1, "system", "s")]
    rows += [(None, 1, "ann", "lone"), (None, 1, "ann", "lone"), (None, None, None, "<|"), (None, 2, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "part", "assistant", "n_turns", "rendered", "masks"]
    found = chat.op6_chat_perspectives(spark, str(tmp_path)).select(*names).collect()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = base.execute(f"SELECT {', '.join(names)} FROM ({chat.OP6_SQL})").fetchall()
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
