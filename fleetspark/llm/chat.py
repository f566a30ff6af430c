"""Chat formatting by perspective rotation.

Every participant of a dialogue takes the assistant's part once: the dialogue is rendered with that speaker as the assistant
and all others as named users, and only what the assistant says bears loss.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

# Speakers that never rotate: they keep their role in every perspective and bear no loss.
FIXED = ("system",)
UNKNOWN = "unknown"

# Longer dialogues are rendered in parts, by rank.
PART_TURNS = 256


def _header(speaker: Column, assistant: Column) -> Column:
    role = F.when(speaker.isin(*FIXED), speaker).when(speaker == assistant, F.lit("assistant"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.concat(F.lit("user name="), speaker)), F.lit("\n"))


def _said(turns: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `speaker` and `text` of every row, with defaults for what is missing and without marks."""

    def clean(text: Column) -> Column:
        return F.replace(text, F.lit("<|"), F.lit("< |"))

    role = F.trim(F.coalesce("role", F.lit("")))
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        clean(F.when(role == "", F.lit(UNKNOWN)).otherwise(role)).alias("speaker"),
        clean(F.coalesce("text", F.lit(""))).alias("text"),
    )


def _piece(t: Column, assistant: Column) -> Column:
    return F.concat(_header(t["speaker"], assistant), t["text"], F.lit(CLOSE + "\n"))


def _rendering(before: Column) -> list[Column]:
    """`n_turns`, `rendered` and `masks` from the columns `turns` and `assistant`, after `before` code points."""

    def step(done: Column, t: Column) -> Column:
        begin = done["length"] + F.char_length(_header(t["speaker"], F.col("assistant")))
        end = begin + F.char_length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        masks = F.when(t["speaker"] == F.col("assistant"), F.concat(done["masks"], span)).otherwise(done["masks"])
        return F.struct((end + 1).alias("length"), masks.alias("masks"))

    zero = F.struct(before.alias("length"), F.array().cast("array<struct<begin:long,end:long>>").alias("masks"))
    return [
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: _piece(t, F.col("assistant"))), "").alias("rendered"),
        F.aggregate("turns", zero, step, lambda done: done["masks"]).alias("masks"),
    ]


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: `conv_id`, `part`, `assistant`, `n_turns`, `rendered` and `masks`.

    Every speaker of the whole conversation takes the assistant's part over all its turns, system turns included. A long
    rendering is split for size only: turn by turn in order, `part_turns` to a row, whatever their numbers. `rendered` of the
    parts, joined in order, is the perspective, and `masks` lists its spans [begin, end) of code points that bear loss, so
    begins go on counting from part to part. A part in which the assistant is silent has no spans.

    Turns are in the order of their numbers, and of speaker and text where numbers are equal, repeated rows included. A turn
    without a number comes first. A null or empty role is the speaker `unknown`, null text is empty, and a row without
    conv_id is a dialogue of its own. System turns rotate to nobody, and a dialogue without other speakers gives no row.
    Opening brackets of marks are broken in texts and names, so marks are the renderer's. Other columns are not read; an empty
    table gives an empty result.
    """
    rows = _said(turns)
    line = F.struct("turn", "speaker", "text")
    lone = rows.filter("conv_id IS NULL AND " + " AND ".join(f"speaker <> '{x}'" for x in FIXED))
    zero = F.lit(0).cast("long")
    lone = lone.select("conv_id", zero.alias("part"), F.col("speaker").alias("assistant"), zero.alias("before"), F.array(line).alias("turns"))

    # Ranks are counted in blocks of turn numbers; only the counts of the blocks of a conversation meet.
    rows = rows.filter("conv_id IS NOT NULL").withColumn("block", F.floor(F.col("turn") / part_turns))
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    sooner = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", F.col("block").alias("_block"), F.coalesce(F.sum("n").over(sooner), zero).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "text"))
    rows = rows.withColumn("within", within).withColumnRenamed("conv_id", "_conv")
    placed = rows.join(counts, (F.col("_conv") == F.col("conv_id")) & F.col("block").eqNullSafe(F.col("_block")))
    part = F.floor((F.col("earlier") + F.col("within") - 1) / part_turns)
    parts = placed.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(line)).alias("turns"))
    parts = written(parts, "chat-parts")

    # Of a participant's own turns only the header differs from what the others' perspectives show.
    spoken = parts.select("conv_id", "part", F.explode("turns").alias("t")).select("conv_id", "part", "t.*")
    spoken = spoken.withColumn("length", F.char_length(_piece(F.struct("speaker", "text"), F.lit(None).cast("string"))).cast("long"))
    sizes = spoken.groupBy("conv_id", "part").agg(F.sum("length").alias("size"))
    own = spoken.filter(~F.col("speaker").isin(*FIXED)).groupBy("conv_id", "part", F.col("speaker").alias("assistant"))
    own = own.agg(F.count("*").alias("own"))
    cast = own.select("conv_id", "assistant").distinct().join(sizes, "conv_id")
    cast = cast.join(own, ["conv_id", "part", "assistant"], "left")
    shorter = F.char_length(_header(F.col("assistant"), F.lit(None).cast("string"))) - F.char_length(
        _header(F.col("assistant"), F.col("assistant"))
    )
    length = F.col("size") - F.coalesce("own", zero) * shorter
    sooner = Window.partitionBy("conv_id", "assistant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cast = cast.select("conv_id", "part", "assistant", F.coalesce(F.sum(length).over(sooner), zero).alias("before"))
    seen = cast.join(parts, ["conv_id", "part"]).unionByName(lone)
    return seen.select("conv_id", "part", "assistant", *_rendering(F.col("before")))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as each of their participants sees them, whole."""
    found = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws(":", m["begin"].cast("string"), m["end"].cast("string")))
    return found.select("conv_id", "part", "assistant", "n_turns", "rendered", F.array_join(spans, ",").alias("masks"))


OP6_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn,
           replace(CASE WHEN trim(coalesce(role, '')) = '' THEN '{UNKNOWN}' ELSE trim(role) END, '<|', '< |') AS speaker,
           replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS place
    FROM turns WHERE conv_id IS NOT NULL
), people AS (
    SELECT DISTINCT conv_id, speaker AS assistant FROM ranked WHERE speaker <> 'system'
), pieces AS (
    SELECT conv_id, place // {PART_TURNS} AS part, place, assistant, speaker, text FROM people JOIN ranked USING (conv_id)
    UNION ALL
    SELECT NULL, 0, row_number() OVER () - 1, speaker, speaker, text FROM turns WHERE conv_id IS NULL AND speaker <> 'system'
), headed AS (
    SELECT *, '{OPEN}' || CASE WHEN speaker = 'system' THEN speaker WHEN speaker = assistant THEN 'assistant'
                               ELSE 'user name=' || speaker END || chr(10) AS header,
           header || text || '{CLOSE}' || chr(10) AS piece,
           CASE WHEN conv_id IS NULL THEN place END AS lone
    FROM pieces
), placed AS (
    SELECT *, coalesce(sum(length(piece)) OVER (
        PARTITION BY conv_id, lone, assistant ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0)::BIGINT + length(header) AS start
    FROM headed
)
SELECT conv_id, part, assistant, count(*) AS n_turns, string_agg(piece, '' ORDER BY place) AS rendered,
       coalesce(string_agg(start || ':' || (start + length(text) + {len(CLOSE)}), ',' ORDER BY place)
           FILTER (WHERE speaker = assistant), '') AS masks
FROM placed
GROUP BY conv_id, lone, part, assistant
"""
