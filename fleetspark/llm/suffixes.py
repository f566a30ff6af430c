"""Repeated passages by a sparse suffix array.

Only the suffixes at content-selected positions, the minimisers, are kept. They are sorted over the whole corpus, and
neighbours that begin alike are extended to the left and right until every repeated passage is found whole.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, given, join_hot, table, written
from .words import shingles_of, slices, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A passage counts from so many words on.
MIN_WORDS = 50
# Suffixes are sorted by the hash of so many leading words. Each run of MIN_WORDS - PREFIX_WORDS + 1 positions keeps the
# suffix whose hash is the smallest, the last one of equals.
PREFIX_WORDS = 20

# Where a word stands: the document, by its id and the hash that tells documents of equal id apart, and the word's number.
PLACE = ("id", "doc", "at")


def _keyed(docs: DataFrame, *others: str) -> DataFrame:
    """`_id`, `_doc`, the text and other columns. A null id counts as the largest, and null text as empty."""
    text = F.coalesce("text", F.lit(""))
    doc = F.xxhash64(text)
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return docs.select(row_id.alias("_id"), doc.alias("_doc"), text.alias("text"), *others)


def minimisers(hashed: np.ndarray, width: int) -> np.ndarray:
    """For each position, where the smallest of the next `width` hashes stands, the last one of equals."""
    best, reach = np.arange(len(hashed)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashed[right] <= hashed[left], right, left)
        reach += step
    return best


def _windows(texts: pa.Array, min_words: int, prefix_words: int):
    """The words of the texts, the hash of the prefix at each, the starts of whole windows and the minimiser of each."""
    words = words_of(texts, seed=4)
    if len(words.hash) < min_words:
        none = np.zeros(0, np.int64)
        return words, np.zeros(0, np.uint64), none, none
    prefix, _ = shingles_of(words, prefix_words, seed=40)
    chosen = minimisers(prefix, min_words - prefix_words + 1)[: len(words.hash) - min_words + 1]
    starts = np.flatnonzero(words.text[: len(chosen)] == words.text[min_words - 1 :])
    return words, prefix, starts, chosen[starts]


def _rows(key, part, text, place) -> pa.RecordBatch:
    ids = part.column("_id").to_numpy(zero_copy_only=False)[text]
    docs = part.column("_doc").to_numpy(zero_copy_only=False)[text]
    columns = [pa.array(key.view(np.int64)), pa.array(ids), pa.array(docs), pa.array(place.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["key", *PLACE])


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS, prefix_words: int = PREFIX_WORDS) -> DataFrame:
    """The kept suffixes: `key`, the hash of the leading words, and their place `id`, `doc`, `at`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, prefix, _, chosen = _windows(part.column("text"), min_words, prefix_words)
                kept = np.unique(chosen)
                text = words.text[kept]
                yield _rows(prefix[kept], part, text, kept - words.first[text])

    return _keyed(docs).mapInArrow(rows, "key long, id long, doc long, at long")


def repeated_keys(places: DataFrame, name: str) -> DataFrame:
    """The places whose key occurs at another place too, with `later`: whether an earlier place has the key.

    The places are sorted over the whole table and compared with their neighbours. The sort is by key and place, so a key
    that holds a third of the rows is spread over many tasks. Where two partitions meet, their edge rows are compared
    afterwards; there are two for each partition. Equal places count once.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        names = ["key", *PLACE, "before", "after", "edge"]
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate((h, c)) for h, c in zip(held, now)]
            new = np.ones(len(now[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in now], axis=0)
            now = [c[new] for c in now]
            if len(now[0]) == 0:
                continue
            same = now[0][1:] == now[0][:-1]
            before, after = np.r_[False, same], np.r_[same, False]
            if held is not None:
                before[0] = held_before
            edge = np.zeros(len(before), bool)
            edge[0], first = first, False
            out = (before | after | edge)[:-1]
            columns = [c[:-1][out] for c in (*now, before, after, edge)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            # The last row waits for its successor, which the next batch may hold.
            held, held_before, first = [c[-1:] for c in now], bool(before[-1]), bool(edge[-1])
        if held is not None:
            last = [*held, np.array([held_before]), np.array([False]), np.array([True])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names)

    in_order = places.repartitionByRange("key", *PLACE).sortWithinPartitions("key", *PLACE)
    schema = "key long, id long, doc long, at long, before boolean, after boolean, edge boolean"
    found = written(in_order.mapInArrow(neighbours, schema), name)
    by_place = Window.orderBy("key", *PLACE)
    edges = found.filter("edge").withColumns(
        {
            "before": F.col("before") | F.coalesce(F.lag("key").over(by_place) == F.col("key"), F.lit(False)),
            "after": F.col("after") | F.coalesce(F.lead("key").over(by_place) == F.col("key"), F.lit(False)),
        }
    )
    every = found.filter("NOT edge").unionByName(edges)
    return every.filter("before OR after").select("key", *PLACE, F.col("before").alias("later"))


def _spans(places: Column, words: int) -> Column:
    """Sorted distinct window starts, joined to spans (begin, end) of words."""
    kind = "array<struct<begin:long,end:long>>"
    size = F.size(places)
    opens = F.filter(places, lambda at, i: (i == 0) | (F.get(places, i - 1) < at - 1))
    closes = F.filter(places, lambda at, i: (i == size - 1) | (F.get(places, i + 1) > at + 1))
    runs = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("begin"), (b + words).alias("end"))).cast(kind)

    def step(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["begin"].alias("begin"), run["end"].alias("end"))
        joins = (F.size(done) > 0) & (run["begin"] <= last["end"])
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        return F.when(joins, joined).otherwise(F.concat(done, F.array(run))).cast(kind)

    return F.aggregate(runs, F.array().cast(kind), step)


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, prefix_words: int = PREFIX_WORDS
) -> DataFrame:
    """The repeated passages of each document that has any.

    A passage is repeated when each run of `min_words` words in it occurs at two places or more, in any document.
    `repeated` lists its spans as word numbers [begin, end); `later` lists what remains of them when the first occurrence,
    by id and place, is left out. Texts that equal an earlier text are told by `copy` and are `later` as a whole.

    Null and empty texts have no passages; rows with equal id and text count as one document; a null id counts as the
    largest. An empty table gives an empty result. Other columns are not read. Passages are compared by 64-bit hashes.
    """
    if not 0 < prefix_words <= min_words:
        raise ValueError("prefix_words must lie between 1 and min_words")
    keyed = _keyed(docs)
    long_enough = F.regexp_count("text", F.lit(WORD))
    texts = written(
        keyed.select("_id", "_doc", F.md5("text").alias("digest"), long_enough.alias("n_words"))
        .filter(F.col("n_words") >= min_words)
        .distinct(),
        "suffix-texts",
    )
    equal = texts.groupBy("digest").agg(F.min("_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    equal = written(equal, "suffix-equal")
    in_group = join_hot(texts, equal, "digest", "n")
    in_group = written(in_group.withColumn("copy", F.expr("_id > first_id")), "suffix-copies")

    found = repeated_keys(suffixes(docs, min_words, prefix_words), "suffix-neighbours")
    places = found.groupBy(F.col("id").alias("_id"), F.col("doc").alias("_doc")).agg(F.collect_set("at").alias("places"))
    copies = in_group.filter("copy").select("_id", "_doc")
    # Equal texts have equal passages, so only the first text of a group is looked at again.
    places = places.join(copies, ["_id", "_doc"], "left_anti")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, _, starts, chosen = _windows(part.column("text"), min_words, prefix_words)
                listed = part.column("places")
                owner = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                kept = words.first[owner] + listed.flatten().to_numpy(zero_copy_only=False)
                marked = np.zeros(len(words.hash) + 1, bool)
                marked[kept] = True
                begin = starts[marked[chosen]]
                key, _ = shingles_of(words, min_words, seed=41)
                text = words.text[begin]
                yield _rows(key[begin], part, text, begin - words.first[text])

    # Each kept suffix that has an equal is extended by all windows that it was kept for, to its left and right.
    windows = keyed.join(places, ["_id", "_doc"]).mapInArrow(extended, "key long, id long, doc long, at long")
    found = repeated_keys(windows, "suffix-windows")
    at, later = F.col("at"), F.col("later")
    spans = (
        found.groupBy(F.col("id").alias("_id"), F.col("doc").alias("_doc"))
        .agg(F.sort_array(F.collect_set(at)).alias("all"), F.sort_array(F.collect_set(F.when(later, at))).alias("late"))
        .select(
            "_id", "_doc", _spans(F.col("all"), min_words).alias("repeated"), _spans(F.col("late"), min_words).alias("later")
        )
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").cast("long").alias("end")))
    return (
        spans.join(in_group.select("_id", "_doc", "n_words", "copy"), ["_id", "_doc"], "full")
        .select(
            "_id",
            "_doc",
            F.coalesce("copy", F.lit(False)).alias("copy"),
            F.when(F.col("n_words").isNull(), F.col("repeated")).otherwise(whole).alias("repeated"),
            F.when(F.col("copy"), whole).otherwise(F.coalesce("later", F.array())).alias("later"),
        )
    )


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without their `later` passages; `n_chars` follows. A document that loses all its words goes.

    `passages` is a written table of `repeated_passages`. A cut reaches from its first word to the next word that stays.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    cuts = passages.filter("size(later) > 0").select("_id", "_doc", "later")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    # The row has the text, so that is shuffled once.
    joined = _keyed(docs.withColumn("_row", row), "_row").drop("text").join(cuts.hint("merge"), ["_id", "_doc"], "left")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if own is None else _without(text, own) for text, own in zip(texts, spans)], dtype=object)

    # Only texts that are cut go to Python. Were it called deterministic, the planner would cut them once for the filter and
    # once more for the column, in two workers of a task that stay and keep what later stages remember.
    left = rest.asNondeterministic()(F.when(F.col("later").isNotNull(), F.col("_row.text")), F.col("later"))
    joined = joined.withColumn("_left", left).filter(F.col("_left").isNull() | (F.regexp_count("_left", F.lit(WORD)) > 0))
    changed = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast(kinds.get("n_chars", "long"))}

    def column(name: str) -> Column:
        old = F.col(f"_row.`{name}`")
        return F.when(F.col("_left").isNull(), old).otherwise(changed[name]) if name in changed else old

    return joined.select(*[column(c).alias(c) for c in names])


def _without(text: str, spans: list) -> str:
    """The text without the spans of words; each span reaches to the word after it."""
    raw = text.encode()
    begin = np.r_[words_of(pa.array([text])).begin, len(raw)]
    stays = np.ones(len(raw), bool)
    for span in spans:
        stays[begin[span["begin"]] : begin[span["end"]]] = False
    return np.frombuffer(raw, np.uint8)[stays].tobytes().decode()


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of 50 words or more that occurs twice or more, with its word spans."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    length = F.aggregate("repeated", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(given("_id").alias("doc_id"), "copy", length.alias("repeated_words"), "repeated", "later")
