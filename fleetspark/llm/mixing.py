"""Mixing sources to target weights by weighted fair queueing.

Within each source the documents are shuffled, and every document gets a virtual finish time: the words of its source so far,
itself included, divided by the target of the source. Taken in the order of finish times up to the total budget, each source
has its share. Only DataFrame functions are used.

The order over all documents is dealt into spans of virtual time. Sums per span tell in which one the budget ends, so
only that span is sorted row by row; every other document lies wholly before or after the cut.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, table, written

# Parts of each source's shuffled order, spans of virtual time, and cells of the span with the cut.
PARTS = 1024

# No document is taken more often than this.
MAX_REPEATS = 3

WEIGHTS = (1.0, 2.0, 3.0)


def _keys() -> list[Column]:
    """`_id`, `_source` and `_at`, a random number that the content fixes. None of them is ever null."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source"),
        F.xxhash64("doc_id", "text", "source").alias("_at"),
    ]


def _sizes(docs: DataFrame) -> DataFrame:
    """One row per document: its id, source and size in words, and its keys."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    others = ["_number"] if "_number" in docs.columns else []
    return docs.select("doc_id", "source", size.alias("size"), *_keys(), *others)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """`_source`, `source_size`, `largest` document and `target` in words of each source.

    Sources in order of code point, null last, take the weights in turn. The total of all sizes is dealt by weight, and what
    a source would have to give beyond `max_repeats` times its size is dealt to the others by weight, until none is above.

    At level t source i gives min(bound, weight * t). Sources reach their bounds in the order of bound / weight, so the level
    follows from running sums over the sources. Their number is that of the configured mixture, and they meet in one task.
    """
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("_source") == "", "_source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "_source")
    sooner = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_ = by_level.rowsBetween(*everything)

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(sooner), F.lit(0.0))

    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    per = per.withColumns(
        {
            "weight": F.get(F.array(*[F.lit(float(w)) for w in weights]), turn),
            "bound": F.col("source_size") * F.lit(float(max_repeats)),
        }
    )
    left = F.sum("source_size").over(all_) - before("bound")
    per = per.withColumn("level", left / (F.sum("weight").over(all_) - before("weight")))
    per = per.withColumn("open", F.col("level") * F.col("weight") <= F.col("bound"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(all_)
    target = F.least(F.col("bound"), F.col("weight") * level)
    return per.select("_source", "source_size", "largest", target.alias("target"))


def _running(sizes: DataFrame) -> DataFrame:
    """The sizes with `upto`, the words of the source up to each document in shuffled order, itself included.

    A source is dealt into parts of its shuffled order. Only the sums of the parts meet in one place, so no source is too large.
    """
    rows = sizes.withColumn("_part", F.shiftrightunsigned("_at", 54).cast("int"))
    parts = rows.groupBy("_source", "_part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_source", "_part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("_source", "_part").orderBy("_at", "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(within)).join(parts, ["_source", "_part"])
    return rows.withColumn("upto", F.col("within") + F.col("earlier")).drop("_part", "within", "earlier")


def _finish(turn: Column) -> Column:
    return (turn * F.col("source_size") + F.col("upto")) / F.col("target")


def _place(finish: Column) -> Column:
    """Where a finish time lies among the spans: of equal width up to time 1, then so many for each doubling of the time.

    It grows with the time, and spans stay few for any time, so every offer has one.
    """
    return F.when(finish <= 1, finish * PARTS).otherwise((F.log2(finish) + 1) * PARTS)


def _span_with(sums: DataFrame, span: str, budget: int) -> tuple[int | None, int]:
    """The first span at whose end the running sum reaches the budget, and the words before it. There are few spans."""
    upto = F.sum("words").over(Window.orderBy(span).rowsBetween(Window.unboundedPreceding, 0))
    found = sums.withColumn("upto", upto).filter(F.col("upto") >= budget).orderBy(span).first()
    return (None, 0) if found is None else (found[span], found["upto"] - found["words"])


def mixture(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    budget: int | None = None,
) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, `_at` and `takes`, the words taken in each turn.

    A document is offered up to `max_repeats` times, turn after turn of its shuffled source, and taken while the budget lasts
    (as a default the words of all documents). The last document taken may be cut. Turns in which it is not taken are absent.

    Null sources are one source, the last. Null and empty texts have size 0 and are never taken. Repeated rows are documents
    of their own. An empty table gives an empty result. Only `doc_id`, `source` and `text` are read. The shuffle depends on
    the content alone, so reruns agree.
    """
    sizes = written(_sizes(docs), "mixing-sizes")
    targets = written(source_targets(sizes, weights, max_repeats), "mixing-targets")
    # One row per source of the mixture, which the configuration bounds.
    rows = written(_running(sizes).join(F.broadcast(targets), "_source"), "mixing-rows")
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    budget = words if budget is None else min(budget, words)
    none = F.array().cast("array<struct<turn:int,words:long>>")
    names = ["doc_id", "source", "size", "source_size", "target", "_at", *(["_number"] if "_number" in sizes.columns else [])]
    if budget <= 0:
        return rows.select(*names, none.alias("takes"))

    turns = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("turn")
    offers = rows.filter("size > 0").select("*", turns).withColumn("finish", _finish(F.col("turn")))
    spans = offers.withColumn("place", _place(F.col("finish"))).withColumn("span", F.floor("place"))
    span, before = _span_with(spans.groupBy("span").agg(F.sum("size").alias("words")), "span", budget)
    cells = spans.filter(F.col("span") == F.lit(span)).withColumn(
        "cell", F.floor((F.col("place") - F.col("span")) * PARTS)
    )
    cell, more = _span_with(cells.groupBy("cell").agg(F.sum("size").alias("words")), "cell", budget - before)
    before += more
    # The order within the cell: by finish time, then source, then place in the source.
    order = ["finish", "_source", "upto"]
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = cells.filter(F.col("cell") == F.lit(cell)).withColumn("sum", upto + before).filter(F.col("sum") >= budget)
    last = last.orderBy(*order).first()
    cut = F.struct(F.lit(last["finish"]), F.lit(last["_source"]), F.lit(last["upto"]))
    cut = cut.cast("struct<finish:double,_source:string,upto:long>")

    def taken(turn: Column) -> Column:
        place = F.struct(_finish(turn).alias("finish"), F.col("_source"), F.col("upto"))
        some = F.when(place == cut, F.lit(last["size"] - (last["sum"] - budget))).otherwise(F.lit(0)).cast("long")
        return F.struct(turn.alias("turn"), F.when(place < cut, F.col("size")).otherwise(some).alias("words"))

    every = F.filter(F.array(*[taken(F.lit(e)) for e in range(max_repeats)]), lambda x: x["words"] > 0)
    return rows.select(*names, F.when(F.col("size") > 0, every).otherwise(none).alias("takes"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix, one row for each turn in which a document is taken, with the columns of `docs`.

    A cut document keeps its first words, joined by one space, and `n_chars` follows. Rows equal in everything are taken each
    for itself.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    # Every row has a number of its own, so rows that repeat are told apart.
    numbered = written(docs.select(row, F.monotonically_increasing_id().alias("_number")), "mixing-documents")
    takes = mixture(numbered.select("_row.doc_id", "_row.text", "_row.source", "_number"), weights, max_repeats)
    takes = takes.filter(F.size("takes") > 0).select("_number", F.col("size").alias("_size"), F.explode("takes").alias("_take"))
    out = numbered.join(takes, "_number").select("_row", "_size", "_take")
    is_cut = F.col("_take.words") < F.col("_size")
    words = F.slice(F.regexp_extract_all("_row.text", F.lit(f"({WORD})")), F.lit(1), F.col("_take.words").cast("int"))
    out = out.withColumn("_text", F.when(is_cut, F.array_join(words, " ")).otherwise(F.col("_row.text")))
    changed = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(kinds.get("n_chars", "long"))}

    def column(name: str) -> Column:
        old = F.col(f"_row.`{name}`")
        return F.when(is_cut, changed[name]).otherwise(old) if name in changed else old

    return out.select(*[column(c).alias(c) for c in names])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents, as large as they are, takes of each."""
    found = mixture(table(spark, sf_dir, "documents"))
    words = F.aggregate("takes", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return found.select("doc_id", "size", "source_size", "target", words.alias("taken"))
