"""Quality rules: decision lists learned from labelled statistics by sequential covering.

A rule is a conjunction of thresholds on statistics of a text, and rejects what it covers. Rules are grown one condition at a
time, pruned on rows held back, and kept while they are precise. Only DataFrame functions are used.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, table, written

SYMBOLS = "#*$%&|<>"

# Statistics that rules may use, as expressions of the base statistics.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_words, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "mark_ratio": "n_marks / greatest(n_words, 1)",
}

# Thresholds tried for each statistic: its quantiles.
QUANTILES = 24
MAX_RULES = 12
MAX_CONDITIONS = 3
LEAST_PRECISION = 0.95
# Rejected rows that a rule must cover, in the growing part.
LEAST_COVER = 5
# The bound of the training rows: those with the smallest hash of their id.
TRAINING_ROWS = 50_000


class Condition(NamedTuple):
    """One threshold: the statistic is above it, or at most it."""

    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, *others: str) -> DataFrame:
    """`doc_id`, other columns and the statistics of every whole text. A null text has none of anything.

    `n_words`; `word_chars`, code points in words; `n_symbols`; `n_dup_lines`, lines with a word that equal an earlier line;
    `n_repeat_words`, words in windows of three words that occur twice or more in the text; `n_upper`, letters A-Z;
    `n_marks`, exclamation marks.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *others, text.alias("_text")).withColumn(
        "_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    )
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _count(F.col("_text"), SYMBOLS),
            "n_upper": _count(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_marks": _count(F.col("_text"), "!"),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""),
            "n_repeat_words": _repeat_words(F.col("_words")),
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return rows.drop("_text", "_words", "_lines").withColumns({k: F.expr(v) for k, v in RATIOS.items()})


def _count(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first time included.

    The windows' hashes are sorted with the place of each in their low bits, which are as many as the text needs. Equal
    neighbours are windows that repeat; in the order of their places, each adds the words that the one before left over.
    Hashes of unlike windows may agree, the more the longer the text. The words of equal neighbours are compared, and a text
    in which any differ is sorted by the words themselves.
    """
    n = F.size(words) - 2
    place = F.sequence(F.lit(0), n - 1)
    low = F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int")

    def keyed(i: Column) -> Column:
        hashed = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.call_function("shiftleft", hashed, low).bitwiseOR(i.cast("long"))

    keys = F.sort_array(F.transform(place, keyed))

    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, low)

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1

    def repeats(keys: Column) -> Column:
        def equal(x: Column, i: Column) -> Column:
            before, after = high(F.get(keys, i - 1)), high(F.get(keys, i + 1))
            return F.coalesce(high(x) == before, F.lit(False)) | F.coalesce(high(x) == after, F.lit(False))

        return F.filter(keys, equal)

    def places_of(found: Column) -> Column:
        """The places of the windows found, or null if the words of two with one hash differ."""

        def differs(x: Column, i: Column) -> Column:
            before = F.get(found, i - 1)
            mine, other = (y.bitwiseAND(mask).cast("int") for y in (x, before))
            unlike = reduce(lambda a, b: a | b, [F.get(words, mine + k) != F.get(words, other + k) for k in range(3)])
            return F.coalesce((high(x) == high(before)) & unlike, F.lit(False))

        clash = F.exists(F.transform(found, differs), lambda d: d)
        return F.when(~clash, F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask))))

    def exact_places(windows: Column) -> Column:
        """The places of repeated windows, from the windows in the order of their words."""

        def equal(x: Column, i: Column) -> Column:
            sides = [F.get(windows, i - 1), F.get(windows, i + 1)]
            same = [reduce(lambda a, b: a & b, [x[c] == y[c] for c in "abc"]) for y in sides]
            return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))

        return F.sort_array(F.transform(F.filter(windows, equal), lambda x: x["at"].cast("long")))

    def covered(places: Column) -> Column:
        def step(done: Column, at: Column) -> Column:
            total = done["total"] + F.least(F.lit(3).cast("long"), at + 3 - done["end"])
            return F.struct(total.alias("total"), (at + 3).alias("end"))

        zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).cast("long").alias("end"))
        return F.aggregate(places, zero, step, lambda done: done["total"])

    # Each array is bound once by a transform over a list of one, as Spark would else compute it again at each use.
    def once(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), 0)

    windows = F.transform(
        place, lambda i: F.struct(*[F.get(words, i + k).alias(c) for k, c in enumerate("abc")], i.alias("at"))
    )
    places = F.coalesce(once(once(keys, repeats), places_of), once(F.sort_array(windows), exact_places))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(covered(places))


def _outcomes(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """Of each test, how many rejected and how many good rows pass it. One pass over the rows."""
    if not tests:
        return []
    sums = []
    for i, test in enumerate(tests):
        covered = F.when(test, 1).otherwise(0)
        sums += [F.sum(covered * F.col("_bad")).alias(f"b{i}"), F.sum(covered * (1 - F.col("_bad"))).alias(f"g{i}")]
    found = rows.agg(*sums).first()
    return [(found[f"b{i}"] or 0, found[f"g{i}"] or 0) for i in range(len(tests))]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _precision(bad: int, good: int) -> float:
    """The share of rejected rows among those covered, drawn towards one half when they are few."""
    return (bad + 1) / (bad + good + 2)


def _grown(rows: DataFrame, candidates: list[Condition]) -> Rule:
    """Adds the condition that raises precision most, weighed by what is still covered, until nothing good is covered."""
    rule: Rule = ()
    (bad, good), = _outcomes(rows, [F.lit(True)])
    for _ in range(MAX_CONDITIONS):
        if good == 0:
            break
        outcomes = _outcomes(rows.filter(_all(rule)), [c.column() for c in candidates])
        gains = [
            (b * (_precision(b, g) - _precision(bad, good)), -i) if b >= LEAST_COVER else (0.0, -i)
            for i, (b, g) in enumerate(outcomes)
        ]
        gain, at = max(gains)
        if gain <= 0:
            break
        bad, good = outcomes[-at]
        rule = (*rule, candidates[-at])
    return rule


def _pruned(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is best on rows held back, and what it covers there. Shorter ones win ties."""
    parts = [rule[: i + 1] for i in range(len(rule))]
    outcomes = _outcomes(rows, [_all(x) for x in parts])
    best = max(range(len(parts)), key=lambda i: (round(_precision(*outcomes[i]), 4), -i))
    return parts[best], *outcomes[best]


def learn(rows: DataFrame, label: str, names: tuple[str, ...], training_rows: int = TRAINING_ROWS) -> list[Rule]:
    """Ordered rules that reject rows, from labelled statistics (1 good, 0 to be rejected).

    At most `training_rows` rows are used, those with the smallest hash of their id; two thirds grow the rules and a third
    prunes them. Each rule is grown on what the rules before it leave, and learning ends with the first rule that is not
    precise. Rows without a label are passed over; without rejected rows there are no rules.
    """
    sample = rows.dropna(subset=[label]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    sample = sample.withColumns({"_bad": (F.col(label) == 0).cast("int"), "_held": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0})
    sample = written(sample.select(*names, "_bad", "_held"), "rules-sample")
    # A bounded sample, so quantiles are cheap; their number is fixed.
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = sample.approxQuantile(list(names), shares, 0.25 / QUANTILES)
    candidates = [
        Condition(name, above, value)
        for name, values in zip(names, found)
        for value in sorted(set(values))
        for above in (True, False)
    ]
    grow, hold = sample.filter("NOT _held"), sample.filter("_held")
    rules: list[Rule] = []
    while candidates and len(rules) < MAX_RULES:
        left = ~reduce(lambda a, b: a | b, (_all(r) for r in rules), F.lit(False))
        rule = _grown(grow.filter(left), candidates)
        if not rule:
            break
        rule, bad, good = _pruned(hold.filter(left), rule)
        if bad + good == 0 or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: the number of the first rule that rejects a row, from 1; 0 if none."""
    out = F
    for i, rule in enumerate(rules):
        out = out.when(_all(rule), i + 1)
    return out.otherwise(0) if rules else F.lit(0)


def described(rules: list[Rule]) -> list[str]:
    """The rules in words."""
    return [" and ".join(map(str, rule)) for rule in rules]


def rated(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The statistics of every document, `base_failed`, `rule` (the rule that rejects it, 0 if none) and `kept`.

    Too short and too repetitive texts fail the base rules and are not kept. The others are judged by rules that are learned
    from those labelled documents that pass the base rules. Of several labels of one id the largest counts; null labels are
    passed over. Null and empty texts fail; repeated rows are rated alike; an empty table gives an empty result.
    """
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(statistics(docs).withColumn("base_failed", base_failed), "rules-statistics")
    known = labels.dropna(subset=["doc_id", label]).groupBy("doc_id").agg(F.max(label).alias("_label"))
    rules = learn(rows.filter("NOT base_failed").join(known, "doc_id"), "_label", tuple(RATIOS))
    rows = rows.withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(verdict(rules)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and which the rules keep."""
    found = rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
