"""Language identification by Bayesian evidence fusion.

The likelihood of the text under a byte-trigram model of each language is combined with what the markup declares, and with a
prior for the host that shrinks towards its site, the address suffix and the whole corpus. All counts are grouped
aggregations over the whole corpus; one more class, `other`, has a uniform model and stands for text in no known language.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import given, join_hot, table, without, written
from .words import slices, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANGUAGES = ("en", "de", "fr", "es")
OTHER = "other"

BUCKETS = 1 << 14

# Overlapping trigrams are not independent: a text counts as at most so many.
EFFECTIVE_GRAMS = 50

# Documents that the parent's distribution is worth in a suffix, site or host.
PRIOR_DOCUMENTS = 10.0

# A document is rejected below this probability of its best language.
LEAST_PROBABILITY = 0.5


def evidence(
    rows: DataFrame, row_id: Column, text: Column, declared: Column, host: Column, suffix: Column, languages: tuple = LANGUAGES
) -> DataFrame:
    """The columns that the operator works on, from any table: `_id`, `_hash`, `text`, `declared`, `host`, `site`, `suffix`.

    `declared` becomes one of the languages by its primary subtag, `other` for another one, and null when nothing is
    declared. A host without an address suffix is its own site.
    """
    tag = F.regexp_extract(F.lower(F.trim(declared)), "^[a-z]+", 0)
    known = F.when(tag.isin(*languages), tag).when(tag != "", F.lit(OTHER))
    host, suffix = F.coalesce(host, F.lit("")), F.coalesce(suffix, F.lit(""))
    text = F.coalesce(text, F.lit(""))
    return rows.select(
        F.coalesce(row_id.cast("long"), F.lit(2**63 - 1)).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        text.alias("text"),
        known.alias("declared"),
        host.alias("host"),
        F.when(suffix == "", host).otherwise(F.substring_index(host, ".", -2)).alias("site"),
        suffix.alias("suffix"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of `documents`: `lang` is what is declared, the source is the host, and there is no address."""
    return evidence(docs, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the lang attribute of the html tag, and host and suffix of the address."""
    host = F.lower(F.regexp_extract("url", "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    hidden = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-z]+)""", 1)
    return evidence(
        pages,
        F.col("page_id"),
        F.regexp_replace("html", hidden, " "),
        F.when(declared != "", declared),
        host,
        F.regexp_extract(host, r"\.([a-z]+)$", 1),
    )


def _classes() -> np.ndarray:
    """What each byte counts as: ASCII letters in lower case, bytes of other letters as they are, all else a space."""
    kept = np.full(256, 32, np.uint32)
    kept[97:123] = kept[65:91] = np.arange(97, 123)
    kept[128:] = np.arange(128, 256)
    return kept


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte trigram with a letter, and the text that it is in."""
    raw, at = text_bytes(texts)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = _classes()[raw]
    joined = (seen[:-2] << 16) | (seen[1:-1] << 8) | seen[2:]
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    good = (text[:-2] == text[2:]) & (joined != 0x202020)
    bucket = (joined[good] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), text[:-2][good]


def fit(rows: DataFrame, languages: tuple = LANGUAGES) -> np.ndarray:
    """Log probabilities, languages x buckets, from all texts that declare one of the languages. The last row is uniform."""
    number = {name: i for i, name in enumerate(languages)}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, text = grams_of(part.column("text"))
                language = np.array([number[x] for x in part.column("declared").to_pylist()], np.int64)
                total += np.bincount(language[text] * BUCKETS + bucket, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    known = rows.filter(F.col("declared").isin(*languages)).select("declared", "text")
    # At most languages x buckets numbers reach the driver.
    found = known.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.full((len(languages) + 1, BUCKETS), 0.5)
    for cell, n in found:
        total[cell // BUCKETS, cell % BUCKETS] += n
    total[-1] = 1.0
    return np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """The evidence without the texts, with `n_grams` and `logs`, the tempered log likelihood of each class."""
    carried = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, text = grams_of(part.column("text"))
                n = np.bincount(text, minlength=part.num_rows)
                sums = np.stack([np.bincount(text, weights=row[bucket], minlength=part.num_rows) for row in model], 1)
                logs = sums * np.minimum(1.0, EFFECTIVE_GRAMS / np.maximum(n, 1))[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(logs.ravel()), len(model)).cast(pa.list_(pa.float64()))
                columns = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), lists], [*carried, "n_grams", "logs"])

    schema = "_id long, _hash long, declared string, host string, site string, suffix string, n_grams long, logs array<double>"
    return rows.mapInArrow(score, schema)


def _softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _mass(classes: int) -> Column:
    return F.array(*[F.sum(F.get("mass", F.lit(i))) for i in range(classes)]).alias("mass")


def _host_priors(scored: DataFrame, classes: int) -> tuple[DataFrame, int, list[float]]:
    """`host`, and the documents and the mass of each class on it, its site and its suffix; and those of the corpus.

    Hosts, sites, suffixes and the corpus are each summed from the level below, so no level meets the documents again.
    """
    hosts = scored.groupBy("suffix", "site", "host").agg(F.count("*").alias("n"), _mass(classes))
    hosts = written(hosts, "language-hosts")
    sites = written(hosts.groupBy("suffix", "site").agg(F.sum("n").alias("n"), _mass(classes), F.count("*").alias("hosts")), "language-sites")
    suffixes = written(sites.groupBy("suffix").agg(F.sum("n").alias("n"), _mass(classes), F.count("*").alias("sites")), "language-suffixes")
    every = suffixes.agg(F.sum("n").alias("n"), _mass(classes)).first()
    top = suffixes.select("suffix", "sites", F.col("n").alias("suffix_n"), F.col("mass").alias("suffix_mass"))
    above = ["suffix_n", "suffix_mass"]
    middle = join_hot(sites, written(top, "language-suffixes"), "suffix", "sites").select(
        F.struct("suffix", "site").alias("place"), "hosts", F.col("n").alias("site_n"), F.col("mass").alias("site_mass"), *above
    )
    placed = hosts.withColumn("place", F.struct("suffix", "site"))
    placed = join_hot(placed, written(middle, "language-sites"), "place", "hosts")
    placed = placed.select("host", "n", F.col("mass").alias("host_mass"), "site_n", "site_mass", *above)
    return placed, every["n"] or 0, [x or 0.0 for x in every["mass"]]


def identify(rows: DataFrame, languages: tuple = LANGUAGES) -> DataFrame:
    """`_id`, `_hash`, `declared`, `host`, `language`, `probability` and `kept` of each row of `evidence`.

    Rejected (`kept` false) are rows whose best class is `other` or has a probability below one half, and rows whose text
    has no letters: null, empty or symbols only. They get the language that the other evidence suggests. Without a declared
    language or host that evidence is neutral. Repeated rows are rated alike; whole texts are read; an empty table gives an
    empty result. A row's own text does not count towards its prior, neither on its host nor on the levels above.
    """
    classes = [*languages, OTHER]
    scored = _likelihoods(rows, fit(rows, languages)).withColumn(
        "mass", F.when(F.col("n_grams") > 0, _softmax(F.col("logs"))).otherwise(F.array(*[F.lit(1 / len(classes))] * len(classes)))
    )
    scored = written(scored, "language-rows")
    # How often each class is declared as each: at most classes x classes numbers.
    seen = {r["declared"]: r["mass"] for r in scored.dropna(subset=["declared"]).groupBy("declared").agg(_mass(len(classes))).collect()}
    table_ = np.array([seen.get(c, [0.0] * len(classes)) for c in classes]) + 0.5
    logs = np.log(table_ / table_.sum(axis=0))
    declares = F.lit(None).cast("array<double>")
    for c, row in zip(classes, logs.tolist()):
        declares = F.when(F.col("declared") == c, F.array(*map(F.lit, row))).otherwise(declares)

    priors, n_all, mass_all = _host_priors(scored, len(classes))
    joined = join_hot(scored, written(priors, "language-priors"), "host", "n")

    def others(i: int) -> Column:
        """The prior of a class on the host, from all other documents there, on its site, of its suffix and in the corpus."""
        own = F.get("mass", F.lit(i))
        prior = (F.greatest(F.lit(mass_all[i]) - own, F.lit(0.0)) + 1) / F.lit(n_all - 1 + len(classes))
        for n, mass in (("suffix_n", "suffix_mass"), ("site_n", "site_mass"), ("n", "host_mass")):
            rest = F.greatest(F.get(mass, F.lit(i)) - own, F.lit(0.0))
            prior = (rest + PRIOR_DOCUMENTS * prior) / (F.col(n) - 1 + PRIOR_DOCUMENTS)
        return prior

    fused = F.array(
        *[
            F.get("logs", F.lit(i)) + F.log(others(i)) + F.coalesce(F.get(declares, F.lit(i)), F.lit(0.0))
            for i in range(len(classes))
        ]
    )
    rated = joined.withColumn("chances", _softmax(fused)).withColumn("probability", F.array_max("chances"))
    best = F.get(F.array(*map(F.lit, classes)), F.array_position("chances", F.col("probability")).cast("int") - 1)
    rated = rated.withColumn("language", best)
    kept = (F.col("language") != OTHER) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("n_grams") > 0)
    return rated.select("_id", "_hash", "declared", "host", "language", "probability", kept.alias("kept"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is known. Their columns, `lang` too, stay as they are."""
    rejected = identify(of_documents(docs)).filter("NOT kept").select("_id", "_hash").distinct()
    return without(docs, written(rejected, "language-rejected"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    found = identify(of_documents(table(spark, sf_dir, "documents")))
    return found.select(given("_id").alias("doc_id"), "declared", "language", "probability", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every web page, where addresses and markup give evidence too."""
    found = identify(of_pages(table(spark, sf_dir, "pages")))
    return found.select(given("_id").alias("page_id"), "host", "declared", "language", "probability", "kept")
