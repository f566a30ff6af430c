"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance r share a variant within r/2 of either. Every fingerprint therefore emits all variants
within half the radius, the variants are shuffled, and fingerprints that emit an equal one are linked.
"""

import itertools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import given, join_hot, row_key, table, without, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
BITS = 64

# Variants that one array in a task may hold, and fingerprints that a group of the shuffle may.
GROUP_VARIANTS = 1 << 18
GROUP_PRINTS = 1 << 19

# A larger group is dealt by so many more bits at a time, until so few are left that it cannot be large.
MORE_BITS = 6
LEAST_BITS = 8

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one whole text; zero without words.

    A-Z become lower case; shingles are joined by one space and count as often as they occur. A bit is set where over half
    of the shingles' XXH64 (seed 42) have it set.
    """
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle_words:
        begins, ends = begins[: len(words) - shingle_words + 1], ends[shingle_words - 1 :]
    else:
        begins, ends = begins[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(begins)
    for at in range(0, n, 1 << 16):
        pairs = zip(begins[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())
        hashed = np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """`_id`, `_hash` and `fingerprint` (long, two's complement) of every document. Other columns are not carried."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle_words) for x in batch.column("text")]
            prints = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), prints], ["_id", "_hash", "fingerprint"]
            )

    return docs.select(*row_key(), "text").mapInArrow(rows, "_id long, _hash long, fingerprint long")


def flips(bits: int, radius: int) -> list[int]:
    """All masks over so many low bits with at most `radius` of them set."""
    return [
        sum(1 << i for i in chosen) for n in range(radius + 1) for chosen in itertools.combinations(range(bits), n)
    ]


def _collisions(
    prints: np.ndarray, left: np.ndarray, low: int, nearest: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints that emit an equal variant, when the bits above the `low` lowest are settled.

    `left` is how many bits of each may still be flipped. While the variants are too many for one array, the next bit is
    settled either way. The fingerprints that share a variant form a star around the smallest. As all of them lie within
    half the radius of the variant, the star links what all pairs would. With an odd distance the centre is the one `nearest`
    to the variant; where it is not nearer than the others, all distances are even, and those in reach are found at other
    variants too.
    """
    counts = np.bincount(left, minlength=1)
    sizes = [len(flips(low, r)) if counts[r] else 0 for r in range(len(counts))]
    if sum(c * s for c, s in zip(counts.tolist(), sizes)) > GROUP_VARIANTS and low > 8:
        bit = (prints >> np.uint64(low - 1)) & np.uint64(1)
        for value in (0, 1):
            rest = left - (bit != value)
            stay = rest >= 0
            if stay.sum() > 1:
                yield from _collisions(prints[stay], rest[stay], low - 1, nearest)
        return
    keys, owners = [], []
    ones = np.uint64((1 << low) - 1)
    for r in range(len(counts)):
        if counts[r]:
            own = np.flatnonzero(left == r)
            masks = np.array(flips(low, r), np.uint64)
            keys.append(((prints[own] & ones)[:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own, len(masks)))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    in_order = np.sort(key)
    shared = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if len(shared) == 0:
        return
    at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
    hit = shared[at] == key
    group, member = at[hit], prints[owner[hit]]
    if nearest:
        flipped = np.bitwise_count((member & ones) ^ key[hit]).astype(np.int64) - left[owner[hit]]
        order = np.lexsort((member, flipped, group))
    else:
        order = np.lexsort((member, group))
    group, member = group[order], member[order]
    opens = np.r_[True, group[1:] != group[:-1]]
    centre = member[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    yield centre[~opens], member[~opens]


def _roots(root: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The smallest place that each of the places is joined to; their paths are shortened."""
    found = root[places]
    while True:
        further = root[found]
        if (further == found).all():
            break
        found = further
    root[places] = found
    return found


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the places `a` and `b`, pair by pair. `root` has a smaller place or the place itself for each."""
    while len(a):
        a, b = _roots(root, a), _roots(root, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def dealt(prints: DataFrame, radius: int) -> DataFrame:
    """The fingerprints with `low` and `lead`, the groups that their variants within the radius lie in.

    A variant lies in one group: that of its bits above the `low` lowest. The number of leading bits follows from the number
    of fingerprints. Fingerprints that are alike share their leading bits, so a group may still be large; the variants of
    such a group, and only of such, are dealt again by further bits, until no group has more than GROUP_PRINTS rows or no
    more than LEAST_BITS are left (a group has one fingerprint for each variant and each way to flip it then, at most).
    """
    n = prints.count()
    fits = (b for b in range(6, 25) if n * len(flips(b, radius)) <= GROUP_PRINTS << b)
    low = BITS - next(fits, 24)

    def among(ways: list[int]) -> Column:
        return F.array(*[F.lit(m).cast("long") for m in ways])

    top = F.shiftrightunsigned("fingerprint", low)
    masks = among(flips(BITS - low, radius))
    sent = prints.select("fingerprint", F.explode(F.transform(masks, lambda m: top.bitwiseXOR(m))).alias("lead"))
    settled = []
    while low > LEAST_BITS:
        # One row in GROUP_PRINTS at most is the lead of a large group.
        large = written(sent.groupBy("lead").count().filter(F.col("count") > GROUP_PRINTS).select("lead"), "simhash-large")
        if large.isEmpty():
            break
        settled.append(sent.join(F.broadcast(large), "lead", "left_anti").select("fingerprint", F.lit(low).alias("low"), "lead"))
        more = min(MORE_BITS, low - LEAST_BITS)
        used = F.bit_count(F.shiftrightunsigned("fingerprint", low).bitwiseXOR(F.col("lead")))
        bits = F.shiftrightunsigned("fingerprint", low - more).bitwiseAND(F.lit((1 << more) - 1))
        ways = F.filter(among(flips(more, radius)), lambda m: F.bit_count(m) + used <= radius)
        leads = F.transform(ways, lambda m: F.shiftleft("lead", more).bitwiseOR(bits.bitwiseXOR(m)))
        sent = sent.join(F.broadcast(large), "lead").select("fingerprint", F.explode(leads).alias("lead"))
        sent = written(sent, "simhash-sent")
        low -= more
    found = sent.select("fingerprint", F.lit(low).alias("low"), "lead")
    for frame in settled:
        found = found.unionByName(frame)
    return found


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints, which connect what all pairs within the distance would connect.

    Variants are dealt by their leading bits, hot groups by more of them. A fingerprint is sent to each group that some variant
    of it lies in, and its variants in that group are spelt out there, so the shuffle carries a few dozen rows per
    fingerprint, not thousands of variants. A group joins its pairs as they are found and gives one link for each fingerprint
    that is joined to a smaller one, however many pairs there are. Both ends of a link may be further apart than a pair.
    """
    radius = (max_distance + 1) // 2

    def pairs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low, lead = int(key[0]), int(key[1])
        own = np.unique(group["fingerprint"].to_numpy().view(np.uint64))
        used = np.bitwise_count((own >> np.uint64(low)) ^ np.uint64(lead)).astype(np.int8)
        root = np.arange(len(own))
        for a, b in _collisions(own, radius - used, low, nearest=max_distance % 2 == 1):
            near = np.bitwise_count(a ^ b) <= max_distance
            _join(root, np.searchsorted(own, a[near]), np.searchsorted(own, b[near]))
        first = _roots(root, np.arange(len(own)))
        joined = first != np.arange(len(own))
        return pd.DataFrame({"a": own[first[joined]].view(np.int64), "b": own[joined].view(np.int64)})

    return dealt(prints, radius).groupBy("low", "lead").applyInPandas(pairs, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """Near-duplicate groups: `_id`, `_hash`, `fingerprint` (long) and `component_id` of every document.

    Documents are linked when their fingerprints differ in at most `max_distance` bits, and `component_id` is the smallest
    id that links reach. Null and empty texts have fingerprint zero and are linked like any other; a null id counts as the
    largest long. Repeated rows stay repeated; an empty table gives an empty result. Only `doc_id` and `text` are read.
    """
    rows = written(fingerprints(docs, shingle_words), "simhash-rows")
    per_print = written(
        rows.groupBy("fingerprint").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "simhash-prints"
    )
    linked = components(links(per_print.select("fingerprint"), max_distance))
    rooted = per_print.join(linked, per_print["fingerprint"] == linked["node"], "left").select(
        "fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(rooted.drop("least").join(least, "root").drop("root"), "simhash-labels")
    return join_hot(rows, labels, "fingerprint", "n").select("_id", "_hash", "fingerprint", "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(
        given("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        given("component_id").alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; one of them where a row is repeated."""
    groups = written(near_duplicates(docs), "simhash-groups")
    first = groups.filter("_id = component_id").groupBy("_id").agg(F.min("_hash").alias("first_hash"))
    dropped = groups.join(first, "_id", "left").filter("first_hash IS NULL OR _hash <> first_hash")
    kept = without(docs, written(dropped.select("_id", "_hash").distinct(), "simhash-dropped"))
    repeated = written(groups.groupBy("_id", "_hash").count().filter("count > 1"), "simhash-repeated")
    if repeated.isEmpty():
        return kept
    keyed = kept.select(F.struct("*").alias("_row"), *row_key())
    again = keyed.join(repeated, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return without(kept, repeated).unionByName(again.select("_row.*"))
