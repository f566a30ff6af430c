import random

import numpy as np
import pytest
import xxhash
from fleetspark.llm import components, simhash
from pyspark.sql import functions as F

from .conftest import words_of


def plain_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(ids, prints, distance):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    found = ids.copy()
    while True:
        smaller = np.where(near, found[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (smaller == found).all():
            return found
        found = smaller


@pytest.mark.parametrize("text", [None, "", " \n", "A", "Ab cD\x0be", "É é x y z", "a b c d " * 50])
def test_fingerprint_equals_its_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_equal_brute_force(spark, small):
    docs, texts = small
    rows = simhash.near_duplicates(docs).collect()
    ids = np.array(sorted(texts))
    prints = np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64)
    wanted = plain_components(ids, prints, 4)
    got = {r["_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in rows}
    assert [got[i] for i in ids] == list(zip(prints.tolist(), wanted.tolist()))


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_find_every_pair_within_the_distance(spark, distance, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_VARIANTS", 20_000)
    chance = random.Random(distance)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        base = chance.getrandbits(64)
        prints.add(base)
        for n in range(1, 6):
            for _ in range(3):
                flipped = base
                for bit in chance.sample(range(64), n):
                    flipped ^= 1 << bit
                prints.add(flipped)
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fingerprint long")
    labels = {r.node: r.root for r in components.components(simhash.links(frame, distance)).collect()}
    roots = [labels.get(int(x), int(x)) for x in values.view(np.int64)]
    wanted = plain_components(np.arange(len(values)), values, distance)
    assert len(set(zip(roots, wanted.tolist()))) == len(set(roots)) == len(set(wanted.tolist()))


@pytest.mark.parametrize("distance", [3, 4])
def test_a_family_of_near_copies_is_dealt_over_many_small_groups(spark, distance, monkeypatch):
    most = 400
    plain = simhash._collisions
    monkeypatch.setattr(simhash, "GROUP_PRINTS", most)

    def guarded(prints, left, low, nearest):
        assert len(prints) <= most, f"{len(prints)} fingerprints in one group"
        yield from plain(prints, left, low, nearest)

    monkeypatch.setattr(simhash, "_collisions", guarded)
    chance = random.Random(distance)
    base, prints = chance.getrandbits(64), {chance.getrandbits(64) for _ in range(1500)}
    # A third of all: they differ in the lowest 40 bits alone, in steps of one to seven bits.
    while len(prints) < 2250:
        prints.add(base ^ sum(1 << bit for bit in chance.sample(range(40), chance.randint(1, 7))))
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fingerprint long")
    found = simhash.links(frame, distance)
    labels = {r.node: r.root for r in components.components(found).collect()}
    roots = [labels.get(int(x), int(x)) for x in values.view(np.int64)]
    wanted = plain_components(np.arange(len(values)), values, distance)
    assert len(set(zip(roots, wanted.tolist()))) == len(set(roots)) == len(set(wanted.tolist()))


def test_a_group_gives_one_link_a_fingerprint(spark):
    chance = random.Random(1)
    base = chance.getrandbits(64)
    prints = {base ^ sum(1 << bit for bit in chance.sample(range(30), 2)) for _ in range(300)}
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fingerprint long")
    # All are alike, and share the leading bits that are dealt by: one group has them all, the others one variant of each.
    assert simhash.links(frame, 4).count() == len(prints) - 1


def test_hard_rows(hard, hard_rows):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == len(hard_rows)
    got = {r["_id"]: r["component_id"] for r in rows if r["_id"] != 11}
    assert got[2] == 1 and got[3] in (1, 3) and got[7] == got[8] == 6
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) <= 1 and 2 not in ids and 1 in ids and {4, 5, 6, 9, 10, 12} <= set(ids) and 7 not in ids


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 400)] + [(7, 7), (500, 499), (499, 500)]
    frame = spark.createDataFrame(links, "a long, b long").unionByName(
        spark.createDataFrame([(None, 3)], "a long, b long")
    )
    got = {r.node: r.root for r in components.components(frame).collect()}
    wanted = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 400)} | {499: 499, 500: 499}
    assert got == wanted
    assert components.components(frame.filter(F.lit(False))).count() == 0
