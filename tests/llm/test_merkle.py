import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetspark.llm import merkle
from fleetspark.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    told = (None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text))
    return h(*["-" if x is None else f"{len(x.encode())}:{x}" for x in told])


def tree(nodes):
    """The root, and for each node its siblings as (left, right) level by level."""
    paths, holders = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for j, own in enumerate(holders[i : i + 3]):
                for k in own:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h(*run))
            below.append(sum(holders[i : i + 3], []))
        nodes, holders = above, below
    return nodes[0], paths


def expected(rows):
    """The results of (doc_id, text, lang, source, n_chars) rows, straight from the definition."""
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        sources[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), (lang, n_chars, text)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subtrees = {s: tree([x[1] for x in sources[s]]) for s in order}
    root, upper = tree([subtrees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        subroot, paths = subtrees[s]
        for (doc_id, node, (lang, n_chars, text)), path in zip(sources[s], paths):
            siblings = path + above
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            back = leaf(doc_id, s, lang, n_chars, text)
            for left, right in siblings:
                back = h(left, back, right)
            out.append((doc_id, node, subroot, root, h(*[x for p in siblings for x in p]), back, back == root))
    return sorted(out, key=repr)


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in df.select(*names).collect()], key=repr)


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def test_the_query_equals_the_definition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    want = expected([tuple(r) for r in rows])
    assert found(QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.01")) == want
    assert {w[-1] for w in want} == {True, False}


def test_hard_rows(hard, hard_rows):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in hard_rows]
    assert found(merkle.manifest(hard, tampered())) == expected(rows)


@pytest.mark.parametrize("many", [1, 3, 730, 2188])
def test_heights_of_trees(spark, many):
    """One large source beside small ones; superblocks that end in a single leaf."""
    docs = spark.range(many + 40).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < many, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 30).cast("string"))).alias("source"),
        F.lit("en").alias("lang"),
        F.lit(1).alias("n_chars"),
        F.concat(F.lit("a\nb"), F.col("id").cast("string")).alias("text"),
    )
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    assert found(merkle.manifest(docs, tampered(), with_proofs=False)) == expected(rows)


def test_three_rounds_of_superblocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SUPERBLOCK", 3)
    rows = [(i, f"t\n{i}", "en", "one" if i < 200 else f"s{i}", i) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(merkle.manifest(docs, tampered())) == expected(rows)


def test_a_proof_folds_to_the_root_and_repeated_rows_are_leaves_each(spark):
    rows = [(7, "same", "en", "a", 4)] * 2000 + [(None, None, None, None, None)] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs).collect()
    assert len(got) == 3000 and all(r.verified for r in got)
    assert all(merkle.folded(r.leaf, r.proof_lefts, r.proof_rights) == r.root for r in got)


def test_an_only_document_and_an_empty_table(spark, empty):
    docs = spark.createDataFrame([(1, "x", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    one = merkle.manifest(docs).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h()
    assert merkle.manifest(empty).count() == 0
