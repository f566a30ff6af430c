"""A Merkle manifest of the documents: every row a leaf, a tree for each source, and one over the sources.

A tree is cut into superblocks of 3 ** 6 leaves. Their tops are reduced again in superblocks until each tree has one node, so a
few rounds reach any height. The nodes that a superblock needs from outside come back as its outer path; leaves and outer
paths are cogrouped by superblock, and one task finishes the reduction, joins the proofs and folds them.
"""

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ranked, table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Consecutive nodes that have one parent, and levels that a superblock spans.
ARITY = 3
LEVELS = 6
SUPERBLOCK = ARITY**LEVELS

_NODE = "tree long, at long, n long, node string, block long"
_PATH = "tree long, at long, lefts array<string>, rights array<string>, top string"


def digest(*nodes: str) -> str:
    """The lowercase hex sha256 of the inputs, one after another."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool) -> list[list[str]]:
    """The nodes and all levels above them: up to one node if they are the whole tree, else through a superblock's height."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([digest(*last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def path_of(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's ancestors in their runs, level by level."""
    lefts, rights = [], []
    for level in levels[:-1]:
        first = at - at % ARITY
        lefts.append("".join(level[first:at]))
        rights.append("".join(level[at + 1 : first + ARITY]))
        at //= ARITY
    return lefts, rights


def folded(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a node and the path beside it give."""
    for left, right in zip(lefts, rights):
        node = digest(left, node, right)
    return node


def _superblocks(frame: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame, list[list[str]]]]:
    """Each superblock of a group: its tree and number, its rows in order, and its levels."""
    frame = frame.sort_values(["tree", "at"], kind="stable")
    number = frame["at"].to_numpy() // SUPERBLOCK
    tree = frame["tree"].to_numpy()
    cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(number) != 0)) + 1
    for first, last in zip([0, *cuts], [*cuts, len(frame)]):
        if first < last:
            rows = frame.iloc[first:last]
            yield (int(tree[first]), int(number[first])), rows, levels_of(rows["node"].tolist(), int(rows["n"].iloc[0]) <= SUPERBLOCK)


def _tops(frame: pd.DataFrame) -> pd.DataFrame:
    """The top of each superblock of a group, as a node of the tree above."""
    rows = []
    for (tree, number), own, levels in _superblocks(frame):
        rows.append((tree, number, -(-int(own["n"].iloc[0]) // SUPERBLOCK), levels[-1][0]))
    return pd.DataFrame(rows, columns=["tree", "at", "n", "node"])


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The path of each node of a group up to the top of its tree."""
    beyond = {(t, a): (list(x), list(y), top) for t, a, x, y, top in zip(*[outer[c] for c in ("tree", "at", "lefts", "rights", "top")])}
    rows = []
    for key, own, levels in _superblocks(nodes):
        lefts, rights, top = beyond[key]
        for i, at in enumerate(own["at"].tolist()):
            own_lefts, own_rights = path_of(levels, i)
            rows.append((key[0], at, own_lefts + lefts, own_rights + rights, top))
    return pd.DataFrame(rows, columns=["tree", "at", "lefts", "rights", "top"])


def _block(tree: Column, number: Column) -> Column:
    return F.xxhash64(tree, number)


def _outer(nodes: DataFrame) -> DataFrame:
    """For each superblock of the nodes (`tree`, `at`), the path from its top to the top of its tree, and that top.

    Each round leaves one node of 729, so even a thousand billion leaves take five.
    """
    tops = written(nodes.groupBy("block").applyInPandas(_tops, "tree long, at long, n long, node string"), "merkle-tops")
    none = F.array().cast("array<string>")
    alone = tops.filter("n = 1").select("tree", "at", none.alias("lefts"), none.alias("rights"), F.col("node").alias("top"))
    higher = tops.filter("n > 1").withColumn("block", _block(F.col("tree"), F.floor(F.col("at") / SUPERBLOCK)))
    return alone if higher.isEmpty() else alone.unionByName(_to_top(higher))


def _to_top(nodes: DataFrame) -> DataFrame:
    """The path of each node up to the top of its tree. `block` of a superblock's nodes must follow from (tree, number)."""
    outer = _outer(nodes).withColumn("block", _block(F.col("tree"), F.col("at")))
    return written(nodes.groupBy("block").cogroup(outer.groupBy("block")).applyInPandas(_paths, _PATH), "merkle-paths")


def leaf_of(text: Column) -> Column:
    """The digest of a row: of each field `-` if null, else its bytes, a colon and its value."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    told = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (x.cast("string") for x in fields)]
    return F.sha2(F.concat(*told), 256)


def manifest(docs: DataFrame, presented: Column | None = None, with_proofs: bool = True) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, on demand, proof_lefts and proof_rights.

    `presented` is the text that someone shows later, as an expression over the documents (by default the text itself).
    `folded_root` is what its leaf and the proof of the original give, and `verified` whether that is the root.

    A source's leaves are in ascending order of doc_id, nulls first; rows of equal id are in the order of their leaves, and
    rows equal in everything are leaves each. A null source is one source, the first. Nulls count as their own mark, empty
    texts as empty, and an empty table gives an empty result. A leaf alone is its subroot, a subroot alone the root, and an
    only document has the proof of nothing. Columns but doc_id, source, lang, n_chars and text matter only to `presented`.

    Texts are read once and never shuffled. A superblock holds 729 leaves at most, and one group the superblocks that begin
    within 729 places, so neither large nor many small sources make a group large or groups many.
    """
    text = F.col("text").cast("string")
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_of(text).alias("leaf"),
        leaf_of(text if presented is None else presented).alias("shown"),
        # Tells repeated rows apart, so that they may fill several partitions.
        F.monotonically_increasing_id().alias("_tie"),
    )
    leaves = written(leaves, "merkle-leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    placed = ranked(leaves, *order)
    sources = placed.groupBy("source").agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    sources = written(ranked(sources, F.col("source").asc_nulls_first()).withColumnRenamed("rank", "tree"), "merkle-sources")

    at = F.col("rank") - F.col("start")
    first = F.col("start") + F.floor(at / SUPERBLOCK) * SUPERBLOCK
    placed = placed.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select(
        "doc_id", "tree", at.alias("at"), "n", F.col("leaf").alias("node"), "shown", F.floor(first / SUPERBLOCK).alias("block")
    )
    placed = written(placed, "merkle-placed")
    outer = written(_outer(placed.select("tree", "at", "n", "node", "block")), "merkle-outer")

    # The tree over the sources. Every superblock's outer path ends in the subroot; each tree has a first superblock.
    subroots = outer.filter("at = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("top").alias("node"))
    subroots = subroots.withColumn("n", F.lit(sources.count()).cast("long"))
    subroots = written(subroots.withColumn("block", _block(F.col("tree"), F.floor(F.col("at") / SUPERBLOCK))), "merkle-subroots")
    above = _to_top(subroots.select(*[c.split()[0] for c in _NODE.split(", ")]))
    above = above.select(F.col("at").alias("tree"), F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights"), F.col("top").alias("root"))

    number = F.floor((F.col("start") + F.col("at") * SUPERBLOCK) / SUPERBLOCK)
    beyond = outer.join(above, "tree").join(sources.select("tree", "start"), "tree")
    beyond = beyond.select(
        "tree", "at", "top", "root", number.alias("block"),
        F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights"),
    )

    def proved(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return _proved(leaves, outer, with_proofs)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", proof_lefts array<string>, proof_rights array<string>" if with_proofs else ""
    return placed.groupBy("block").cogroup(beyond.groupBy("block")).applyInPandas(proved, schema)


def _proved(leaves: pd.DataFrame, outer: pd.DataFrame, with_proofs: bool) -> pd.DataFrame:
    """The results of a group's leaves: their superblocks are reduced, and the proofs joined to the outer paths and folded."""
    names = ["tree", "at", "lefts", "rights", "top", "root"]
    beyond = {(t, a): (list(x), list(y), top, root) for t, a, x, y, top, root in zip(*[outer[c] for c in names])}
    rows = []
    for key, own, levels in _superblocks(leaves):
        lefts, rights, subroot, root = beyond[key]
        for i, (leaf, shown) in enumerate(zip(own["node"].tolist(), own["shown"].tolist())):
            own_lefts, own_rights = path_of(levels, i)
            own_lefts, own_rights = own_lefts + lefts, own_rights + rights
            proof = digest(*[x for pair in zip(own_lefts, own_rights) for x in pair])
            back = folded(shown, own_lefts, own_rights)
            row = (leaf, subroot, root, proof, back, back == root)
            rows.append((*row, own_lefts, own_rights) if with_proofs else row)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof_lefts", "proof_rights"]
    out = pd.DataFrame(rows, columns=names if with_proofs else names[:6])
    out.insert(0, "doc_id", leaves.sort_values(["tree", "at"], kind="stable")["doc_id"].astype("Int64").to_numpy())
    return out


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, held against texts of which every second has lost its line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), shown, with_proofs=False)
