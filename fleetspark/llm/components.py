"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

# A node with many links is worked on in so many parts.
SALTS = 16


def _smallest(edges: DataFrame, from_: str, to: str) -> DataFrame:
    """Each link (from, to) with `least`, the smallest of `from` and all its neighbours.

    The neighbours of one node are reduced before the shuffle, and the links of one node are spread over several parts.
    """
    least = edges.groupBy(F.col(from_).alias("node")).agg(F.min(to).alias("near"))
    least = least.select("node", F.least("node", "near").alias("least"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(to), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), (salted[from_] == spread["node"]) & (salted["salt"] == spread["salt"])).select(
        from_, to, "least"
    )


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """`node` and `root`, the smallest node of its component, for every node in the links `a`, `b`.

    Alternates large and small stars until the links no longer change: every link ends up pointing at the smallest node.
    Each round is a written table, so the plan stays short and lost executors cost one round. Links with a null end are
    ignored, repeated ones and loops do no harm, and no links give no nodes.
    """
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    edges = written(links.dropna().select(high, low).filter("high <> low").distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        large = _smallest(both, "high", "low").filter("low > high").select(F.col("low").alias("high"), "least")
        large = large.filter("high <> least").distinct().withColumnRenamed("least", "low")
        large = written(large, name)
        small = _smallest(large, "high", "low")
        kept = small.select("high", "least").union(small.filter("low <> least").select("low", "least"))
        edges = written(kept.filter("high <> least").distinct().toDF("high", "low"), name)
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return nodes.union(edges.select("low", "low").distinct())
