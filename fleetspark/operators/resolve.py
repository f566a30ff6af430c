"""Resolution of possibly misspelt asset ids.

Two strings within edit distance one always share a variant: the string itself, or the string less one character. That
turns the fuzzy match into an equi join on variants. Equal misspellings are resolved once, however often they occur, and
a variant has at most (length x alphabet) ids, so no join key is hot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import asset_ids, explode_rows, normalise_key

# Ids with one of these prefixes match within the prefix only.
CLASS_PREFIX = r"^((?:WT|PV)-)"


def _variants(name: str) -> Column:
    """The text and every copy of it that lacks one character."""
    text = F.col(name)
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )
    return F.when(F.length(text) > 0, F.array_distinct(F.concat(F.array(text), shorter))).otherwise(F.array(text))


def resolve_ids(queries: DataFrame, registry: DataFrame, prefix_pattern: str = CLASS_PREFIX) -> DataFrame:
    """One row per distinct non-null query text: the asset it means, the edit distance, and how many ids tie for it.

    An exact id wins. Otherwise the closest id at distance one, within the query's prefix if it has one, and the
    smallest id on a tie; `ambiguous` tells that there was a tie. Without a match `asset_id` is null.
    """
    # The filters on null are those that the joins below would add to some of their branches. Stated here they are the same
    # in all branches, so that the distinct ids are shuffled once and reused.
    wanted = (
        queries.select("raw_id", normalise_key(F.col("raw_id")).alias("query_id"))
        .filter(F.col("query_id").isNotNull())
        .distinct()
    )
    # The planner takes variants to be as small as the table that they are made from, and would broadcast them; the hints
    # shuffle and sort both sides of each join, whatever the number of ids and queries.
    ids = registry.select("asset_id").filter(F.col("asset_id").isNotNull()).distinct()
    looked_up = wanted.join(ids.hint("merge"), wanted["query_id"] == ids["asset_id"], "left")
    exact = looked_up.filter(F.col("asset_id").isNotNull()).select(
        "raw_id", "asset_id", F.lit(0).cast("bigint").alias("distance"), F.lit(1).cast("bigint").alias("n_ties")
    )
    open_queries = looked_up.filter(F.col("asset_id").isNull()).select("raw_id", "query_id")

    prefix = F.regexp_extract("query_id", prefix_pattern, 1)
    by_variant = open_queries.select(
        "raw_id", "query_id", prefix.alias("prefix"), F.explode(_variants("query_id")).alias("variant")
    )
    id_variants = ids.select("asset_id", F.explode(_variants("asset_id")).alias("variant"))
    close = (
        by_variant.join(id_variants.hint("merge"), "variant")
        .filter(F.startswith("asset_id", "prefix"))
        .filter(F.levenshtein("query_id", "asset_id", 1) == 1)
        .groupBy("raw_id")
        .agg(F.min("asset_id").alias("asset_id"), F.countDistinct("asset_id").alias("n_ties"))
        .select("raw_id", "asset_id", F.lit(1).cast("bigint").alias("distance"), "n_ties")
    )
    fuzzy = open_queries.select("raw_id").join(close.hint("merge"), "raw_id", "left")
    return (
        exact.unionByName(fuzzy)
        .fillna(0, ["n_ties"])
        .withColumn("ambiguous", F.col("n_ties") > 1)
    )


def lookup_requests(requests: DataFrame, registry: DataFrame, prefix_pattern: str = CLASS_PREFIX) -> DataFrame:
    """Status of the ids in each question: `ok`, `partial` when some are unknown, or `error`.

    The resolved ids keep the order in which the question names them. Each list holds the ids of one question only.
    """
    numbered = F.transform(
        asset_ids(F.col("question")), lambda raw_id, place: F.struct(place.alias("position"), raw_id.alias("raw_id"))
    )
    mentions = explode_rows(requests, ["request_id"], numbered).select("request_id", "item.*")
    resolved = mentions.join(resolve_ids(mentions, registry, prefix_pattern), "raw_id", "left")
    found = F.struct("position", "asset_id")
    unknown = F.struct("position", F.concat(F.lit("Asset '"), F.col("raw_id"), F.lit("' not found")).alias("error"))
    lists = resolved.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("asset_id").isNotNull(), found))).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("asset_id").isNull(), unknown))).alias("unknown"),
        F.count_if("ambiguous").alias("ambiguous_ids"),
    )
    n_found = F.coalesce(F.size("found"), F.lit(0))
    n_unknown = F.coalesce(F.size("unknown"), F.lit(0))
    return requests.join(lists, "request_id", "left").select(
        "request_id",
        F.when(n_found + n_unknown <= 0, "error")
        .when(n_unknown <= 0, "ok")
        .when(n_found > 0, "partial")
        .otherwise("error")
        .alias("status"),
        F.coalesce(F.col("found.asset_id"), F.array().cast("array<string>")).alias("asset_ids"),
        F.when(n_found + n_unknown <= 0, "No asset id in the question")
        .when(n_unknown > 0, F.array_join("unknown.error", "; "))
        .alias("error"),
        F.coalesce("ambiguous_ids", F.lit(0)).cast("bigint").alias("ambiguous_ids"),
    )
