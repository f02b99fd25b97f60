"""Evaluation metrics over rankings, cells and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query with gold: hits in the first ``k``, over ``k`` (however few were found) and over the gold's size.
    ``ranked``: (``query_id``, ``doc_id``, ``rank``); ``gold``: (``query_id``, ``doc_id``)."""
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    n = F.coalesce("hits", F.lit(0))
    return size.join(hits, "query_id", "left").select("query_id", n.alias("hits"), (n / k).alias("precision"), (n / F.col("n_gold")).alias("recall"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Means over the scored queries, NULL where there is none."""
    return per_query.agg(F.count(F.lit(1)).alias("n_scored"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def refusal_rate(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """How many of the queries got nothing, and their share; NULL without queries."""
    found = ranked.select("query_id").distinct().withColumn("found", F.lit(True))
    refused = F.count_if(F.col("found").isNull())
    return queries.join(found, "query_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), refused.alias("n_refused"), F.try_divide(refused, F.count(F.lit(1))).alias("rate"))


def cell_accuracy(gold: DataFrame, actual: DataFrame, keys: list[str], group: str, tolerance: float = 1.0) -> DataFrame:
    """Matching cells per group and over all (a NULL group): equal, both missing, or within the tolerance. Cells the
    actual lacks count as missing."""
    told = actual.select(*keys, F.col("value").alias("actual_value"))
    joined = gold.join(told, keys, "left")
    g, a = F.col("value"), F.col("actual_value")
    same = g.eqNullSafe(a) | F.coalesce(F.abs(g - a) <= tolerance, F.lit(False))
    n, hit = F.count(F.lit(1)), F.count_if(same)
    return joined.rollup(group).agg(hit.alias("n_match"), n.alias("n_cells"), F.round(F.coalesce(F.try_divide(hit, n), F.lit(0.0)), 6).alias("accuracy"))
