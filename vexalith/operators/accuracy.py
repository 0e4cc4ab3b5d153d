"""How good an approximate search is, against the exact one.

Both take (query_id, neighbour_id, rank) rows. recall and precision are the share of hits among the
exact and the found; mrr is the usual reciprocal rank of the first hit, reciprocal_sum the sum of
reciprocal ranks of all hits divided by k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    truth = exact.where(F.col("rank") <= k).select("query_id", "neighbour_id", F.lit(1).alias("true"))
    got = found.where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank")
    both = truth.join(got, ["query_id", "neighbour_id"], "full")
    hit = F.col("true").isNotNull() & F.col("rank").isNotNull()
    return both.groupBy("query_id").agg(
        F.sum(hit.cast("int")).alias("hits"),
        F.count("true").alias("wanted"),
        F.count("rank").alias("given"),
        F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        (F.coalesce(F.sum(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)) / k).alias("rs"),
    )


def measures(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: recall, precision, mrr, reciprocal_sum, averaged over the queries."""
    share = lambda n: F.avg(F.when(F.col(n) > 0, F.col("hits") / F.col(n)))
    return per_query(found, exact, k).agg(share("wanted").alias("recall"), share("given").alias("precision"), F.avg("rr").alias("mrr"), F.avg("rs").alias("reciprocal_sum"))


def distance_error(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: the mean over queries and ranks of found distance minus exact distance."""
    f = found.where(F.col("rank") <= k).select("query_id", "rank", F.col("distance").alias("f"))
    e = exact.where(F.col("rank") <= k).select("query_id", "rank", F.col("distance").alias("e"))
    return f.join(e, ["query_id", "rank"]).agg(F.avg(F.col("f") - F.col("e")).alias("distance_error"))
