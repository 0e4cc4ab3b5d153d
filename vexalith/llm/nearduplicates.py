"""Problem 1: groups of near-duplicate records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alike import candidates, checked, corpus_counts, plain
from .common import components, cut, table


def near_duplicate_groups(docs: DataFrame, id_col: str = "id", content_col: str = "content", embedding_col: str = "embedding") -> DataFrame:
    """(id, group_id) for every record of a group of two or more; group_id is the group's least id.

    Records are grouped, directly or through others, when their contents share at least 0.80 of
    their words or their embeddings have a cosine of at least 0.98. Contents are joined by the
    size-aware heavy-light join of ``alike.py``, embeddings by subsets of their signs. Null, empty
    or short contents (under eight words) and unusable embeddings join nothing; an empty table
    gives no rows; equal records are one class and cost one comparison; other columns are ignored.
    ids must be unique; records of null id are left out.
    """
    docs = plain(docs, id_col, content_col, embedding_col)
    counts = corpus_counts(docs)
    if not counts[0]:
        return docs.select("id", F.col("id").alias("group_id")).limit(0)
    pairs = candidates(docs, counts)
    edges = cut(checked(docs, pairs).select("a", "b").unionByName(pairs.where("kind >= 10").select("a", "b")))
    groups = components(edges)
    if pairs.where("kind = -1").limit(1).count():
        # Hot signatures gave stars; what their members still need is pairs across groups.
        labels = groups.select("node", F.col("root").alias("label"))
        more = checked(docs, candidates(docs, counts, labels, "labels")).select("a", "b")
        groups = components(edges.unionByName(more))
    return groups.select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of each group: the form the stated result asks for."""
    a = groups.select("group_id", F.col("id").alias("id_a"))
    b = groups.select("group_id", F.col("id").alias("id_b"))
    return a.join(b, "group_id").where("id_a < id_b").select("id_a", "id_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(near_duplicate_groups(table(spark, sf_dir, "docs")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its group and the group's size."""
    g = near_duplicate_groups(table(spark, sf_dir, "docs"))
    return g.join(g.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")), "group_id").select("id", "group_id", "group_size")
