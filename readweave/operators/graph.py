"""Bidirected graph: degrees, side types, imbalance, junctions, mirror check.

Side F of a read is the out-edges of strand 0, side B those of strand 1; edge (n, ns, d, ds, k) has the mirror (d, 1-ds, n, 1-ns, k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import growing

KEYS = ["n", "ns", "d", "ds", "k"]


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("d").alias("n"), (1 - F.col("ds")).alias("ns"), F.col("n").alias("d"), (1 - F.col("ns")).alias("ds"), "k")


def missing_mirror(edges: DataFrame) -> DataFrame:
    return edges.select(*KEYS).join(growing(mirrored(edges)), KEYS, "left_anti")


def side_type(degree: Column) -> Column:
    return F.when(degree == 0, "ENDING").when(degree == 1, "ONE").otherwise("BRANCH")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("n").alias("read_id")).agg(F.sum(F.when(F.col("ns") == 1, 1).otherwise(0)).alias("deg_b"), F.sum(F.when(F.col("ns") == 0, 1).otherwise(0)).alias("deg_f"))


def imbalance(olp_b: Column, olp_f: Column) -> Column:
    """Candidate counts of the two sides differ by over 0.6 of the larger."""
    most = F.greatest(olp_b, olp_f)
    return F.when(most == 0, F.lit(False)).otherwise(F.abs(olp_b - olp_f) * 10 > most * 6)


def nodes(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """read_id, deg_b, deg_f, b_type, f_type, suspect of every read."""
    both = counts.join(growing(degrees(edges)), "read_id", "left").withColumn("deg_b", F.coalesce("deg_b", F.lit(0))).withColumn("deg_f", F.coalesce("deg_f", F.lit(0)))
    return both.select("read_id", "deg_b", "deg_f", side_type(F.col("deg_b")).alias("b_type"), side_type(F.col("deg_f")).alias("f_type"), imbalance(F.col("olp_b"), F.col("olp_f")).alias("suspect"))


def is_junction(b: str = "b_type", f: str = "f_type") -> Column:
    return ((F.col(b) == "BRANCH") & (F.col(f) != "ENDING")) | ((F.col(f) == "BRANCH") & (F.col(b) != "ENDING"))


def is_isolated() -> Column:
    return (F.col("deg_b") == 0) & (F.col("deg_f") == 0)


def max_overlap(edges: DataFrame) -> DataFrame:
    return edges.groupBy("n", "ns").agg(F.max("k").alias("max_k"))


def average_overlap(edges: DataFrame) -> DataFrame:
    return edges.agg(F.avg("k").alias("average_overlap"))
