"""Exact pattern count and location over all reads, k-mer counts, suffix order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import growing

#: Symbols of patterns of one length that are sent to each task; more are joined as sorted tables.
_FEW = 1_000_000


def locate(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, read_id, pos (0-based), overlaps included: a join on equal k-mers for each pattern length.

    A read's k-mers are not dealt out where the patterns are few, and never held by the driver.
    """
    out = None
    for row in patterns.groupBy(F.length("pattern").alias("n")).agg(F.count("pattern").alias("rows")).where("n is not null").collect():  # distinct lengths, at most a read's
        own = patterns.where(F.length("pattern") == row.n).select("pattern")
        grams = reads.where(F.length("seq") >= row.n).select("read_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seq") - (row.n - 1)), lambda i: F.substr("seq", i, F.lit(row.n)))).alias("pos", "pattern"))  # noqa: B023
        found = grams.join(F.broadcast(own) if row.rows * row.n <= _FEW else growing(own), "pattern").select("pattern", "read_id", "pos")
        out = found if out is None else out.union(found)
    return reads.select(F.lit("").alias("pattern"), "read_id", F.lit(0).alias("pos")).limit(0) if out is None else out


def count(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    found = locate(reads, patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return patterns.select("pattern").join(growing(found), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n"))


def kmer_count(reads: DataFrame, k: int) -> DataFrame:
    grams = reads.where(F.length("seq") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substr("seq", i, F.lit(k)))).alias("kmer"))
    return grams.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def suffix_rank(reads: DataFrame, most: int = 200_000) -> DataFrame:
    """read_id, pos, rank of each suffix by (suffix, read_id, pos).

    Suffixes are ordered within groups of equal first symbols, and group sizes shift the ranks, so the order needs no single
    task.  As many symbols make a group as hold it to about `most` suffixes where symbols are even.
    """
    all_ = reads.select("read_id", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos"), "seq").select("read_id", "pos", F.substr("seq", F.col("pos") + 1).alias("suffix"))
    n = reads.agg(F.sum(F.length("seq"))).first()[0] or 0
    prefix = max(4, math.ceil(math.log(max(1, n / most), 4)))
    all_ = all_.withColumn("head", F.substring("suffix", 1, prefix))
    sizes = all_.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("head", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("head").orderBy("suffix", "read_id", "pos")) - 1
    return all_.withColumn("own", own).join(before, "head").select("read_id", "pos", (F.col("own") + F.col("before")).alias("rank"))


def bwt(reads: DataFrame) -> DataFrame:
    """read_id, pos, rank, symbol: the base before each suffix in order of suffixes; $ before a whole read."""
    ranked = suffix_rank(reads).join(growing(reads.select("read_id", "seq")), "read_id")
    return ranked.select("read_id", "pos", "rank", F.when(F.col("pos") == 0, "$").otherwise(F.substr("seq", F.col("pos"), F.lit(1))).alias("symbol"))


def occ(transformed: DataFrame, step: int = 4096) -> DataFrame:
    """block, base, n_before: how often a base stands in the transform before rank block * step."""
    counts = transformed.groupBy(F.expr(f"rank div {step}").alias("block")).agg(*[F.count_if(F.col("symbol") == b).alias(b) for b in "ACGT"])
    each = counts.select("block", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGT"])).alias("c")).select("block", "c.base", "c.n")
    earlier = Window.partitionBy("base").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("block", "base", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
