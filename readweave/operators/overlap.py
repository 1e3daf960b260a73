"""Exact suffix-prefix overlaps on all strands, and their transitive reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import edge_type
from ..functions.joins import growing


def candidates(oriented: DataFrame, read_len: int, min_overlap: int, heads_of: DataFrame | None = None) -> DataFrame:
    """n, ns, d, ds, k, ext: the suffix of length k of oriented n is the prefix of oriented d; ext is the rest of d.

    Seeds of n (its min_overlap-mers, but the one that all of n begins with) meet heads of d in an equi-join, which Spark
    may split where a seed is frequent; the rest of the overlap is a residual.  A read overlaps itself too.
    heads_of: other oriented reads to stand for d.
    """
    # A row carries its seed and what follows it, not the whole suffix: the seed is in the key already.
    last, after = read_len - min_overlap + 1, min_overlap + 1
    # Dealt first: a table of few files would be exploded by as few tasks.
    places = oriented.repartition("read_id").select(F.col("read_id").alias("n"), F.col("strand").alias("ns"), "seq", F.explode(F.sequence(F.lit(2), F.lit(last))).alias("s"))
    seeds = places.select("n", "ns", F.substr("seq", F.col("s"), F.lit(min_overlap)).alias("seed"), F.substr("seq", F.col("s") + min_overlap).alias("rest"))
    heads = (oriented if heads_of is None else heads_of).select(F.col("read_id").alias("d"), F.col("strand").alias("ds"), F.substring("seq", 1, min_overlap).alias("seed"), F.substr("seq", F.lit(after)).alias("tail"))
    joined = seeds.join(growing(heads), "seed").where(F.startswith("tail", "rest"))
    return joined.select("n", "ns", "d", "ds", (F.length("rest") + min_overlap).alias("k"), F.substr("tail", F.length("rest") + 1).alias("ext"))


def overlaps_of_type(cands: DataFrame, name: str) -> DataFrame:
    return cands.where(edge_type(F.col("ns"), F.col("ds")) == name).select("n", "d", "k")


def candidate_counts(cands: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, olp_b, olp_f: candidates of each side before reduction."""
    per = cands.groupBy(F.col("n").alias("read_id")).agg(F.sum(F.when(F.col("ns") == 1, 1).otherwise(0)).alias("olp_b"), F.sum(F.when(F.col("ns") == 0, 1).otherwise(0)).alias("olp_f"))
    return reads.select("read_id").join(growing(per), "read_id", "left").select("read_id", F.coalesce("olp_b", F.lit(0)).alias("olp_b"), F.coalesce("olp_f", F.lit(0)).alias("olp_f"))


def shortlist(cands: DataFrame) -> DataFrame:
    """n, ns, d, ds, k, ext, olp: candidates whose extension a longest overlap of their side does not properly begin, and how many candidates the side has.

    reduced() gives the same from these as from all: what such a one would prune, the longest overlap prunes as well.
    Most sides are left with one row, and no row has to be compared with all others of its side.
    """
    side = Window.partitionBy("n", "ns")
    least = F.first("ext").over(side.orderBy(F.desc("k")))
    # A frame of the same order; counting without one would sort again.
    olp = F.count(F.lit(1)).over(side.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = cands.select("n", "ns", "d", "ds", "k", "ext", least.alias("_least"), olp.alias("olp"))
    return known.where((F.length("ext") <= F.length("_least")) | ~F.startswith("ext", "_least")).drop("_least")


def shortlist_counts(short: DataFrame, reads: DataFrame) -> DataFrame:
    """candidate_counts() from a shortlist, which has a row of each side that has candidates."""
    of = lambda ns, name: F.coalesce(F.max(F.when(F.col("ns") == ns, F.col("olp"))), F.lit(0)).alias(name)
    per = short.groupBy(F.col("n").alias("read_id")).agg(of(1, "olp_b"), of(0, "olp_f"))
    return reads.select("read_id").join(growing(per), "read_id", "left").select("read_id", F.coalesce("olp_b", F.lit(0)).alias("olp_b"), F.coalesce("olp_f", F.lit(0)).alias("olp_f"))


def reduced(cands: DataFrame) -> DataFrame:
    """n, ns, d, ds, k: candidates whose extension no other of the same side's extensions properly begins.

    A self-overlap prunes but is no edge.  Where a read equals its own reverse complement the unturned strand stays.
    """
    c, o = cands.alias("c"), cands.alias("o")
    side = (F.col("c.n") == F.col("o.n")) & (F.col("c.ns") == F.col("o.ns"))
    longer = (F.col("o.k") > F.col("c.k")) & F.startswith("c.ext", "o.ext")
    twin = (F.col("o.d") == F.col("c.d")) & (F.col("o.k") == F.col("c.k")) & (F.col("c.ds") != F.col("c.ns")) & (F.col("o.ds") == F.col("c.ns"))
    kept = c.where("c.n <> c.d").join(growing(o), side & (longer | (twin & (F.col("o.ext") == F.col("c.ext")))), "left_anti")
    return kept.select("n", "ns", "d", "ds", "k")


def edge_support(edges: DataFrame, cands: DataFrame) -> DataFrame:
    """Edges with support: candidates of the side whose extension begins with the edge's."""
    own = edges.join(growing(cands), ["n", "ns", "d", "ds", "k"]).select("n", "ns", "d", "ds", "k", "ext")
    all_ = cands.select("n", "ns", F.col("ext").alias("other"))
    hits = own.join(growing(all_), ["n", "ns"]).where(F.startswith("other", "ext"))
    return hits.groupBy("n", "ns", "d", "ds", "k").agg(F.count(F.lit(1)).alias("support"))
