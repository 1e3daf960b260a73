"""What the operators share: input columns, scratch tables, native word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, shared_dir, written  # noqa: F401

#: Words are maximal runs of characters other than space and 0x09-0x0D.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame) -> Column:
    """A hash of a row's columns and of which of them are null; maps, which have no hash, do not count."""
    names = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*names, *[c.isNull() for c in names])


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fixed(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which Catalyst neither pushes a filter nor inlines a column.

    Without it a filter on a derived column is rewritten over its sources, and a column that a lambda reads
    is then computed anew for each element.
    """
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_row")).select("_row.*")


def _stars(pairs: DataFrame) -> bool:
    """Whether the distinct pairs (u, v), v below u, are stars: no u has two v or is the v of another."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node that pairs (a, b) connect with node.

    Alternating large-star and small-star rounds, each a pair of aggregations on node keys, until the
    pairs are stars, which a further round would leave as they are; every round is a written table, and the one before it is deleted.
    Nothing is gathered by the driver but whether a node is left that is not settled.
    """
    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(pairs):
        # The least neighbours are written, so that the joins with them stand alone and Spark may split a hub's rows.
        both = pairs.union(pairs.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small_min = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_min, "u")
        spent, pairs = pairs, written(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct())
        discard(spent, least, large, small_min)
    rooted = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.union(rooted.select("root", "root").distinct())
