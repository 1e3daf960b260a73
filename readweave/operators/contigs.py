"""Branch split and contig spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import canonical
from ..functions.joins import growing
from ..functions.storage import written
from .graph import max_overlap
from .paths import doubled


def branch_split(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """read_id, b_end, f_end: ONE, TENDING (output may end here) or HALF (a branch faces it).

    Decided on one snapshot: a branching side is HALF if a side that faces it branches too, else TENDING; an
    unbranched side is HALF if it faces a branch; a side without edges is TENDING.
    """
    kinds = nodes.select(F.col("read_id").alias("n"), F.lit(1).alias("ns"), F.col("b_type").alias("t")).union(nodes.select("read_id", F.lit(0), "f_type"))
    facing = kinds.where("t = 'BRANCH'").select(F.col("n").alias("d"), (1 - F.col("ns")).alias("ds"))
    faces = edges.join(growing(facing), ["d", "ds"], "left_semi").select("n", "ns").distinct().withColumn("half", F.lit(True))
    ends = kinds.join(growing(faces), ["n", "ns"], "left").withColumn("half", F.coalesce("half", F.lit(False)))
    ends = ends.withColumn("e", F.when(F.col("t") == "ENDING", "TENDING").when(F.col("half"), "HALF").when(F.col("t") == "BRANCH", "TENDING").otherwise("ONE"))
    return ends.groupBy(F.col("n").alias("read_id")).agg(F.max(F.when(F.col("ns") == 1, F.col("e"))).alias("b_end"), F.max(F.when(F.col("ns") == 0, F.col("e"))).alias("f_end"))


def placed_reads(nodes: DataFrame, edges: DataFrame, reads: DataFrame, read_len: int, offsets: DataFrame | None = None) -> DataFrame:
    """start, start_s, read_id, strand, place, piece: the reads of every maximal unbranched chain, seen from each of its ends; rings have none.

    A read gives what lies between its two ends: past an offset at a dead end, whole at an entry, without the overlap at an
    exit.
    """
    spark = nodes.sparkSession
    live = nodes.where("deg_b + deg_f > 0")
    ends = branch_split(live, edges)
    side = ends.select(F.col("read_id").alias("n"), F.lit(1).alias("ns"), F.col("b_end").alias("e")).union(ends.select("read_id", F.lit(0), "f_end"))
    offsets = spark.createDataFrame([], "read_id long, side int, offset long") if offsets is None else offsets
    side = side.join(growing(max_overlap(edges)), ["n", "ns"], "left").join(growing(offsets.select(F.col("read_id").alias("n"), F.col("side").alias("ns"), "offset")), ["n", "ns"], "left")
    # What a read loses at a side when output leaves it there, and when it enters.
    leave = F.when(F.col("e") == "TENDING", F.coalesce("offset", F.lit(0))).otherwise(F.col("max_k"))
    enter = F.when(F.col("e") == "ONE", F.lit(0)).otherwise(leave)
    side = side.select("n", "ns", "e", leave.cast("int").alias("leave"), enter.cast("int").alias("enter"))
    one = side.where("e = 'ONE'").select("n", "ns")
    steps = edges.join(growing(one), ["n", "ns"], "left_semi").join(growing(one.select(F.col("n").alias("d"), (1 - F.col("ns")).alias("ds"))), ["d", "ds"], "left_semi")
    walks = doubled(steps.select(F.col("n").alias("x"), F.col("ns").alias("xs"), F.col("d").alias("y"), F.col("ds").alias("ys"), F.lit(1).alias("bp")))
    # An oriented read's walk backwards is its mirror's walk: it names the start of the chain and the place in it.
    back = walks.select(F.col("x").alias("read_id"), (1 - F.col("xs")).alias("strand"), F.col("y").alias("start"), (1 - F.col("ys")).alias("start_s"), F.col("steps").alias("place"))
    starts = side.where("e <> 'ONE'").select(F.col("n").alias("start"), (1 - F.col("ns")).alias("start_s"))
    heads = starts.select(F.col("start").alias("read_id"), F.col("start_s").alias("strand"), "start", "start_s", F.lit(0).cast("long").alias("place"))
    placed = back.join(growing(starts), ["start", "start_s"], "left_semi").select("read_id", "strand", "start", "start_s", "place").union(heads.select("read_id", "strand", "start", "start_s", "place"))
    into = side.select(F.col("n").alias("read_id"), (1 - F.col("ns")).alias("strand"), "enter")
    out = side.select(F.col("n").alias("read_id"), F.col("ns").alias("strand"), "leave")
    placed = placed.join(growing(into), ["read_id", "strand"]).join(growing(out), ["read_id", "strand"]).join(growing(reads.select("read_id", "seq")), "read_id")
    seq = F.when(F.col("strand") == 0, F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    piece = F.substr(seq, F.col("enter") + 1, F.greatest(F.lit(0), F.lit(read_len) - F.col("leave") - F.col("enter")))
    return written(placed.select("start", "start_s", "read_id", "strand", "place", piece.alias("piece")))


#: Reads by whose ids contigs are numbered together.
_CHUNK = 1_000_000


def numbered(placed: DataFrame, read_len: int, min_len: int = 0) -> DataFrame:
    """contig_id, seq, length, start, start_s of every chain, in order of its start read; only contigs over read_len and of min_len at least."""
    last = F.max(F.struct("place", "read_id", "strand"))
    chains = placed.groupBy("start", "start_s").agg(last.alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("seq"))
    # Each chain is walked from both of its ends: the walk from the lesser read stays, from strand 0 if one read is both.
    chains = chains.where((F.col("start") < F.col("last.read_id")) | ((F.col("start") == F.col("last.read_id")) & (F.col("start_s") <= 1 - F.col("last.strand"))))
    chains = written(chains.withColumn("length", F.length("seq").cast("long")).where((F.col("length") > read_len) & (F.col("length") >= min_len)).drop("last"))
    # Starts are numbered without their sequences, by chunks of read ids that are offset by the sizes of earlier ones.
    starts = chains.select("start", "start_s").withColumn("chunk", F.expr(f"start div {_CHUNK}"))
    before = starts.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("chunk", F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("chunk").orderBy("start", "start_s")) - 1
    ids = starts.withColumn("own", own).join(before, "chunk").select("start", "start_s", (F.col("own") + F.col("before")).cast("long").alias("contig_id"))
    return chains.join(growing(ids), ["start", "start_s"]).select("contig_id", "seq", "length", "start", "start_s")


def members_of(contigs: DataFrame, placed: DataFrame) -> DataFrame:
    """contig_id, place, read_id, strand: the reads of each contig in order."""
    return contigs.select("contig_id", "start", "start_s").join(growing(placed), ["start", "start_s"]).select("contig_id", "place", "read_id", "strand")


def spell(nodes: DataFrame, edges: DataFrame, reads: DataFrame, read_len: int, offsets: DataFrame | None = None, min_len: int = 0) -> DataFrame:
    """contig_id, seq, length of the graph's chains."""
    return numbered(placed_reads(nodes, edges, reads, read_len, offsets), read_len, min_len).select("contig_id", "seq", "length")


def contig_reads(nodes: DataFrame, edges: DataFrame, reads: DataFrame, read_len: int) -> DataFrame:
    placed = placed_reads(nodes, edges, reads, read_len)
    return members_of(numbered(placed, read_len), placed)


def canonical_set(contigs: DataFrame) -> DataFrame:
    return contigs.select(canonical(F.col("seq")).alias("seq"), "length")


def contig_stats(contigs: DataFrame) -> DataFrame:
    return contigs.agg(F.count(F.lit(1)).alias("n_contigs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"))
