"""Reads: N filter, first-wins dedup modulo reverse complement, dense ids, base counts, orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import has_n, rc
from ..functions.joins import growing
from ..functions.storage import written

_BASES = ("A", "C", "G", "T")


def drop_n(raw: DataFrame) -> DataFrame:
    return raw.where(~has_n(F.col("seq")))


def dedup_exact(raw: DataFrame) -> DataFrame:
    """The first record of each sequence modulo reverse complement, which raw may hold as `turned`; partial aggregation keeps one row per task and key.

    A key and its reverse complement are the only forms, so numbers are kept for each and no sequence: Spark hashes
    these aggregates, and would sort all rows for ones that hold a sequence.
    """
    turned = F.col("turned") if "turned" in raw.columns else rc(F.col("seq"))
    keyed = raw.select("file_ord", "seq", turned.alias("_rc")).select("file_ord", F.least("seq", "_rc").alias("_key"), (F.col("seq") <= F.col("_rc")).alias("_own"))
    first = keyed.groupBy("_key").agg(F.min(F.when(F.col("_own"), F.col("file_ord"))).alias("_a"), F.min(F.when(~F.col("_own"), F.col("file_ord"))).alias("_b"))
    own = F.col("_b").isNull() | (F.col("_a") <= F.col("_b"))
    return first.select(F.least("_a", "_b").alias("file_ord"), F.when(own, F.col("_key")).otherwise(rc(F.col("_key"))).alias("seq"))


_WORD = (1 << 32) - 1


def _shift_xor(h, c):
    return h.bitwiseXOR((F.shiftleft(h, 5) + F.shiftright(h, 2) + c).bitwiseAND(F.lit(_WORD)))


#: The filter's hashes, each a fold of symbol codes 1 to 4 into 32 bits: fixed values.
BLOOM_FOLDS = (
    _shift_xor,
    lambda h, c: (c + F.shiftleft(h, 6) + F.shiftleft(h, 16) - h).bitwiseAND(F.lit(_WORD)),
    lambda h, c: (h + c).bitwiseAND(F.lit(_WORD)),
    lambda h, c: h.bitwiseXOR(c),
    lambda h, c: (h * 33 + c).bitwiseAND(F.lit(_WORD)),
)


def bloom_positions(seq, bits, n_hashes: int):
    """Bit places of a sequence in a filter of `bits` bits: its first n_hashes folds, modulo bits."""
    codes = F.transform(F.split(seq, ""), lambda b: F.instr(F.lit("ACGT"), b).cast("long"))
    folded = F.transform(F.array(codes), lambda c: F.array(*[F.aggregate(c, F.lit(0).cast("long"), f) for f in BLOOM_FOLDS[:n_hashes]]))[0]
    return F.transform(folded, lambda h: F.pmod(h, bits))


def dedup_bloom(raw: DataFrame, bits_per_read: int = 36, n_hashes: int = 2) -> DataFrame:
    """Dedup by a filter of bits_per_read bits a record, filled in file order: a read goes if all bits of it, or of its
    reverse complement, were set by kept reads before it; a kept read sets the bits of its stored form.

    Exact repeats go first, as their bits are always set.  Whether another read goes hangs on earlier ones only, so the
    reads that seem to go are judged again by the setters that are left until nothing changes; a bit's first setter is
    an aggregate, and no filter is built by one task.
    """
    exact = dedup_exact(raw)
    m = F.lit(max(1, raw.count() * bits_per_read)).cast("long")
    probes = exact.select("file_ord", F.explode(F.array(F.struct(F.lit(0).alias("strand"), bloom_positions(F.col("seq"), m, n_hashes).alias("b")), F.struct(F.lit(1).alias("strand"), bloom_positions(rc(F.col("seq")), m, n_hashes).alias("b")))).alias("p"))
    probes = written(probes.select("file_ord", "p.strand", F.explode("p.b").alias("bit")))
    gone, before = None, None
    while True:
        own = probes.where("strand = 0")
        setters = (own if gone is None else own.join(growing(gone), "file_ord", "left_anti")).groupBy("bit").agg(F.min("file_ord").alias("setter"))
        hit = probes.join(growing(setters), "bit", "left").groupBy("file_ord", "strand").agg(F.min(F.coalesce(F.col("setter") < F.col("file_ord"), F.lit(False))).alias("hit"))
        gone = written(hit.where("hit").select("file_ord").distinct())
        now = gone.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_ord").cast("decimal(38,0)"))).first()
        if now == before:
            return exact.join(growing(gone), "file_ord", "left_anti")
        before = now


def assign_ids(kept: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """read_id: dense, in order of file_ord; chunks of file order are numbered apart and offset by their sizes."""
    # Written, as it is read twice: for the sizes and for the numbers.
    kept = written(kept).withColumn("_c", F.expr(f"file_ord div {chunk}"))
    sizes = kept.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_c").orderBy("file_ord", "seq")) - 1
    return kept.withColumn("_o", own).join(before, "_c").select((F.col("_o") + F.col("_b")).alias("read_id"), "file_ord", "seq")


def import_metrics(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """n_raw, n_with_n, n_duplicate, n_kept."""
    a = raw.agg(F.count(F.lit(1)).alias("n_raw"), F.coalesce(F.sum(has_n(F.col("seq")).cast("long")), F.lit(0)).alias("n_with_n"))
    b = kept.agg(F.count(F.lit(1)).alias("n_kept"))
    return a.crossJoin(b).select("n_raw", "n_with_n", (F.col("n_raw") - F.col("n_with_n") - F.col("n_kept")).alias("n_duplicate"), "n_kept")


def base_histogram(reads: DataFrame) -> DataFrame:
    """base, n: one row per base, from sums within rows (no row per symbol)."""
    counts = [F.coalesce(F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))), F.lit(0)).cast("long").alias(b) for b in _BASES]
    one = reads.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in _BASES])).alias("r")).select("r.base", "r.n")


def cumulative_counts(reads: DataFrame) -> DataFrame:
    """base, n_before: symbols of lesser bases."""
    w = Window.orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    return base_histogram(reads).select("base", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"))


def first_last_base(reads: DataFrame) -> DataFrame:
    ends = reads.select(F.explode(F.array(F.struct(F.lit("first").alias("side"), F.substring("seq", 1, 1).alias("base")), F.struct(F.lit("last").alias("side"), F.substring("seq", -1, 1).alias("base")))).alias("e"))
    return ends.groupBy("e.side", "e.base").agg(F.count(F.lit(1)).alias("n"))


def oriented(reads: DataFrame) -> DataFrame:
    """read_id, strand (0 as stored, 1 reverse complement), seq."""
    both = F.array(F.struct(F.lit(0).alias("strand"), F.col("seq")), F.struct(F.lit(1).alias("strand"), rc(F.col("seq")).alias("seq")))
    return reads.select("read_id", F.explode(both).alias("o")).select("read_id", "o.strand", "o.seq")
