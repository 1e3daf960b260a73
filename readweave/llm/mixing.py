"""Mixing sources to target weights: fixed-length blocks, shards of slots, pseudorandom index permutations.

A source's documents lie end to end on a line of words, which is cut into blocks.  Its target says how many slots it
gets in the output; each output shard draws how many of them it holds, a multinomial count, and the shards' counts one
after the other number the source's slots.  Passes over the source follow each other, and in each pass a keyed
permutation of block indexes says which block a slot takes.  Blocks are joined by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, row_key, words_of, written

WEIGHTS = (5, 2, 1)
#: Distinct rows per chunk; chunks bound what one task sorts, however large a source is.
CHUNK = 4_000
#: Slots that one task makes at a time.
SLOT_RANGE = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3) -> DataFrame:
    """source, source_size -> also rank, target: shares of all sizes by weight, none above limit times its source.

    Sources are few against documents, so they are ordered in one task.  The sources that stop at their limit
    are those with the least limit / weight: the first source in this order that the rest's common share does
    not exceed ends them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "share"))).over(whole)["share"]
    leveled = ranked.withColumn("share", share).withColumn("level", level)
    return leveled.select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. n-1 (n up to 2**40): rounds of odd multiplication and xor-shift on the
    enclosing power of two, walked until the value falls below n."""
    bits = F.greatest(F.lit(1), F.ceil(F.log2(n.cast("double")))).cast("int")
    # log2 of large n may round down; one more bit only lengthens the walk.
    bits = F.when(F.pow(F.lit(2.0), bits) < n, bits + 1).otherwise(bits)
    mask = F.pow(F.lit(2.0), bits).cast("long") - 1
    rounds = F.array(*[F.struct((F.xxhash64(key, F.lit(r)).bitwiseAND(F.lit((1 << 22) - 1)) * 2 + 1).alias("a"), F.xxhash64(key, F.lit(100 + r)).bitwiseAND(mask).alias("c")) for r in range(4)])
    half = F.ceil(bits / 2).cast("int")

    def once(value: Column, given: Column) -> Column:
        def round_(y: Column, p: Column) -> Column:
            z = (y * p["a"] + p["c"]).bitwiseAND(given["mask"])
            return z.bitwiseXOR(F.call_function("shiftright", z, given["half"]))

        return F.aggregate(given["rounds"], value, round_)

    def walk(given: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x, given), lambda y, _: F.when(y < given["n"], y).otherwise(once(y, given)))

    given = F.struct(n.alias("n"), mask.alias("mask"), half.alias("half"), rounds.alias("rounds"))
    return F.transform(F.array(given), walk)[0]


def _laid_out(sized: DataFrame) -> DataFrame:
    """start: words of a row's source before it, in order of chunk, doc_id and text.  Equal rows are laid out as one and dealt out after."""
    same = written(sized.groupBy("source", "doc_id", "mark", "row", "size").agg(F.count(F.lit(1)).alias("times")))
    chunks = max(1, -(-same.count() // CHUNK))
    same = same.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark", "row"), F.lit(chunks)))
    own = Window.partitionBy("source", "chunk").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("times")
    sums = same.groupBy("source", "chunk").agg(F.sum(words).alias("chunk_size"))
    # One row for each chunk of a source is ordered in a task.
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("base"))
    inside = same.withColumn("inside", F.coalesce(F.sum(words).over(own), F.lit(0)))
    laid = inside.join(sums, inside.source.eqNullSafe(sums._s) & (inside.chunk == sums._c))
    each = laid.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.withColumn("start", F.col("base") + F.col("inside") + F.col("_nth") * F.col("size")).drop("_s", "_c", "base", "inside", "chunk", "times", "_nth")


def _dues(plan: DataFrame, block: int) -> DataFrame:
    """rank, source_size, n (blocks), passes, rest (words of the last, partial pass), n_slots."""
    n = F.ceil(F.col("source_size") / block)
    plan = plan.where("source_size > 0").select("rank", "source_size", n.cast("long").alias("n"), F.least(F.round("target").cast("long"), F.col("source_size") * 3).alias("due"))
    plan = plan.withColumn("passes", F.expr("due div source_size")).withColumn("rest", F.col("due") - F.col("passes") * F.col("source_size"))
    return plan.withColumn("n_slots", F.col("passes") * F.col("n") + F.ceil(F.col("rest") / block).cast("long")).where("n_slots > 0")


def shard_counts(plan: DataFrame, block: int, n_shards: int, seed: int) -> DataFrame:
    """rank, shard, n_held, first: the multinomial draw of a source's slots over the shards, and the number of the shard's first.

    Each of a source's slots is a draw among the shards; draws are counted where they are made, so a task sends one row
    for each source and shard at most.
    """
    ranges = _dues(plan, block).select("rank", "n_slots", F.explode(F.expr(f"sequence(0L, n_slots - 1, {SLOT_RANGE}L)")).alias("low"))
    width = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = ranges.repartition(width, "rank", "low").select("rank", F.explode(F.sequence("low", F.least(F.col("low") + SLOT_RANGE, F.col("n_slots")) - 1)).alias("draw"))
    counts = draws.groupBy("rank", F.pmod(F.xxhash64(F.lit(seed + 1), "rank", "draw"), F.lit(n_shards)).alias("shard")).agg(F.count(F.lit(1)).alias("n_held"))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n_held").over(earlier), F.lit(0)))


def slots(plan: DataFrame, block: int, n_shards: int, seed: int) -> DataFrame:
    """rank, shard, slot, pass_, index, take: what each slot of a shard takes (the first `take` words of block `index`)."""
    held = shard_counts(plan, block, n_shards, seed).join(_dues(plan, block), "rank")
    ranges = held.withColumn("low", F.explode(F.expr(f"sequence(first, first + n_held - 1, {SLOT_RANGE}L)")))
    width = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = ranges.repartition(width, "rank", "low").withColumn("slot", F.explode(F.sequence("low", F.least(F.col("low") + SLOT_RANGE, F.col("first") + F.col("n_held")) - 1)))
    each = each.withColumn("pass_", F.expr("slot div n")).withColumn("k", F.col("slot") - F.col("pass_") * F.col("n"))
    # The last block, which may be short, closes every pass, so a pass has taken k * block words before slot k.
    key = F.xxhash64(F.lit(seed), "rank", "pass_")
    index = F.when(F.col("k") == F.col("n") - 1, F.col("k")).otherwise(permuted(F.col("k"), F.greatest(F.col("n") - 1, F.lit(1)), key))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("index") * block)
    left = F.when(F.col("pass_") < F.col("passes"), F.lit(block).cast("long")).otherwise(F.col("rest") - F.col("k") * block)
    return each.withColumn("index", index).select("rank", "shard", "slot", "pass_", "index", F.least(length, left).alias("take"))


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """rank, index, doc_id, row, start, source_size, first, words, offset: the part of a row that lies in a block."""
    each = rows.where("size > 0").select("rank", "doc_id", "row", "start", "size", "source_size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("index"))
    low, high = F.greatest("start", F.col("index") * block), F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    return each.select("rank", "index", "doc_id", "row", "start", "source_size", (low - F.col("start")).alias("first"), (high - low).alias("words"), (low - F.col("index") * block).alias("offset"))


def mixture(docs: DataFrame, block: int = 512, n_shards: int = 64, seed: int = 17, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): a row's doc_id, mark, source, size, row, start, source_size, target; and by block, what is taken of it.

    pieces: rank, doc_id, row, start, first, words (of the row, in the block), offset (in the block), times, part:
    the block is taken whole `times` times and its first `part` words once more.  row: a key carried along by both.
    """
    rows, plan = _rows_and_plan(docs, row)
    takes = slots(plan, block, n_shards, seed).groupBy("rank", "index").agg(
        F.sum(F.when(F.col("take") == F.lit(block), 1).otherwise(0)).cast("long").alias("whole"), F.sort_array(F.collect_list(F.when(F.col("take") < block, F.col("take"))), asc=False).alias("shorter"), F.collect_set("shard").alias("shards")
    )
    each = _pieces(rows, block)
    joined = each.join(takes, ["rank", "index"])
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("index") * block)
    joined = joined.withColumn("times", F.col("whole") + F.size(F.filter("shorter", lambda t: t == length)))
    part = F.coalesce(F.array_max(F.filter("shorter", lambda t: t < length)), F.lit(0).cast("long"))
    return rows, joined.withColumn("part", part).drop("whole", "shorter", "source_size", "index")


def _rows_and_plan(docs: DataFrame, row: Column | None) -> tuple[DataFrame, DataFrame]:
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), (F.lit(0) if row is None else row).cast("long").alias("row"))
    sized = written(sized)
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    laid = _laid_out(sized)
    p = plan.withColumnRenamed("source", "_s")
    return written(laid.join(p, laid.source.eqNullSafe(p._s)).drop("_s")), plan


def packed(docs: DataFrame, block: int = 512, n_shards: int = 64, seed: int = 17) -> DataFrame:
    """The mixed corpus as blocks: shard, source, slot, index, n_words, text (the block's words, joined by single spaces).

    A shard holds as many slots of each source as it drew; a slot's block is built once for each index and joined by it.
    Blocks are of `block` words but the last of a source and the one that ends its last, partial pass.
    """
    key = row_key(docs)
    rows, plan = _rows_and_plan(docs, key)
    marked = docs.select(F.col("doc_id").cast("long").alias("_id"), key.alias("_row"), words_of(F.col("text").cast("string")).alias("_words")).dropDuplicates(["_id", "_row"])
    pieces = _pieces(rows, block)
    parts = pieces.join(marked, pieces.doc_id.eqNullSafe(marked._id) & (pieces.row == marked._row))
    parts = parts.select("rank", "index", "offset", F.slice("_words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")).alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda p: p["part"]))
    blocks = parts.groupBy("rank", "index").agg(whole.alias("_words"))
    joined = slots(plan, block, n_shards, seed).join(blocks, ["rank", "index"]).join(plan.select("rank", "source"), "rank")
    return joined.select("shard", "source", "slot", "index", F.col("take").alias("n_words"), F.array_join(F.slice("_words", F.lit(1), F.col("take").cast("int")), " ").alias("text"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted), n_shards (that hold some of it).

    Sizes are counts of words; a null text has none, a null source is a source, ordered last.  Sources weigh
    5, 2, 1, 5, ... in order of code points and share the sum of all sizes; no target exceeds 3 times its
    source.  taken adds up to the target of each source, rounded, and is at most 3 times a document's size.
    It depends on the rows only, not on their partitions; repeated rows are documents of their own.
    """
    rows, pieces = mixture(docs, **how)
    of_part = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("part") - F.col("offset")))
    held = F.size(F.array_distinct(F.flatten(F.collect_list("shards"))))
    taken = pieces.groupBy("rank", "start").agg(F.sum(F.col("times") * F.col("words") + of_part).alias("taken"), held.alias("n_shards"))
    some = rows.where("size > 0").join(taken, ["rank", "start"], "left")
    none = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "n_shards": F.lit(0)})
    names = ["doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards")]
    return some.select(*names).unionByName(none.select(*names))


def remix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus in the columns of docs: a row for each whole pass over a document, and one for what the last,
    partial pass takes of it (its words, joined by single spaces).  Documents that no slot takes are absent.

    `n_chars`, if a column, is counted anew for a partial row; only rows that are equal in all columns stand for each other.
    """
    rows, pieces = mixture(docs, row=row_key(docs), **how)
    of_part = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("part") - F.col("offset")))
    # Whole takes of a piece and of its block's prefix; a document's least whole count is a whole copy, the rest are pieces.
    spans = pieces.select("rank", "doc_id", "row", "start", "first", "words", "times", of_part.alias("more"))
    own = spans.groupBy("rank", "start", "doc_id", "row").agg(F.min(F.col("times") + F.when(F.col("more") == F.col("words"), 1).otherwise(0)).alias("_copies"), F.sum("words").alias("covered"), F.sort_array(F.collect_list(F.struct("first", "words", "times", "more"))).alias("_spans"))
    own = own.join(rows.where("size > 0").select("rank", "start", "size"), ["rank", "start"]).withColumn("_copies", F.when(F.col("covered") == F.col("size"), F.col("_copies")).otherwise(F.lit(0)))
    # The input's columns travel as one struct, so none of them meets a name used here.
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    own = own.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("id"), F.col("doc_id").isNull().alias("none"), "row", "_copies", "_spans")
    own = own.groupBy("id", "none", "row").agg(F.collect_list(F.struct("_copies", "_spans")).alias("takes"))
    both = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("id"), F.col("doc_id").isNull().alias("none"), row_key(docs).alias("row"), F.col("text").cast("string").alias("whole"), carried.alias("given"))
    both = both.dropDuplicates(["id", "none", "row"]).join(own, ["id", "none", "row"])
    both = both.select("whole", "given", F.explode("takes").alias("take")).select("whole", "given", F.col("take._copies").alias("copies"), F.col("take._spans").alias("spans"))
    # Pass c (from 0) takes the words of each span that it still covers: all if c < times, a prefix if c = times.
    last = F.array_max(F.transform("spans", lambda s: s["times"] + F.when(s["more"] > 0, 1).otherwise(0)))
    both = both.withColumn("last", last).where("last > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)))
    both = both.withColumn("words", F.when(F.col("pass") >= F.col("copies"), words_of(F.col("whole"))))
    part = lambda s: F.slice(F.col("words"), (s["first"] + 1).cast("int"), F.when(F.col("pass") < s["times"], s["words"]).when(F.col("pass") == s["times"], s["more"]).otherwise(0).cast("int"))
    out = both.withColumn("said", F.when(F.col("pass") < F.col("copies"), F.col("whole")).otherwise(F.array_join(F.flatten(F.transform("spans", part)), " "))).where("said <> ''")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("said").alias(c)
        if c == "n_chars":
            return F.when(F.col("pass") < F.col("copies"), F.col("given.n_chars")).otherwise(F.length("said")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"given.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])
