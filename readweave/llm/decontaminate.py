"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is a set of positioned shingles (runs of up to three words).  A document that holds a window holds
all its shingles, so for exact containment one is enough as prefix: the rarest, by counts over all documents.
Bounds on position and length follow from the shingle's place in its window; the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, written

_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
#: Bytes of the benchmark's side, as counted, up to which it is broadcast; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20


def folded_words(text: Column) -> Column:
    """Words over digits, a-z and characters beyond ASCII, after lower-casing A-Z only."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _CUT), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, by place; an empty array if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(n)])))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted bytes (of strings, and 16 for each row and column) are within the bound."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(16 * len(df.columns))
    for t in texts:
        size = size + t
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def item_windows(bench: DataFrame, window: int) -> DataFrame:
    """item_id, window_id, words (joined by spaces), length of each window of each item."""
    items = fixed(bench.select(F.col("item_id"), folded_words(F.col("text").cast("string")).alias("w"))).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    each = items.select("item_id", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, length), " "))).alias("words"))
    return each.withColumn("window_id", F.sha2("words", 256))


def _marks(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("mark"), F.xxhash64(F.lit("other"), text).alias("mark2")]


_TEXT = ["mark", "mark2"]


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurrences of item windows), items (their item_ids).

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.  Null
    and blank texts have no words, null item_ids count as no item; an empty benchmark hits nothing.  Repeated
    rows and equal ids are judged by their own text; equal texts are searched once.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    windows = written(item_windows(bench, window))
    hits = written(_hits(docs, windows, ["doc_id"]))
    # Items come in only here, once for each text and window that holds.
    held = hits.select(*_TEXT, F.explode("held").alias("window_id")).distinct()
    of = windows.where("item_id is not null").select("window_id", "item_id").distinct()
    items = held.join(of, "window_id").groupBy(*_TEXT).agg(F.collect_set("item_id").alias("items"))
    none = F.array().cast(f"array<{windows.schema['item_id'].dataType.simpleString()}>")
    return hits.join(items, _TEXT, "left").select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items"))


def _hits(docs: DataFrame, windows: DataFrame, carried: list[str]) -> DataFrame:
    """carried columns, mark, mark2, n_words, n_hit, held (window_ids) of each row of docs."""
    docs = docs.select(*carried, "text", *_marks(F.col("text")))
    windows = windows.select("window_id", "words", "length").distinct()
    no_window = F.array().cast("array<string>")

    # Shingles of all windows: their size is what the shortest window allows.
    shingles = windows.withColumn("w", F.split("words", " ")).withColumn("k", F.least(F.lit(SHINGLE), F.size("w")))
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())  # 1 to SHINGLE
    if not sizes:
        return docs.select(*carried, *_TEXT, F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), no_window.alias("held"))
    hashes = F.lit(None).cast("array<bigint>")
    for k in sizes:
        hashes = F.when(F.col("k") == k, _runs(F.col("w"), k)).otherwise(hashes)
    shingles = written(shingles.select("window_id", "length", "k", F.posexplode(hashes).alias("place", "shingle")))
    known = _small(shingles.select("k", "shingle").distinct())

    # All places of distinct texts where a benchmark shingle stands, and from these how rare each is.  Place -1 stands in
    # every text once and brings its number of words, so that words are split in this pass only.
    seen = None
    for k in sizes:
        runs = fixed(docs.select(*_TEXT, folded_words(F.col("text")).alias("w"))).select(*_TEXT, F.size("w").alias("n"), _runs(F.col("w"), k).alias("runs"))
        if k == sizes[0]:
            runs = runs.withColumn("runs", F.concat(F.array("mark"), F.coalesce("runs", F.array().cast("array<bigint>"))))
            each = runs.select(*_TEXT, "n", F.lit(k).alias("k"), F.posexplode("runs").alias("at", "shingle")).withColumn("at", F.col("at") - 1)
            each = each.join(known.where(F.col("k") == k).select("shingle", F.lit(True).alias("known")), "shingle", "left").where("known or at = -1")
        else:
            each = runs.select(*_TEXT, "n", F.lit(k).alias("k"), F.posexplode("runs").alias("at", "shingle"))
            each = each.join(known.where(F.col("k") == k).select("shingle"), "shingle", "left_semi")
        each = each.select(*_TEXT, "n", "k", "at", "shingle")
        seen = each if seen is None else seen.unionByName(each)
    seen = written(seen.distinct())
    every, seen = seen.where("at = -1"), seen.where("at >= 0")
    counts = seen.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("many"))
    # Rarest shingle of each window; a window with one that no document has needs no search.
    ranked = shingles.join(counts, ["k", "shingle"], "left").groupBy("window_id", "length", "k")
    prefix = ranked.agg(F.min(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "place", "shingle")).alias("p")).where("p.many > 0")
    prefix = prefix.select("window_id", "length", "k", F.col("p.place").alias("place"), F.col("p.shingle").alias("shingle"))
    prefix = _small(written(prefix.join(windows.select("window_id", "words"), "window_id")))
    found = seen.join(prefix, ["k", "shingle"]).withColumn("start", F.col("at") - F.col("place")).where("start >= 0 and start + length <= n")
    # Written, so that the join with it stands alone and Spark may split the rows of a text with many copies.
    found = found.select(*_TEXT, F.lit(None).cast("int").alias("n"), F.struct("start", "length", "words", "window_id").alias("f"))
    found = found.unionByName(every.select(*_TEXT, "n"), allowMissingColumns=True).groupBy(*_TEXT).agg(F.max("n").cast("long").alias("n_words"), F.collect_list("f").alias("found"))
    found = written(found.withColumn("found", F.when(F.size("found") > 0, F.col("found"))))

    both = docs.join(found, _TEXT, "left")
    both = fixed(both.select(*carried, *_TEXT, "n_words", "found", F.when(F.col("found").isNotNull(), folded_words(F.col("text"))).alias("w")))
    true = F.filter("found", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["length"]), " ") == c["words"])
    both = fixed(both.select(*carried, *_TEXT, "n_words", F.when(F.col("found").isNotNull(), true).alias("found")))
    hit = F.size(F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))))
    held = F.array_distinct(F.transform("found", lambda c: c["window_id"]))
    return fixed(both.select(*carried, *_TEXT, "n_words", F.when(F.col("found").isNull(), 0).otherwise(hit).cast("long").alias("n_hit"), F.coalesce(held, no_window).alias("held")))


def uncontaminated(docs: DataFrame, bench: DataFrame, window: int = 10, most: float = 0.0) -> DataFrame:
    """docs without those of whose words more than the share `most` stands inside item windows.

    Each row goes or stays by its own text, whatever other rows of its doc_id, or without one, hold.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    judged = written(_hits(texts, written(item_windows(bench, window)), []).where(F.col("n_hit") > F.col("n_words") * F.lit(most)).select(*_TEXT).distinct())
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_marks(F.col("text")))
    return carried.join(judged, _TEXT, "left_anti").select("row.*")
