"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, fixed, words_of


class Rule(NamedTuple):
    """A document passes if least <= numerator / denominator <= most; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with are be this by from "
    "der die und das den von zu ist mit für ein auf nicht sich "
    "le la les de des et un une que qui dans est pour sur par "
    "el los las en del por con una se al"
).split()

RULES = (
    Rule("few_words", "n_words", None, 20, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.30),
    Rule("short_words", "word_chars", "n_words", 3.0, None),
    Rule("long_words", "word_chars", "n_words", None, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.40),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None),
)
BASE_RULES = ("few_words", "repeated_words")


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more; hashes of windows stand for them."""
    h = F.col("_windows")
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    with_pairs = lambda p: F.filter(p, lambda s, k: F.coalesce(s["h"] == F.get(p, k - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(p, k + 1)["h"], F.lit(False)))
    # transform over a one-element array names a value once and evaluates it once.
    starts = F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(with_pairs(p), lambda s: s["i"])))[0]
    covered = F.transform(
        F.array(starts),
        lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x),
    )[0]
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)


def metrics(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id and the counts that rules are made of, all as long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id"), text.alias("_text"), words_of(text).alias("_words"))
    at = F.sequence(F.lit(1), F.size("_words") - (window - 1))
    hashes = F.when(F.size("_words") < window, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.slice("_words", i, window))))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, WHITE, "") != "")
    docs = docs.select("doc_id", "_text", "_words", hashes.alias("_windows"), lines.alias("_lines"))
    stops = [w + end for w in STOP_WORDS for end in ("", ",", ".")]
    counts = docs.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", WHITE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words"), window).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
    )
    return fixed(counts)


def passes(rule: Rule) -> Column:
    """The rule as a comparison of counts: no division, so no rounding at a threshold such as 30 of 100."""
    over = F.lit(100) if rule.denominator is None else F.col(rule.denominator) * 100
    value = F.col(rule.numerator) * 100
    # Thresholds in hundredths times the denominator, with counts as whole numbers.
    checks = []
    if rule.least is not None:
        checks.append(value * 100 >= over * round(rule.least * 100))
    if rule.most is not None:
        checks.append(value * 100 <= over * round(rule.most * 100))
    ok = checks[0] if len(checks) == 1 else checks[0] & checks[1]
    return ok if rule.denominator is None else ok | (F.col(rule.denominator) == 0)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts, base_failed, kept, and `failed`, the names of the rules that a document breaks.

    base_failed: fewer than 20 words, or over 30% of the words inside repeated 8-word windows.  kept: no rule
    is broken.  Null and blank texts have no words and are rejected.  Rows are judged alone, so repeated
    rows, null ids and further columns change nothing; thresholds themselves pass.
    """
    found = metrics(docs)
    ok = {r.name: passes(r) for r in rules}
    base = [passes(r) for r in RULES if r.name in BASE_RULES]
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in ok.items()]))
    return found.select("*", (~(base[0] & base[1])).alias("base_failed"), (every & base[0] & base[1]).alias("kept"), failed.alias("failed"))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs that pass all rules, with their own columns; a filter, without a join or shuffle."""
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = quality_rules(docs.select(carried.alias("doc_id"), F.col("text")))
    return judged.where("kept").select("doc_id.*")
