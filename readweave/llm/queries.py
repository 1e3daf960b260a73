"""The ten operators as queries over whole tables, in the columns of their contracts, and SQL for them where it serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, importance, mixing, ngram_join, page_text, quality_rules, secret_scan, substring_dedup, token_store
from .common import table
from .oracles import ORACLES  # noqa: F401


def tokenizer_path(spark: SparkSession) -> str:
    """spark.readweave.tokenizer, or the installed vocabulary; a file that every executor has at this path."""
    found = spark.conf.get("spark.readweave.tokenizer", None)
    if found:
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(spark))
    return token_store.read_digests(images)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chat(turns.unionByName(extra))
    loss = chat_format.under_mask(F.col("formatted"), F.col("loss_spans"))
    turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss", loss)
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turn, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "linked"), lambda a, b: _by_place(a, b))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.spelled(F.col("base")), 256).alias("base_sha256"), secret_scan.spelled(every).alias("spans"))


def _by_place(a, b):
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in secret_scan._RANK]), s["kind"]).cast("int")
    sign = lambda x: F.signum(x).cast("int")
    return F.when(a["start"] != b["start"], sign(a["start"] - b["start"])).when(a["kind"] != b["kind"], sign(rank(a) - rank(b))).otherwise(sign(a["end"] - b["end"]))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_chat_format, op3_secret_scan, op4_ngram_join, op5_decontaminate, op6_substring_dedup, op7_quality_rules, op8_mixing, op9_importance, op10_page_text)}
