"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models are counted: of all texts (raw) and of texts labelled good (target; a bounded sample of labels).  A text's
log importance weight is the sum over its words and word pairs of log target - log raw.  Adding Gumbel
noise to the log weights and taking the k largest draws k texts without replacement in proportion to weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import U64, Words, mix, slices, tidied

#: Hash buckets of the models; a model is 8 bytes each, whatever the corpus.
BUCKETS = 1 << 18
#: Raw occurrences that a bucket is credited with in both models: rare n-grams then say little.
PRIOR = 50.0
#: Good labels that the target model is counted from, those of least hash; their ids are broadcast, 8 bytes each.
MOST_LABELS = 100_000
_CHUNK = 1 << 12


def _grams(texts: pa.Array, buckets: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(texts)
    at, pairs = words.windows(2)
    return words, np.concatenate([words.doc, words.doc[at]]), (np.concatenate([words.hash, pairs]) % U64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for at, to in slices(batch.column(0)):
                part = batch.slice(at, to - at)
                _, doc, gram = _grams(part.column(0), buckets)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                total[0] += np.bincount(gram, minlength=buckets)
                total[1] += np.bincount(gram[good[doc]], minlength=buckets)
        if total.any():
            parts = range(0, buckets, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([total[:, k : k + _CHUNK].tobytes() for k in parts], pa.binary())], names=["chunk", "counts"])

    return run


def _sum(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one = np.frombuffer(counts, np.int64)
            total[chunk] = total[chunk] + one if chunk in total else one
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])


def judged(labels: DataFrame) -> DataFrame:
    """_id, good of each labelled doc_id: whether all its labels have quality 1 and toxic 0; a null mark is none."""
    each = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return each.where("_id is not null").select("_id", F.expr("q = 1 and x = 0").alias("good"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, most_labels: int = MOST_LABELS) -> np.ndarray:
    """Log target - log raw of each bucket: raw counts of all documents, target counts of the good ones.

    Good: every label of the doc_id has quality 1 and toxic 0; of more than `most_labels` good ids those of least hash are
    taken.  Texts are read where they lie; only the model, `buckets` numbers, reaches the driver.
    """
    good = judged(labels).where("good").select("_id")
    good = F.broadcast(good.orderBy(F.xxhash64("_id"), "_id").limit(most_labels))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = docs.join(good, docs.doc_id == good._id, "left").select("text", F.col("_id").isNotNull().alias("good"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = marked.mapInArrow(tidied(_count(buckets)), "chunk long, counts binary").repartition(n, "chunk").mapInArrow(_sum, "chunk long, counts binary").collect()
    total = np.zeros((2, buckets))
    for r in rows:
        own = np.frombuffer(r.counts, np.int64).reshape(2, -1)
        total[:, r.chunk : r.chunk + own.shape[1]] += own
    share = total[1].sum() / max(1.0, total[0].sum())
    if not share:
        return np.zeros(buckets)  # without examples all texts weigh the same
    return np.log(total[1] + prior * share) - np.log(total[0] + prior) - np.log(share)


def _score(model, buckets: int, seed: int):
    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                words, doc, gram = _grams(part.column(1), buckets)
                weight = np.bincount(doc, weights=model.value[gram], minlength=len(part))
                ids = part.column(0).fill_null(-1).to_numpy().astype(np.int64).view(U64)
                # One uniform number for each doc_id and text.
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(words.hash, dtype=U64)])
                own = mix(mix(ids + U64(seed)) ^ (sums[words.first[1:]] - sums[words.first[:-1]]))
                u = ((own >> U64(11)).astype(float) + 0.5) / float(1 << 53)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.count, pa.int64()), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], names=["doc_id", "n_words", "log_weight", "perturbed"])

    return run


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The kth largest value, by narrowing histograms; at most `bins` rows come to the driver at a time."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    above = 0
    while low < high:
        bin_ = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
        rows = values.where(F.col(column).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high = r.least, r.most
                break
            above += r.n
        else:
            return low
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, prior: float = PRIOR, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, n_words, log_weight, perturbed (with Gumbel noise), kept (among the k largest).

    k is `share` of the rows with words, rounded; by default the share of good ones, as `fit` takes them, among labelled
    doc_ids.  Rows that tie with the kth are kept too, so repeated rows share their fate.  Null and blank texts weigh nothing and are
    never kept; without labels every text is kept.  The noise hangs on doc_id, text and seed only.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(docs, labels, buckets, prior))
    scored = written(docs.mapInArrow(tidied(_score(model, buckets, seed)), "doc_id long, n_words long, log_weight double, perturbed double"))
    if share is None:
        share = judged(labels).agg(F.avg(F.col("good").cast("int"))).first()[0]
        share = 1.0 if share is None else share
    some = scored.where("n_words > 0")
    least = kth_largest(some, "perturbed", round(share * some.count()))
    kept = F.lit(False) if least is None else (F.col("n_words") > 0) & (F.col("perturbed") >= least)
    return scored.withColumn("kept", kept)
