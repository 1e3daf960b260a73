"""Reads that arrive as a stream: first-wins dedup, and overlaps with a stored set of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import canonical
from ..operators.overlap import candidates
from ..operators.reads import drop_n, oriented


def distinct_reads(arriving: DataFrame) -> DataFrame:
    """arriving: streaming file_ord, seq.  Drops reads with N and those seen before modulo reverse complement.

    The state is one key per distinct read, kept in the state store; which of two equal reads comes first is a
    matter of arrival.
    """
    return drop_n(arriving).withColumn("_key", canonical(F.col("seq"))).dropDuplicates(["_key"]).drop("_key")


def overlaps_with(arriving: DataFrame, stored: DataFrame, read_len: int, min_overlap: int) -> DataFrame:
    """arriving (streaming) and stored: read_id, seq.  n, ns, d, ds, k, ext for suffixes of arriving reads that begin stored ones.

    A stateless equi-join on seeds; the stored side is read anew for each batch.
    """
    return candidates(oriented(arriving), read_len, min_overlap, heads_of=oriented(stored))
