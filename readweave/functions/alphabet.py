"""Column functions over sequences of A, C, G, T and N."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rc(seq: Column) -> Column:
    """Reverse complement."""
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def canonical(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(seq, rc(seq))


def is_legal(seq: Column) -> Column:
    return seq.rlike("^[ACGTN]+$")


def has_n(seq: Column) -> Column:
    return F.contains(seq, F.lit("N"))


def edge_type(ns: Column, ds: Column) -> Column:
    """FB: suffix meets prefix; FF, BB: a strand is turned; BF: prefix meets suffix."""
    return F.when((ns == 0) & (ds == 0), "FB").when((ns == 0) & (ds == 1), "FF").when((ns == 1) & (ds == 0), "BB").otherwise("BF")
