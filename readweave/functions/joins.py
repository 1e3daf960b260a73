"""How tables that grow with the input are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame


def growing(df: DataFrame) -> DataFrame:
    """df for a join whose other side grows with the input too: sorted sides, which spill and of which Spark splits frequent keys.

    Without it Spark may broadcast a side from the driver, by a size that it guesses from packed files and before lists are
    exploded: a tenth of what the rows take, or less.
    """
    return df.hint("merge")
