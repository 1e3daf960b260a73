"""Written tables in the folder that all executors share; they cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="readweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, rows_in_file: int = 0) -> DataFrame:
    """The same rows, from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/readweave-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_in_file).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def counted(df: DataFrame, condition: Column | bool = True) -> tuple[DataFrame, int]:
    """written(df), and how many of its rows meet the condition: counted as they are written, not by a query of its own.

    Loops ask after each step; what the driver keeps of queries, stages and threads grows with their number.
    """
    seen = Observation()
    table = written(df.observe(seen, F.count_if(F.lit(True) if condition is True else condition).alias("n")))
    return table, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` gave back and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
