"""FASTA in and out: strict two-line records, numbered one-line contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.alphabet import is_legal
from ..functions.storage import written


class FastaError(ValueError):
    """A record that breaks the two-line form."""


def record_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(">")).agg(F.count(F.lit(1)).alias("n_records"))


def read_fasta(spark: SparkSession, path: str, read_len: int) -> DataFrame:
    """file_ord, header, seq (upper case).  A line without header, of another length or with other symbols raises.

    Lines keep their order by file and byte block, whichever task reads a block: within one, Spark's row ids follow each
    other, and block sizes, one row each, turn them into line numbers.  No line is sorted.  CRLF and a missing last
    newline are accepted.
    """
    block = ("file", "offset")
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset")]
    lines = written(spark.read.text(path).select(F.rtrim(F.translate("value", "\r", "")).alias("line"), *meta, F.monotonically_increasing_id().alias("mono")))
    sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("mono").alias("first"))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*block, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base"))
    numbered = lines.join(base, [*block]).select("line", (F.col("mono") + F.col("base")).alias("nr"))
    rec = numbered.groupBy(F.expr("nr div 2").alias("file_ord")).agg(F.max(F.when(F.col("nr") % 2 == 0, F.col("line"))).alias("header"), F.max(F.when(F.col("nr") % 2 == 1, F.col("line"))).alias("seq"))
    seq = F.upper("seq")
    fault = (
        F.when(F.col("header").isNull() | ~F.col("header").startswith(">"), "a record does not begin with >")
        .when(F.col("seq").isNull(), "a header has no sequence")
        .when(F.length("seq") != read_len, "a sequence has another length")
        .when(~is_legal(seq), "a sequence has an illegal symbol")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": record "), F.col("file_ord").cast("string")))).otherwise(seq)
    return rec.select("file_ord", F.substring("header", 2, 1 << 20).alias("header"), checked.alias("seq"))


def write_fasta(contigs: DataFrame, path: str) -> None:
    """contig_id, seq -> >contig N and one line of sequence, in order of contig_id."""
    lines = contigs.orderBy("contig_id").select(F.concat(F.lit(">contig "), F.col("contig_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))
    lines.write.text(path)


class FastaDataSource(DataSource):
    """spark.read.format("fasta").option("path", file).option("readlen", n): a file that every executor has at this path.

    file_ord is the record's byte offset, which orders records without a count of the lines before.  A partition is a
    range of bytes and reads the records that begin in it, so no task reads what another one does.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file_ord long, header string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Block(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.read_len, self.block = options["path"], int(options["readlen"]), int(options.get("blockbytes", 64 << 20))

    def partitions(self):
        import os

        size = os.path.getsize(self.path)
        return [_Block(k, min(size, k + self.block)) for k in range(0, size, self.block)] or [_Block(0, 0)]

    def read(self, partition):
        legal = set(b"ACGTN")
        with open(self.path, "rb") as f:
            at = partition.start
            if at:
                # What began before the range belongs to an earlier one: go on at the first line that begins in it.
                f.seek(at - 1)
                at += len(f.readline()) - 1
                line = f.readline()
                if not line.startswith(b">"):
                    at, line = at + len(line), b""
                    if at < partition.stop:
                        line = f.readline()
            else:
                line = f.readline()
            while line and at < partition.stop:
                following = f.readline()
                seq = following.rstrip(b"\r\n").upper()
                if not line.startswith(b">") or len(seq) != self.read_len or set(seq) - legal:
                    raise FastaError(f"the record at byte {at} is malformed")
                yield at, line[1:].rstrip(b"\r\n").decode(), seq.decode()
                at += len(line) + len(following)
                line = f.readline()
            if line and not line.startswith(b">"):
                raise FastaError(f"the line at byte {at} belongs to no record")
