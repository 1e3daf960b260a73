"""Command line: FASTA reads in, contigs out, and a summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.contigs import contig_stats
from .plans.config import AssemblyConfig
from .plans.pipeline import assemble
from .sources.fasta import read_fasta, write_fasta

VERSION = "1.0.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readweave", description="Assembles reads of one length into contigs.")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    p.add_argument("-l", "--readlen", type=int, required=True, help="length of all reads")
    p.add_argument("-t", "--overlap", type=int, required=True, help="least overlap, over 9 and under the read length")
    p.add_argument("--singlereads", required=True, metavar="FASTA", help="file or folder of two-line records")
    p.add_argument("--out", default="contigs", help="folder of the contigs (default: contigs)")
    p.add_argument("--mincontiglen", type=int, help="least length of a contig (default: twice the read length)")
    p.add_argument("--maxtiplen", type=int, help="bound of tips in bases and in reads (default: twice the read length)")
    p.add_argument("--numiters", type=int, help="steps up to that bound (default: two fifths of the read length)")
    p.add_argument("--bubblelen", type=int, default=10, help="reads by which an arm is shorter than its sibling")
    p.add_argument("--dedup", choices=("exact", "bloom"), default="exact")
    p.add_argument("--bloomlen", type=int, default=36, help="filter bits for each read, with --dedup bloom")
    p.add_argument("--nhashfunc", type=int, default=2, help="filter hashes, 1 to 5, with --dedup bloom")
    p.add_argument("--keep-dead-ends", action="store_true", help="leave the ends of chains untrimmed")
    p.add_argument("--dump", metavar="FOLDER", help="also write as Parquet: reads, import metrics, candidate counts and overlaps before cleaning, reads that each cleaning stage removed, nodes and edges after it, reads of each contig")
    return p


def config_of(args: argparse.Namespace) -> AssemblyConfig:
    return AssemblyConfig(
        args.readlen, args.overlap, max_tiplen=args.maxtiplen, num_iters=args.numiters, bubblelen=args.bubblelen, min_contiglen=args.mincontiglen,
        dedup=args.dedup, bloom_bits=args.bloomlen, bloom_hashes=args.nhashfunc, trim_dead_ends=not args.keep_dead_ends,
    )


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    try:
        config = config_of(args)
    except ValueError as wrong:
        p.error(str(wrong))
    spark = SparkSession.builder.appName("readweave").getOrCreate()
    result = assemble(read_fasta(spark, args.singlereads, config.read_len), config)
    write_fasta(result.contigs, args.out)
    if args.dump:
        for name in ("reads", "metrics", "counts", "overlaps", "audit", "nodes", "edges", "members"):
            getattr(result, name).write.mode("overwrite").parquet(f"{args.dump}/{name}")
    counts, found = result.metrics.first(), contig_stats(result.contigs).first()
    print(f"reads: {counts.n_raw} read, {counts.n_with_n} with N, {counts.n_duplicate} repeated, {counts.n_kept} kept")
    print(f"contigs: {found.n_contigs}, {found.total_length} bases, longest {found.longest}")
    print("seconds: " + ", ".join(f"{name} {spent:.1f}" for name, spent in result.seconds.items()))
    return 0
