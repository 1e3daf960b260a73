"""The assembly: reads -> overlaps -> string graph -> cleaning -> contigs, with timings of each stage."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import growing
from ..functions.storage import written
from ..operators import clean, contigs, graph, overlap, reads
from .config import AssemblyConfig


#: Cleaning steps in their order; dead ends are trimmed after them.
STEPS = ("tips", "bubbles", "bridges", "bubbles", "junctions")


def cleaned(g: clean.Graph, step: str, config: AssemblyConfig) -> clean.Graph:
    if step == "tips":
        return clean.remove_tips(g, config.tip_limit, config.tip_schedule)
    if step == "bubbles":
        return clean.remove_bubbles(g, config.bubblelen, config.keep_best_arm)
    return clean.remove_bridges(g) if step == "bridges" else clean.remove_junctions(g, config.bubblelen)


def removed_by(stage: str, before: clean.Graph, after: clean.Graph) -> DataFrame:
    return before.nodes.select("read_id").join(growing(after.nodes.select("read_id")), "read_id", "left_anti").select(F.lit(stage).alias("stage"), "read_id")


def audited(g: clean.Graph, config: AssemblyConfig) -> tuple[clean.Graph, DataFrame, DataFrame | None]:
    """(graph after all steps, stage and read_id of each read that a stage removed, offsets of trimmed dead ends)."""
    removed, offsets = [], None
    for k, step in enumerate((*STEPS, *["dead ends"] * config.trim_dead_ends)):
        before = g
        if step == "dead ends":
            g, offsets = clean.trim_dead_ends(g, config.tip_limit)
        else:
            g = cleaned(g, step, config)
        removed.append(removed_by(f"{k + 1} {step}", before, g))
    audit = removed[0]
    for more in removed[1:]:
        audit = audit.unionByName(more)
    return g, written(audit), offsets


@dataclass
class AssemblyResult:
    contigs: DataFrame
    reads: DataFrame
    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame
    #: Candidate counts and edges of each read before cleaning, reads that each stage removed, reads of each contig.
    counts: DataFrame
    overlaps: DataFrame
    audit: DataFrame
    members: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def assemble(raw: DataFrame, config: AssemblyConfig) -> AssemblyResult:
    """raw: file_ord, seq.  Each stage's result is a written table."""
    seconds: dict[str, float] = {}

    def timed(name, make):
        began = time.time()
        out = make()
        seconds[name] = time.time() - began
        return out

    def load():
        good = reads.drop_n(raw)
        kept = reads.dedup_exact(good) if config.dedup == "exact" else reads.dedup_bloom(good, config.bloom_bits, config.bloom_hashes)
        return written(reads.assign_ids(kept))

    kept = timed("import", load)
    short = timed("overlap", lambda: written(overlap.shortlist(overlap.candidates(reads.oriented(kept), config.read_len, config.min_overlap))))
    edges = timed("reduce", lambda: written(overlap.reduced(short)))
    counts = written(overlap.shortlist_counts(short, kept))
    nodes = written(graph.nodes(counts, edges))
    g, audit, offsets = timed("clean", lambda: audited(clean.start(nodes, edges, config.read_len, config.min_overlap), config))
    about = timed("contigs", lambda: contigs.placed_reads(g.nodes, g.edges, kept, config.read_len, offsets))
    found = timed("spell", lambda: written(contigs.numbered(about, config.read_len, config.contig_limit)))
    members = contigs.members_of(found, about)
    return AssemblyResult(found.select("contig_id", "seq", "length"), kept, g.nodes, g.edges, reads.import_metrics(raw, kept), counts, edges, audit, members, seconds)
