"""Graph cleaning: tips, bubbles, bridges, junctions, dead ends.

Every pass decides on a snapshot and applies all of its decisions at once, so results do not hang on task order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import growing
from ..functions.storage import counted, written
from . import graph as G
from .paths import chains, members, paths

_EDGE = ["n", "ns", "d", "ds", "k"]


@dataclass(frozen=True)
class Graph:
    """One generation of the graph.  tails: n, ns, tail_nodes, tail_bp that removed tips left on a side."""

    read_len: int
    min_overlap: int
    average: float
    nodes: DataFrame
    edges: DataFrame
    tails: DataFrame
    #: Walks and paths over these nodes and edges, made when first asked for; a step that removes nothing hands them on.
    made: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    #: Steps that found nothing to remove from these nodes and edges.
    settled: set[tuple] = field(default_factory=set, compare=False, repr=False)

    def chains(self) -> DataFrame:
        if "chains" not in self.made:
            self.made["chains"] = chains(self.nodes, self.edges, self.read_len)
        return self.made["chains"]

    def paths(self) -> DataFrame:
        if "paths" not in self.made:
            self.made["paths"] = written(paths(self.nodes, self.edges, self.read_len, self.chains()))
        return self.made["paths"]


def _empty(like: DataFrame, schema: str) -> DataFrame:
    """No rows, of a plan that starts no Python workers as a list of no rows does."""
    columns = [c.split() for c in schema.split(", ")]
    return like.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns])


def start(nodes: DataFrame, edges: DataFrame, read_len: int, min_overlap: int) -> Graph:
    average = G.average_overlap(edges).first()[0]
    tails = _empty(nodes, "n long, ns int, tail_nodes long, tail_bp long")
    return Graph(read_len, min_overlap, average or 0.0, nodes, edges, tails)


def without(graph: Graph, gone_nodes: DataFrame | None = None, gone_edges: DataFrame | None = None, tails: DataFrame | None = None) -> Graph:
    """The next generation: reads and edges (with their mirrors) taken out, degrees and side types anew."""
    edges, nodes = graph.edges, graph.nodes
    if gone_edges is not None:
        cut = gone_edges.select(*_EDGE)
        edges = edges.join(growing(cut.union(G.mirrored(cut).select(*_EDGE))), _EDGE, "left_anti")
    if gone_nodes is not None:
        gone = growing(gone_nodes.select(F.col("read_id")).distinct())
        edges = edges.join(gone, edges.n == gone.read_id, "left_anti").join(gone, F.col("d") == gone.read_id, "left_anti")
        nodes = nodes.join(gone, "read_id", "left_anti")
    edges = written(edges.select(*_EDGE))
    about = nodes.select("read_id", "suspect").join(growing(G.degrees(edges)), "read_id", "left")
    deg = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    nodes = about.select("read_id", deg("deg_b").alias("deg_b"), deg("deg_f").alias("deg_f"), "suspect")
    nodes = written(nodes.select("read_id", "deg_b", "deg_f", G.side_type(F.col("deg_b")).alias("b_type"), G.side_type(F.col("deg_f")).alias("f_type"), "suspect"))
    return replace(graph, nodes=nodes, edges=edges, tails=graph.tails if tails is None else written(tails), made={}, settled=set())


def tip_paths(paths_: DataFrame, tails: DataFrame, read_len: int) -> DataFrame:
    """TIP paths with tip_len (reads) and tip_bp, tails that end beyond them included."""
    t = tails.select(F.col("n").alias("end"), F.col("ns").alias("end_s"), "tail_nodes", "tail_bp")
    own = paths_.where("type = 'TIP'").join(growing(t), ["end", "end_s"], "left")
    return own.withColumn("tip_len", F.col("len") + F.coalesce("tail_nodes", F.lit(0))).withColumn("tip_bp", F.col("end_len") - (F.lit(read_len) - F.col("k")) + F.coalesce("tail_bp", F.lit(0))).drop("tail_nodes", "tail_bp")


def removable(tip_limit: int, tip_len: int) -> Column:
    return (F.col("tip_bp") < tip_limit) & (F.col("tip_len") <= tip_len)


def removable_tips(tips: DataFrame, tip_limit: int, tip_len: int) -> DataFrame:
    return tips.where(removable(tip_limit, tip_len))


def spent_tips(tips: DataFrame, read_len: int, tip_limit: int) -> DataFrame:
    """n, ns, d, ds of tips that leave the race in the pass that sees them: too long in bases for a read, or in reads for the limit."""
    return tips.where((F.col("tip_bp") >= read_len) | (F.col("tip_len") > tip_limit)).select("n", "ns", "d", "ds")


def inherited_tails(graph: Graph, gone: DataFrame) -> DataFrame:
    """n, ns, tail_bp: what a lost edge leaves on the side of a read that stays and is no junction: the lost read's tail and the hop to it."""
    lost = graph.edges.join(growing(gone.select(F.col("read_id").alias("d"))), "d", "left_semi")
    stays = graph.nodes.where(~G.is_junction()).select(F.col("read_id").alias("n")).join(growing(gone.select(F.col("read_id").alias("n"))), "n", "left_anti")
    own = graph.tails.select(F.col("n").alias("d"), F.col("ns").alias("ds"), "tail_bp")
    bp = F.coalesce("tail_bp", F.lit(0)) + F.lit(graph.read_len) - F.col("k")
    return lost.join(growing(stays), "n").join(growing(own), ["d", "ds"], "left").groupBy("n", "ns").agg(F.max(bp).cast("long").alias("tail_bp"))


def remove_tips(graph: Graph, tip_limit: int, schedule: list[int]) -> Graph:
    """Removes short dead-end branches, the shortest first, until the schedule of lengths is through.

    A removed tip leaves its length on the side that bore it: what ends there later counts as so much longer.  Reads at
    whose removed neighbours a walk would have gone on inherit their tails when all passes are through.
    """
    key = ["n", "ns", "d", "ds"]
    at = 0
    done = _empty(graph.edges, "n long, ns int, d long, ds int")
    late = _empty(graph.edges, "n long, ns int, tail_bp long")
    while True:
        jumps = graph.chains()
        tips, n_out = counted(tip_paths(graph.paths(), graph.tails, graph.read_len).join(growing(done), key, "left_anti"), removable(tip_limit, schedule[at]))
        out = removable_tips(tips, tip_limit, schedule[at])
        done = written(done.union(spent_tips(tips.join(growing(out), key, "left_anti"), graph.read_len, tip_limit)))
        if not n_out:
            # Nothing at this length: go to the next one at which a tip goes.
            left = tips.join(growing(done), key, "left_anti")
            least = left.where(F.col("tip_bp") < tip_limit).agg(F.min("tip_len")).first()[0]
            later = [k for k in range(at + 1, len(schedule)) if least is not None and schedule[k] >= least]
            if not later:
                break
            at = later[0]
            out = written(removable_tips(left, tip_limit, schedule[at]))
        gone = written(members(out, jumps).select(F.col("member").alias("read_id")).union(out.select("end")).distinct())
        late = written(late.unionByName(inherited_tails(graph, gone)))
        new = out.select("n", "ns", F.col("tip_len").alias("tail_nodes"), (F.col("tip_bp") + F.lit(graph.read_len) - F.col("k")).alias("tail_bp"))
        graph = without(graph, gone_nodes=gone, tails=_longest(graph.tails.unionByName(new)))
    late = late.join(growing(graph.nodes.select(F.col("read_id").alias("n"))), "n", "left_semi").select("n", "ns", F.lit(0).cast("long").alias("tail_nodes"), "tail_bp")
    return replace(graph, tails=written(_longest(graph.tails.unionByName(late))))


def _longest(tails: DataFrame) -> DataFrame:
    return tails.groupBy("n", "ns").agg(F.max("tail_nodes").alias("tail_nodes"), F.max("tail_bp").alias("tail_bp"))


def bubble_siblings(paths_: DataFrame, bubblelen: int) -> DataFrame:
    """Pairs of arms (shorter first) from one side to one end, over bubblelen reads apart."""
    arm = paths_.where("type = 'BUBBLE'")
    a = arm.select("n", "ns", "end", "end_s", "d", "ds", "len")
    b = arm.select("n", "ns", "end", "end_s", F.col("d").alias("sib_d"), F.col("ds").alias("sib_ds"), F.col("len").alias("sib_len"))
    return a.join(growing(b), ["n", "ns", "end", "end_s"]).where(F.col("sib_len") > F.col("len") + bubblelen)


def judged_bubbles(graph: Graph, paths_: DataFrame, bubblelen: int, keep_best_arm: bool = False) -> DataFrame:
    """BUBBLE paths out of branching sides with match, depth, b_len, thin, longer_sibling and removed."""
    L = F.lit(graph.read_len)
    most = G.max_overlap(graph.edges)
    own = graph.nodes.select(F.col("read_id").alias("n"), "b_type", "f_type")
    arms = paths_.where("type = 'BUBBLE'").join(growing(own), "n")
    here, there = F.when(F.col("ns") == 1, F.col("b_type")).otherwise(F.col("f_type")), F.when(F.col("ns") == 1, F.col("f_type")).otherwise(F.col("b_type"))
    arms = arms.where((here == "BRANCH") & (there != "ENDING")).drop("b_type", "f_type")
    arms = arms.join(growing(most.withColumnRenamed("max_k", "_m")), ["n", "ns"])
    arms = arms.withColumn("_es", 1 - F.col("end_s")).join(growing(most.select(F.col("n").alias("end"), F.col("ns").alias("_es"), F.col("max_k").alias("_e"))), ["end", "_es"])
    arms = arms.withColumn("match", L - F.col("end_len") + (L - F.col("_m") - 1) + (L - 1 - F.col("_e"))).withColumn("depth", L - F.col("end_len") / F.col("len")).withColumn("b_len", F.col("bubble_len") - (L - F.col("k")))
    sib = bubble_siblings(paths_, bubblelen).select("n", "ns", "end", "end_s", "d", "ds").distinct().withColumn("_sib", F.lit(True))
    arms = arms.join(growing(sib), ["n", "ns", "end", "end_s", "d", "ds"], "left")
    arms = arms.withColumn("thin", F.col("depth") < F.lit(graph.average)).withColumn("longer_sibling", F.coalesce("_sib", F.lit(False)))
    removed = (F.col("b_len") < L) & (F.col("match") < graph.min_overlap) & (F.col("thin") | F.col("longer_sibling"))
    arms = arms.withColumn("removed", removed)
    if keep_best_arm:
        same = Window.partitionBy("n", "ns", "end", "end_s")
        best = F.row_number().over(same.orderBy(F.col("removed"), F.desc("depth"), "end_len", "len", F.least("d", F.coalesce("hop", "d")), "d")) == 1
        arms = arms.withColumn("_best", best).withColumn("removed", F.col("removed") & ~F.col("_best"))
    return arms.select("n", "ns", "d", "ds", "k", "end", "end_s", "hop", "len", "end_len", "bubble_len", "match", "depth", "b_len", "thin", "longer_sibling", "removed")


def _without_paths(graph: Graph, out: DataFrame, gone_nodes: DataFrame | None = None) -> Graph:
    gone = members(out, graph.chains()).select(F.col("member").alias("read_id"))
    return without(graph, gone if gone_nodes is None else gone.union(gone_nodes), out)


def remove_bubbles(graph: Graph, bubblelen: int, keep_best_arm: bool = False) -> Graph:
    judged = "bubbles", bubblelen, keep_best_arm
    # A step before that removed nothing hands on the same graph, on which there is nothing left to find.
    while judged not in graph.settled:
        out, n_out = counted(judged_bubbles(graph, graph.paths(), bubblelen, keep_best_arm).where("removed"))
        if n_out:
            graph = _without_paths(graph, out)
        else:
            graph.settled.add(judged)
    return graph


def bridges(nodes: DataFrame, paths_: DataFrame) -> DataFrame:
    """read_id of imbalanced junctions none of whose paths is a TIP or three reads long."""
    firm = paths_.where("type = 'TIP' or len >= 3").select(F.col("n").alias("read_id")).distinct()
    return nodes.where(G.is_junction() & F.col("suspect")).select("read_id").join(growing(firm), "read_id", "left_anti")


def remove_bridges(graph: Graph) -> Graph:
    p = graph.paths()
    gone, n_gone = counted(bridges(graph.nodes, p))
    if not n_gone:
        return graph
    out = p.join(growing(gone.select(F.col("read_id").alias("n"))), "n", "left_semi")
    return _without_paths(graph, out, gone)


def junction_votes(graph: Graph, paths_: DataFrame, bubblelen: int) -> DataFrame:
    """Paths of all-BUBBLE junctions: n, ns, d, ds, k, votes (opposite paths against it), opposite, removed."""
    L = F.lit(graph.read_len)
    mixed = paths_.where("type <> 'BUBBLE'").select("n").distinct()
    p = paths_.join(growing(mixed), "n", "left_anti")
    most = G.max_overlap(graph.edges).select(F.col("n").alias("end"), F.col("ns").alias("_es"), F.col("max_k").alias("_e"))
    p = p.withColumn("_es", 1 - F.col("end_s")).join(growing(most), ["end", "_es"]).withColumn("m", L - 1 - F.col("_e"))
    cols = ["d", "ds", "k", "end", "end_s", "hop", "len", "end_len", "bubble_len", "m"]
    one = p.where("ns = 1").select("n", *[F.col(c).alias(c + "1") for c in cols])
    two = p.where("ns = 0").select("n", *[F.col(c).alias(c + "2") for c in cols])
    pairs = one.join(growing(two), "n")
    pairs = pairs.withColumn("near", (F.col("bubble_len1") + F.col("bubble_len2") < L) & (L - (F.col("end_len1") + F.col("end_len2")) + F.col("m1") + F.col("m2") < graph.min_overlap))
    pairs = pairs.withColumn("thin", L - (F.col("end_len1") + F.col("end_len2")) / (F.col("len1") + F.col("len2")) < F.lit(graph.average))
    q = paths_.where("type = 'BUBBLE'").select(F.col("n").alias("qn"), F.col("ns").alias("qs"), F.col("d").alias("qd"), F.col("end").alias("qe"), F.col("end_s").alias("qes"), F.col("len").alias("ql"))
    x = pairs.where("near")
    on = (x.end2 == q.qn) & (1 - x.end_s2 == q.qs) & (x.end1 == q.qe) & (x.end_s1 == q.qes) & (q.qd != F.coalesce(x.hop2, x.n)) & (q.qd != x.n) & (q.ql > x.len1 + x.len2 + bubblelen)
    ids = ["n", "d1", "ds1", "k1", "d2", "ds2", "k2"]
    longer = x.join(growing(q), on, "left_semi").select(*ids)
    votes = x.where("thin").select(*ids).union(longer).distinct()
    against = votes.select("n", F.lit(1).alias("ns"), F.col("d1").alias("d"), F.col("ds1").alias("ds"), F.col("k1").alias("k")).union(votes.select("n", F.lit(0), "d2", "ds2", "k2"))
    against = against.groupBy("n", "ns", "d", "ds", "k").agg(F.count(F.lit(1)).alias("votes"))
    sides = p.groupBy("n").agg(F.sum(F.when(F.col("ns") == 1, 1).otherwise(0)).alias("_b"), F.sum(F.when(F.col("ns") == 0, 1).otherwise(0)).alias("_f"))
    rows = p.select("n", "ns", "d", "ds", "k").join(growing(sides), "n").withColumn("opposite", F.when(F.col("ns") == 1, F.col("_f")).otherwise(F.col("_b")))
    rows = rows.join(growing(against), ["n", "ns", "d", "ds", "k"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    return rows.select("n", "ns", "d", "ds", "k", "votes", "opposite", ((F.col("votes") == F.col("opposite")) & (F.col("opposite") > 0)).alias("removed"))


def remove_junctions(graph: Graph, bubblelen: int) -> Graph:
    while True:
        out, n_out = counted(junction_votes(graph, graph.paths(), bubblelen).where("removed"))
        if not n_out:
            return graph
        graph = _without_paths(graph, out)


def dead_end_walk(graph: Graph, limit: int) -> tuple[DataFrame, DataFrame]:
    """(gone, offsets): reads within `limit` bases of a dead end; read_id, side (1 B, 0 F) and offset where output then begins.

    A dead end is left along each of its edges and goes if one hop fits; a walk goes on through reads with one edge on
    each side and ends at others without an offset.  Walks are not followed hop by hop: a read's chain, seen backwards,
    names the dead end it comes from and the bases between.
    """
    L = graph.read_len
    kinds = graph.nodes.where(~G.is_isolated()).select("read_id", "b_type", "f_type")
    ending = kinds.where("b_type = 'ENDING'").select(F.col("read_id").alias("x"), F.lit(0).alias("xs")).union(kinds.where("f_type = 'ENDING'").select("read_id", F.lit(1)))
    tails = graph.tails.select(F.col("n").alias("x"), (1 - F.col("ns")).alias("xs"), "tail_bp")
    starts = written(ending.join(growing(tails), ["x", "xs"], "left").select("x", "xs", F.coalesce("tail_bp", F.lit(0)).cast("long").alias("cum")))
    back = graph.chains().select(F.col("x").alias("m"), (1 - F.col("xs")).alias("ms"), F.col("y").alias("x"), (1 - F.col("ys")).alias("xs"), "bp")
    inner = back.join(growing(starts), ["x", "xs"]).select(F.col("m").alias("x"), F.col("ms").alias("xs"), (F.col("cum") + F.col("bp")).alias("cum")).where(F.col("cum") <= limit)
    at = written(starts.union(inner))
    hops = graph.edges.select(F.col("n").alias("x"), F.col("ns").alias("xs"), (F.lit(L) - F.col("k")).alias("bp"))
    on = written(at.join(growing(hops), ["x", "xs"]).where(F.col("cum") + F.col("bp") <= limit).select("x", "xs").distinct())
    gone = on.select(F.col("x").alias("read_id")).distinct()
    offset = F.greatest(F.lit(0), F.least(F.lit(L), F.lit(L) - F.col("cum"))).cast("long")
    ends = at.join(growing(on), ["x", "xs"], "left_anti").select(F.col("x").alias("read_id"), (1 - F.col("xs")).alias("side"), offset.alias("offset"))
    return gone, ends.join(growing(gone), "read_id", "left_anti").groupBy("read_id", "side").agg(F.min("offset").alias("offset"))


def trim_dead_ends(graph: Graph, limit: int) -> tuple[Graph, DataFrame]:
    gone, offsets = dead_end_walk(graph, limit)
    return without(graph, gone_nodes=gone), written(offsets)
