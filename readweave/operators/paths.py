"""Non-branching paths by pointer doubling: a walk of m nodes takes log2(m) joins on (node, strand), or rounds in memory where steps are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import growing
from ..functions.storage import counted, discard, written
from .graph import is_junction


#: Tables of up to so many steps are walked in one task: that many take 4 s and 200 MB besides the interpreter's.
ONE_TASK = 1_000_000
_WALKS = "x long, xs int, y long, ys int, steps long, bp long, pre long, pre_s int, last long"


def doubled(steps: DataFrame) -> DataFrame:
    """steps: x, xs, y, ys, bp, one row for each x, xs -> for each oriented node x the far end y of its walk.

    Also steps, bp, pre, pre_s (last node before y) and last (bp of the last step).  A walk goes on while its end has a
    step; nodes on rings never end and are left out.
    """
    first, n = counted(steps.select("x", "xs", "y", "ys", F.col("bp").cast("long").alias("bp")))
    if n <= ONE_TASK:
        # A round of joins over a table of this size is all start-up; the same rounds take a second in memory.
        return written(first.repartition(1).mapInArrow(_walked, _WALKS))
    from_ = first.select("x", "xs", F.lit(True).alias("goes"))
    now = first.select("x", "xs", "y", "ys", F.lit(1).cast("long").alias("steps"), "bp", F.col("x").alias("pre"), F.col("xs").alias("pre_s"), F.col("bp").alias("last"))
    now = now.join(growing(from_.select(F.col("x").alias("y"), F.col("xs").alias("ys"), "goes")), ["y", "ys"], "left")
    now, open_ = counted(now.select("x", "xs", "y", "ys", "steps", "bp", "pre", "pre_s", "last", F.coalesce("goes", F.lit(False)).alias("goes")), F.col("goes"))
    discard(first)
    before = None
    # Walks double each round; those still open when none closes any more are rings.
    rounds = 0
    while open_ and (open_ != before or (1 << rounds) <= open_):
        far = now.select(F.col("x").alias("y"), F.col("xs").alias("ys"), *[F.col(c).alias("f_" + c) for c in ("y", "ys", "steps", "bp", "pre", "pre_s", "last", "goes")])
        on = now.where("goes").join(growing(far), ["y", "ys"]).select("x", "xs", F.col("f_y").alias("y"), F.col("f_ys").alias("ys"), (F.col("steps") + F.col("f_steps")).alias("steps"), (F.col("bp") + F.col("f_bp")).alias("bp"), F.col("f_pre").alias("pre"), F.col("f_pre_s").alias("pre_s"), F.col("f_last").alias("last"), F.col("f_goes").alias("goes"))
        spent, before = now, open_
        now, open_ = counted(now.where("not goes").unionByName(on), F.col("goes"))
        discard(spent)
        rounds += 1
    return now.where("not goes").drop("goes")


def _walked(batches):
    """The rounds of doubled() over all steps at once; gives back blocks of rows."""
    import numpy as np
    import pyarrow as pa

    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    x, xs, y, ys, bp = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]).astype(np.int64) for c in ("x", "xs", "y", "ys", "bp"))
    key, to = 2 * x + xs, 2 * y + ys
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key, to, sorter=order), len(key) - 1)
    # The row that a walk goes on with, or -1.
    on = np.where(key[order[at]] == to, order[at], -1)
    end, steps, pre, last = to, np.ones_like(bp), key, bp
    # All that end have ended after as many doublings as the number of steps allows.
    for _ in range(len(key).bit_length()):
        far = np.flatnonzero(on >= 0)
        if not len(far):
            break
        j, end, steps, bp, pre, last, next_ = on[far], end.copy(), steps.copy(), bp.copy(), pre.copy(), last.copy(), on.copy()
        end[far], pre[far], last[far], next_[far] = end[j], pre[j], last[j], on[j]
        steps[far], bp[far] = steps[far] + steps[j], bp[far] + bp[j]
        on = next_
    done = on < 0
    out = x[done], xs[done], end[done] >> 1, end[done] & 1, steps[done], bp[done], pre[done] >> 1, pre[done] & 1, last[done]
    fields = [f.split() for f in _WALKS.split(", ")]
    table = pa.table([pa.array(v, {"long": pa.int64(), "int": pa.int32()}[kind]) for v, (_, kind) in zip(out, fields)], names=[name for name, _ in fields])
    yield from table.to_batches(max_chunksize=100_000)


def chains(nodes: DataFrame, edges: DataFrame, read_len: int) -> DataFrame:
    """doubled() over the reads with one edge on each side."""
    inner = nodes.where("b_type = 'ONE' and f_type = 'ONE'").select("read_id")
    steps = edges.join(growing(inner), edges.n == inner.read_id).select(F.col("n").alias("x"), F.col("ns").alias("xs"), F.col("d").alias("y"), F.col("ds").alias("ys"), (F.lit(read_len) - F.col("k")).alias("bp"))
    return doubled(steps)


def paths(nodes: DataFrame, edges: DataFrame, read_len: int, jumps: DataFrame | None = None) -> DataFrame:
    """One row per edge out of a junction: n, ns, d, ds, k, end, end_s, hop, len, end_len, bubble_len, type.

    TIP: the end has a side without edges; BUBBLE: it is entered at a branching side; NONE otherwise.
    """
    jumps = chains(nodes, edges, read_len) if jumps is None else jumps
    starts = edges.join(growing(nodes.where(is_junction()).select(F.col("read_id").alias("n"))), "n")
    j = jumps.select(F.col("x").alias("d"), F.col("xs").alias("ds"), "y", "ys", "steps", "bp", "pre", "last")
    walked = starts.join(growing(j), ["d", "ds"], "left").select(
        "n", "ns", "d", "ds", "k",
        F.coalesce("y", "d").alias("end"), F.coalesce("ys", "ds").alias("end_s"), F.col("pre").alias("hop"),
        (F.lit(1) + F.coalesce("steps", F.lit(0))).cast("long").alias("len"),
        (F.lit(read_len) - F.col("k") + F.coalesce("bp", F.lit(0))).cast("long").alias("end_len"),
        F.when(F.col("steps").isNull(), 0).otherwise(F.lit(read_len) - F.col("k") + F.col("bp") - F.col("last")).cast("long").alias("bubble_len"),
    )
    about = nodes.select(F.col("read_id").alias("end"), F.col("b_type").alias("_b"), F.col("f_type").alias("_f"))
    entered = F.when(F.col("end_s") == 0, F.col("_b")).otherwise(F.col("_f"))
    kind = F.when((F.col("_b") == "ENDING") | (F.col("_f") == "ENDING"), "TIP").when(entered == "BRANCH", "BUBBLE").otherwise("NONE")
    # A walk that began inside a ring has no end and is no path.
    return walked.join(growing(about), "end").where("not (_b = 'ONE' and _f = 'ONE')").select("n", "ns", "d", "ds", "k", "end", "end_s", "hop", "len", "end_len", "bubble_len", kind.alias("type"))


def members(paths_: DataFrame, jumps: DataFrame) -> DataFrame:
    """n, ns, d, ds, member: the inner reads of each path; seen from its other end they all walk back to n by way of d."""
    j = jumps.select(F.col("x").alias("member"), F.col("y").alias("n"), (1 - F.col("ys")).alias("ns"), F.col("pre").alias("d"), (1 - F.col("pre_s")).alias("ds"))
    return paths_.select("n", "ns", "d", "ds").join(growing(j), ["n", "ns", "d", "ds"])
