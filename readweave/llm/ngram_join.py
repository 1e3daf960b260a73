"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide.

1. Documents with equal shingle sets share a node; a node's signature has a run of DEPTH minima for each of `trees` trees.
2. A tree is the sorted runs of all nodes, a trie of prefixes.  From the longest run a node's prefix is shortened until
   the target recall is reached: until a partner at the least similarity that a set of its size can have with another
   one, at the threshold or above, shares the prefix in one of the trees with the wanted probability.  Small sets have
   few attainable similarities, so theirs stay longer; no prefix is ever longer than its recall allows.
3. The nodes that share a prefix form a cell.  Within it runs are sorted and matched prefixes shortened from the longest
   common one down; sketches discard chance matches, and what is connected by a longer prefix is not compared again.
   What passes is sent on as a spanning forest, not as pairs.
4. Each family so connected gets its members' exact shingle sets and every pair of it is verified.
Cells of more than a block of members are cut into block-by-block cells, so no task holds a whole family.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, row_key, written
from .words import U64, Words, mix, slices, tidied

#: Minima of a tree's run, of 16 bits each; those of the first SKETCH levels lend a byte to a node's sketch.
DEPTH, SKETCH = 8, 5
#: Set sizes for which attainable similarities are listed; for larger ones they lie at the threshold.
_LISTED = 80


def forest_depth(threshold: float, trees: int, recall: float, most: int = DEPTH) -> int:
    """The longest run at which a pair of that similarity meets in one of the trees with the wanted probability."""
    for depth in range(most, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def least_similarity(n: int, threshold: Fraction) -> Fraction | None:
    """The least similarity, of the threshold at least, that a set of n can have with a different one; None if there is none."""
    found = []
    for m in range(math.ceil(threshold * n), math.floor(n / threshold) + 1):
        both = math.ceil(threshold * (n + m) / (1 + threshold))
        if both <= min(n, m) and not both == n == m:
            found.append(Fraction(both, n + m - both))
    return min(found, default=None)


def prefix_lengths(threshold: Fraction, trees: int, recall: float) -> list[list[int]]:
    """By size of a set (from 0, the last for all larger ones): the prefix lengths at which it stands in cells, its own and those of sets that may be its partners."""
    own = []
    for n in range(_LISTED + 1):
        least = least_similarity(n, threshold) if n else None
        own.append(None if least is None else forest_depth(float(least), trees, recall))
    beyond = forest_depth(float(threshold), trees, recall)
    length = lambda n: own[n] if n <= _LISTED else beyond
    out = []
    for n in range(_LISTED + 2):
        partners = range(math.ceil(threshold * n), math.floor(n / threshold) + 1) if n <= _LISTED else range(math.ceil(threshold * n), _LISTED + 2)
        out.append(sorted({length(m) for m in (n, *partners) if length(m) is not None}) if length(n) is not None else [])
    # Beyond the list, partners may still be listed ones up to 1 / threshold times smaller.
    last = sorted({beyond, *(length(m) for m in range(math.ceil(threshold * (_LISTED + 1)), _LISTED + 1))} - {None})
    return out[: _LISTED + 1] + [last]


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each; their bounds; a 16-byte fingerprint of each set."""
    words = Words(texts)
    at, h = words.windows(size, short=True)
    doc = words.doc[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    prints = np.zeros((len(texts), 2), U64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k, salt in enumerate((0x1B873593, 0xCC9E2D51)):
            prints[some, k] = mix(np.add.reduceat(mix(h ^ U64(salt)), bounds[some]))
    return h, bounds, prints


def _nodes(prints: np.ndarray, bounds: np.ndarray) -> list:
    raw, some = prints.tobytes(), np.diff(bounds) > 0
    return [raw[16 * i : 16 * i + 16] if some[i] else None for i in range(len(some))]


def _sign(size: int, trees: int):
    count = trees * DEPTH
    factors = (mix(np.arange(1, count + 1, dtype=U64)) | U64(1)).tolist()
    sketched = [t * DEPTH + k for t in range(trees) for k in range(SKETCH)]

    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                h, bounds, prints = shingle_sets(part.column(1), size)
                some = np.flatnonzero(np.diff(bounds))
                sig = np.zeros((count, len(part)), np.uint32)
                if len(some):
                    for i, a in enumerate(factors):
                        sig[i, some] = np.minimum.reduceat(((h * U64(a)) >> U64(32)).astype(np.uint32), bounds[some])
                nodes = _nodes(prints, bounds)
                # Low bits of a minimum, those that depend on the set least.
                runs, sketch = np.ascontiguousarray(sig.T.astype(">u2")), np.ascontiguousarray(sig[sketched].T.astype(np.uint8))
                sigs, sketches = ([None if x is None else row.tobytes() for x, row in zip(nodes, of, strict=True)] for of in (runs, sketch))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes, pa.binary()), pa.array(np.diff(bounds)), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "row", "node", "n", "sig", "sketch"])

    return run


def _cells(members: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """members, each sent to the block-by-block cells of its key: cell, side (0, 1, or 2 for both), and its columns."""
    each = members.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return each.withColumn("cell", F.xxhash64(key, low, high)).withColumn("side", side.cast("tinyint")).drop("own", "other", "n_blocks")


def _dealt(cells: DataFrame, *order: str) -> DataFrame:
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell", *order, "node")


def _groups(batches, most: int = 200_000):
    """Tables of whole cells, each of about `most` bytes or one cell at least."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most * 20:
            continue
        cell = batch.column("cell").to_numpy()
        cut = int(np.flatnonzero(cell == cell[-1])[0])
        if cut == 0 and held[0].column("cell")[0].as_py() == cell[-1]:
            continue
        table = pa.Table.from_batches(held)
        all_cells = table.column("cell").to_numpy()
        cut = len(all_cells) - int(np.argmax(all_cells[::-1] != all_cells[-1])) if (all_cells != all_cells[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member connected with each of n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == old).all():
            return root


def _binary(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _spans(cell: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])


_EDGE = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _tree_edges(root: np.ndarray) -> list[tuple[int, int]]:
    """(member, parent) that connect the members of each root; no member is the parent of more than eight."""
    out = []
    order = np.argsort(root, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        out += [(int(own[k]), int(own[(k - 1) // 8])) for k in range(1, len(own))]
    return out


def trie_roots(runs: np.ndarray, alike) -> np.ndarray:
    """The least member connected with each of the members of a cell.

    runs: their sorted runs.  alike(k, others) says which others a member passes with.  Subtries are walked from the
    longest common prefix down; at each length those members are compared that meet there first and are not connected yet.
    """
    n, depth = runs.shape
    differ = runs[1:] != runs[:-1]
    common = np.where(differ.any(1), differ.argmax(1), depth)
    root, child = np.arange(n), np.arange(n)
    for length in sorted(set(common.tolist()), reverse=True):
        part = np.concatenate([[0], np.cumsum(common < length)])
        edges = np.concatenate([[0], np.flatnonzero(common < length) + 1, [n]])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if high - low < 2 or child[low] == child[high - 1]:
                continue
            for k in range(low, high - 1):
                if (root[low:high] == root[k]).all():
                    break
                others = k + 1 + np.flatnonzero((root[k + 1 : high] != root[k]) & (child[k + 1 : high] != child[k]))
                found = others[alike(k, others)] if len(others) else others
                if len(found):
                    joined = np.unique(np.append(root[found], root[k]))
                    root[np.isin(root, joined)] = joined[0]
        child = part
    return root


def _sketch_edges(count: int, least: int):
    """Spanning forest of the members of each cell whose sketches agree in at least `least` of `count` places."""

    def run(batches):
        for table in _groups(batches):
            sketch, side = _binary(table.column("sketch"), count), table.column("side").to_numpy()
            runs = _binary(table.column("run"), 2 * DEPTH).view(">u2")
            nodes, bounds = table.column("node").to_pylist(), _spans(table.column("cell").to_numpy())
            size = np.diff(bounds)
            out = []
            at = bounds[:-1][size == 2]
            good = (sketch[at] == sketch[at + 1]).sum(1) >= least
            out += [(nodes[i + 1], nodes[i]) for i in at[good]]
            for i, n in zip(bounds[:-1].tolist(), size.tolist(), strict=True):
                if n > 2:
                    own, kind = sketch[i : i + n], side[i : i + n]
                    alike = lambda k, j: ((own[j] == own[k]).sum(1) >= least) & ((kind[j] == 2) | (kind[j] != kind[k]))  # noqa: B023, E731
                    out += [(nodes[i + a], nodes[i + b]) for a, b in _tree_edges(trie_roots(runs[i : i + n], alike))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in range(2)], schema=_EDGE)

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(3)):
                part = batch.slice(at, to - at)
                h, bounds, prints = shingle_sets(part.column(3), size)
                wanted = part.column(0).to_pylist()
                same = [i for i, node in enumerate(_nodes(prints, bounds)) if node == wanted[i]]
                rows = part.take(pa.array(same, pa.int64()))
                sets = pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in same], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), sets], names=["node", "family", "copies", "shingles"])

    return run


_LINK = pa.schema([("node", pa.binary()), ("hub", pa.binary()), ("links", pa.int64())])


def _verify(threshold: Fraction):
    """Per cell and member: how many documents it is linked to, and another member of the cell that links connect it with."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches):
        for table in _groups(batches):
            out = []
            bounds = _spans(table.column("cell").to_numpy())
            all_nodes, all_sets = table.column("node").to_pylist(), table.column("shingles").to_pylist()
            all_side, all_copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                own = [k for k in range(i, j) if k == i or all_nodes[k] != all_nodes[k - 1]]  # repeated rows of a node stand together
                if len(own) < 2:
                    continue
                nodes, side, copies = [all_nodes[k] for k in own], all_side[own], all_copies[own]
                sets = [np.frombuffer(all_sets[k], U64) for k in own]
                size = np.array([len(s) for s in sets])
                value, member = np.concatenate(sets), np.repeat(np.arange(len(own)), size)
                order = np.argsort(value, kind="stable")
                value, member = value[order], member[order]
                links, a, b = np.zeros(len(own), np.int64), [], []
                for k, mine in enumerate(sets):
                    left, right = np.searchsorted(value, mine), np.searchsorted(value, mine, "right")
                    many = right - left
                    place = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    shared = np.bincount(member[place], minlength=len(own))
                    with_ = np.flatnonzero(shared * down >= up * (size + size[k] - shared))
                    with_ = with_[(with_ != k) & ((side[with_] == 2) | (side[with_] != side[k]))]
                    links[k] = copies[with_].sum()
                    a += [k] * len(with_)
                    b.append(with_)
                root = _roots(len(own), np.array(a, int), np.concatenate(b).astype(int)) if a else np.arange(len(own))
                parent = np.arange(len(own))
                for k, up_to in _tree_edges(root):
                    parent[k] = up_to
                out += [(nodes[k], nodes[parent[k]], int(links[k])) for k in np.flatnonzero(links)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_LINK)], schema=_LINK)

    return run


def ngram_join(docs: DataFrame, threshold: float = 0.8, size: int = 5, trees: int = 24, recall: float = 0.9999, block: int = 1024) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id that links connect it with), n_links.

    A link joins two documents whose sets of `size`-word shingles have a Jaccard similarity of at least
    `threshold`; copies are links too, though they are never expanded into pairs.  Words are split at white
    space and compared unchanged; a text of fewer words than `size`, but not none, is one shingle.  Null
    and blank texts have no shingles, hence no links, and are classes of their own.  Rows that repeat a
    doc_id count as documents; a null doc_id is never a class_id unless the whole class has none.
    Other columns are not read.
    """
    return _classified(docs, F.xxhash64("text"), threshold, size, trees, recall, block).select("doc_id", "class_id", "n_links")


def _classified(docs: DataFrame, row: Column, threshold: float = 0.8, size: int = 5, trees: int = 24, recall: float = 0.9999, block: int = 1024) -> DataFrame:
    """One row per document: doc_id, row (equal for rows of equal text only), node (null without shingles), root (of its class), class_id, n_links."""
    limit = Fraction(threshold).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    signed = written(docs.mapInArrow(tidied(_sign(size, trees)), "doc_id long, row long, node binary, n long, sig binary, sketch binary"))
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(_first("doc_id", "row")).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.select("node", F.col("of.doc_id").alias("doc_id"), F.col("of.row").alias("row"), "copies", "n", "sig", "sketch"))

    # Cells: a tree, a length and the prefix of that length.
    lengths = prefix_lengths(limit, trees, recall)
    allowed = F.element_at(F.array(*[F.array(*[F.lit(x) for x in own]).cast("array<int>") for own in lengths]), F.least(F.col("n"), F.lit(_LISTED + 1)).cast("int") + 1)
    prefix = lambda d, t: F.struct(t.cast("tinyint").alias("tree"), F.xxhash64(t, d, F.substr(F.col("sig"), t * (2 * DEPTH) + 1, d * 2)).alias("key"))
    every = F.flatten(F.transform(allowed, lambda d: F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: prefix(d, t))))
    keys = nodes.select("node", F.explode(every).alias("k")).select("node", "k.tree", "k.key")
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / (2 * block)).alias("n_blocks"))
    members = _cells(keys, "key", crowded).drop("key").join(nodes.select("node", "sig", "sketch"), "node")
    members = members.select("cell", "side", "node", "sketch", F.substr("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("run"))
    count = trees * SKETCH
    sure = threshold - 4.5 * (threshold * (1 - threshold) / count) ** 0.5
    proposed = _dealt(members, "run").mapInArrow(tidied(_sketch_edges(count, int(sure * count))), "u binary, v binary")
    families = components(proposed, "u", "v").select("node", F.col("root").alias("family"))

    # Exact verification within families.
    known = written(families.join(nodes.select("node", "doc_id", "row", "copies", "n"), "node"))
    wanted = known.select("node", "family", "copies", F.col("doc_id").alias("of"), F.col("row").alias("of_row"))
    # The hint keeps the plan alike at every size; which documents are wanted grows with the corpus.
    texts = docs.hint("merge").join(wanted, wanted.of.eqNullSafe(docs.doc_id) & (wanted.of_row == docs.row)).select("node", "family", "copies", "text")
    sets = texts.mapInArrow(tidied(_sets(size)), "node binary, family binary, copies long, shingles binary")
    blocks = known.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / (block * 1024))).alias("n_blocks"))
    cells = _cells(sets, "family", blocks).select("cell", "side", "node", "copies", "shingles")
    verified = written(_dealt(cells).mapInArrow(tidied(_verify(limit)), "node binary, hub binary, links long"))
    roots = components(verified, "node", "hub")
    linked = verified.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")

    about = nodes.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "doc_id")
    about = written(about)
    classes = about.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    about = about.drop("doc_id").join(classes, "root").select("node", "root", "class_id", "n_links")
    rows = signed.select("doc_id", "row", "node")
    return rows.join(about, "node", "left").select("doc_id", "row", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _first(doc_id: str, row: str) -> Column:
    """What the first row of a group is least by: its doc_id, null last, and among equal ids the row key."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without near-duplicates: of each class one row, that of the least doc_id (null last; of equal ids, the least row key).

    Rows are told apart by all of their columns, so rows that share an id, or have none, are kept or dropped by their
    own text.  Rows without shingles are classes of their own and all stay.
    """
    rows = written(_classified(docs, row_key(docs), **how).select("doc_id", "row", "root"))
    of_class = rows.where("root is not null").groupBy("root").agg(F.min(_first("doc_id", "row")).alias("of"))
    of_class = of_class.select(F.col("of.doc_id").alias("_id"), F.col("of.row").alias("_key"), F.lit(True).alias("_one"))
    bare = rows.where("root is null").select(F.col("doc_id").alias("_id"), F.col("row").alias("_key"), F.lit(False).alias("_one")).distinct()
    stays = of_class.unionByName(bare)
    # The input's columns travel as one struct, so none of them meets a name used here.
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    own = docs.select(F.col("doc_id").cast("long").alias("id"), row_key(docs).alias("key"), carried.alias("given"))
    kept = own.join(stays, own.id.eqNullSafe(stays._id) & (own.key == stays._key))
    # Rows that still share a key are equal in all columns, so it does not matter which of them stays.
    one = kept.where("_one").dropDuplicates(["_id", "_key"])
    return one.unionByName(kept.where("not _one")).select("given.*")
