"""Every operator as a query over the fixture reads, with SQL that states the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import canonical, edge_type, is_legal, rc
from ..functions.joins import growing
from ..functions.storage import shared_dir, written
from ..operators import clean, contigs, graph, overlap, paths, reads, search
from ..sources.fasta import read_fasta, record_count, write_fasta
from .cleaning_sql import Cleaning
from .config import AssemblyConfig
from .fixtures import HAND, HAPLOTYPES_SQL, RAW_SQL, hand, hand_sql, haplotype_reads, raw_reads
from .fixtures import MIN_OVERLAP as T
from .fixtures import READ_LEN as L
from .pipeline import STEPS, assemble, cleaned, removed_by

_tables: dict[tuple, DataFrame] = {}
#: Stages that the next one alone reads, in the same pass.
_PASSED_ON = {("haplotypes", "raw"), ("haplotypes", "cands")}


def stage(spark: SparkSession, sf_dir: str, name: str, fixture: str = "base") -> DataFrame:
    """A pipeline stage over a fixture's reads, written once a session."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, name, fixture)
    if key not in _tables:
        s = lambda n: stage(spark, sf_dir, n, fixture)
        make = {
            "raw": lambda: {"base": raw_reads, "haplotypes": haplotype_reads}[fixture](spark, sf_dir),
            "reads": lambda: reads.assign_ids(reads.dedup_exact(reads.drop_n(s("raw")))),
            "cands": lambda: overlap.candidates(reads.oriented(s("reads")), L, T),
            "short": lambda: overlap.shortlist(s("cands")),
            "edges": lambda: overlap.reduced(s("short")),
            "nodes": lambda: graph.nodes(overlap.shortlist_counts(s("short"), s("reads")), s("edges")),
            "paths": lambda: paths.paths(s("nodes"), s("edges"), L),
        }[name]
        if (fixture, name) in _PASSED_ON:
            return make()
        _tables[key] = written(make())
    return _tables[key]


_KEPT = f"""{RAW_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) ORDER BY file_ord) AS rn FROM raw WHERE seq NOT LIKE '%N%'),
reads AS (SELECT CAST(row_number() OVER (ORDER BY file_ord) - 1 AS BIGINT) AS read_id, file_ord, seq FROM ranked WHERE rn = 1)"""
_ORI = f"""{_KEPT},
ori AS (SELECT read_id, 0 AS strand, seq FROM reads UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads)"""
_CAND = f"""{_ORI},
seeds AS (SELECT read_id AS n, strand AS ns, substr(seq, CAST(s AS BIGINT)) AS suffix, substr(seq, CAST(s AS BIGINT), {T}) AS seed FROM ori, (SELECT unnest(range(2, {L - T + 2})) AS s)),
cands AS (SELECT n, ns, read_id AS d, strand AS ds, length(suffix) AS k, substr(seq, length(suffix) + 1) AS ext
  FROM seeds JOIN ori ON seed = substr(seq, 1, {T}) WHERE starts_with(seq, suffix))"""
_EDGES = f"""{_CAND},
edges AS MATERIALIZED (SELECT n, ns, d, ds, k FROM cands c WHERE n <> d AND NOT EXISTS (SELECT 1 FROM cands o WHERE o.n = c.n AND o.ns = c.ns AND
  ((o.k > c.k AND starts_with(c.ext, o.ext)) OR (o.d = c.d AND o.k = c.k AND o.ext = c.ext AND c.ds <> c.ns AND o.ds = c.ns))))"""
_NODES = f"""{_EDGES},
olp AS (SELECT read_id, count(n) FILTER (ns = 1) AS ob, count(n) FILTER (ns = 0) AS of_ FROM reads LEFT JOIN cands ON n = read_id GROUP BY read_id),
deg AS (SELECT read_id, count(n) FILTER (ns = 1) AS deg_b, count(n) FILTER (ns = 0) AS deg_f FROM reads LEFT JOIN edges ON n = read_id GROUP BY read_id),
nodes AS MATERIALIZED (SELECT read_id, deg_b, deg_f,
  CASE deg_b WHEN 0 THEN 'ENDING' WHEN 1 THEN 'ONE' ELSE 'BRANCH' END AS b_type, CASE deg_f WHEN 0 THEN 'ENDING' WHEN 1 THEN 'ONE' ELSE 'BRANCH' END AS f_type,
  greatest(ob, of_) > 0 AND abs(ob - of_) * 10 > greatest(ob, of_) * 6 AS suspect FROM deg JOIN olp USING (read_id))"""
_J = "((b_type = 'BRANCH' AND f_type <> 'ENDING') OR (f_type = 'BRANCH' AND b_type <> 'ENDING'))"
_PATHS = f"""{_NODES},
walk AS (
  SELECT e.n, e.ns, e.d, e.ds, e.k, e.d AS cur, e.ds AS cur_s, CAST(NULL AS BIGINT) AS hop, CAST(1 AS BIGINT) AS len, CAST({L} - e.k AS BIGINT) AS end_len, CAST(0 AS BIGINT) AS bubble_len
  FROM edges e JOIN nodes ON e.n = read_id WHERE {_J}
  UNION ALL
  SELECT w.n, w.ns, w.d, w.ds, w.k, e.d, e.ds, w.cur, w.len + 1, w.end_len + {L} - e.k, w.end_len
  FROM walk w JOIN nodes ON w.cur = read_id AND b_type = 'ONE' AND f_type = 'ONE' JOIN edges e ON e.n = w.cur AND e.ns = w.cur_s),
paths AS MATERIALIZED (SELECT n, ns, d, ds, k, cur AS "end", cur_s AS end_s, hop, len, end_len, bubble_len,
  CASE WHEN b_type = 'ENDING' OR f_type = 'ENDING' THEN 'TIP' WHEN (CASE cur_s WHEN 0 THEN b_type ELSE f_type END) = 'BRANCH' THEN 'BUBBLE' ELSE 'NONE' END AS type
  FROM walk JOIN nodes ON cur = read_id WHERE NOT (b_type = 'ONE' AND f_type = 'ONE'))"""
_BUBBLES = f"""{_PATHS},
most AS (SELECT n, ns, max(k) AS max_k FROM edges GROUP BY n, ns),
arms AS (SELECT p.*, {L} - p.end_len + ({L} - m.max_k - 1) + ({L} - 1 - e.max_k) AS match, {L} - p.end_len / p.len AS depth, p.bubble_len - ({L} - p.k) AS b_len,
  {L} - p.end_len / p.len < (SELECT avg(k) FROM edges) AS thin,
  EXISTS (SELECT 1 FROM paths q WHERE q.type = 'BUBBLE' AND q.n = p.n AND q.ns = p.ns AND q."end" = p."end" AND q.end_s = p.end_s AND q.len > p.len + 10) AS longer_sibling
  FROM paths p JOIN nodes o ON o.read_id = p.n JOIN most m ON m.n = p.n AND m.ns = p.ns JOIN most e ON e.n = p."end" AND e.ns = 1 - p.end_s
  WHERE p.type = 'BUBBLE' AND (CASE p.ns WHEN 1 THEN o.b_type ELSE o.f_type END) = 'BRANCH' AND (CASE p.ns WHEN 1 THEN o.f_type ELSE o.b_type END) <> 'ENDING')"""
_SPLIT = f"""{_NODES},
kinds AS (SELECT read_id AS n, 1 AS ns, b_type AS t FROM nodes WHERE deg_b + deg_f > 0 UNION ALL SELECT read_id, 0, f_type FROM nodes WHERE deg_b + deg_f > 0),
ends AS MATERIALIZED (SELECT n, ns, CASE WHEN t = 'ENDING' THEN 'TENDING' WHEN EXISTS (SELECT 1 FROM edges e JOIN kinds o ON o.n = e.d AND o.ns = 1 - e.ds AND o.t = 'BRANCH' WHERE e.n = x.n AND e.ns = x.ns) THEN 'HALF'
  WHEN t = 'BRANCH' THEN 'TENDING' ELSE 'ONE' END AS e FROM kinds x)"""
_UNITIGS = f"""{_SPLIT},
most AS (SELECT n, ns, max(k) AS max_k FROM edges GROUP BY n, ns),
cut AS MATERIALIZED (SELECT ends.n, ends.ns, e, CASE e WHEN 'TENDING' THEN 0 ELSE max_k END AS leave, CASE e WHEN 'HALF' THEN max_k ELSE 0 END AS enter FROM ends LEFT JOIN most ON most.n = ends.n AND most.ns = ends.ns),
run AS (
  SELECT n AS start, CAST(1 - ns AS INTEGER) AS start_s, n AS cur, CAST(1 - ns AS INTEGER) AS cur_s, CAST(0 AS BIGINT) AS place FROM cut WHERE e <> 'ONE'
  UNION ALL
  SELECT r.start, r.start_s, e.d, e.ds, r.place + 1 FROM run r JOIN cut c ON c.n = r.cur AND c.ns = r.cur_s AND c.e = 'ONE' JOIN edges e ON e.n = r.cur AND e.ns = r.cur_s
  JOIN cut o ON o.n = e.d AND o.ns = 1 - e.ds AND o.e = 'ONE'),
spelled AS (SELECT start, start_s, string_agg(substr(seq, CAST(i.enter + 1 AS BIGINT), CAST(greatest(0, {L} - o.leave - i.enter) AS BIGINT)), '' ORDER BY place) AS s, arg_max(cur, place) AS last, arg_max(cur_s, place) AS last_s
  FROM run JOIN ori ON ori.read_id = cur AND ori.strand = cur_s JOIN cut i ON i.n = cur AND i.ns = 1 - cur_s JOIN cut o ON o.n = cur AND o.ns = cur_s GROUP BY start, start_s),
unitigs AS (SELECT least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS seq, CAST(length(s) AS BIGINT) AS length FROM spelled WHERE (start < last OR (start = last AND start_s <= 1 - last_s)) AND length(s) > {L})"""

_PATTERNS = ["ACGT", "AAAAA", "GATTACA", "TTTTTTTTTT"]
_PAT_SQL = "pats AS (SELECT unnest(['" + "', '".join(_PATTERNS) + "']) AS pattern)"


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string")


def _with(sql: str, select: str) -> str:
    return f"WITH RECURSIVE {sql} {select}"


def _of(name: str, f):
    return lambda spark, sf_dir: f(stage(spark, sf_dir, name))


def _graph(spark: SparkSession, sf_dir: str, fixture: str = "base") -> clean.Graph:
    if fixture in HAND:
        counts, edges = hand(spark, fixture)
        edges = written(edges)
        return clean.start(written(graph.nodes(counts, edges)), edges, *HAND[fixture][:2])
    return clean.start(stage(spark, sf_dir, "nodes", fixture), stage(spark, sf_dir, "edges", fixture), L, T)


def _paths(g: clean.Graph) -> DataFrame:
    return written(paths.paths(g.nodes, g.edges, g.read_len))


def _stages(*names: str):
    """f(spark's stages) as a query."""
    return lambda f: lambda spark, sf_dir: f(*[stage(spark, sf_dir, n) for n in names])


def _tips_pass(spark, sf_dir):
    config = AssemblyConfig(L, T)
    tips = clean.tip_paths(stage(spark, sf_dir, "paths"), _graph(spark, sf_dir).tails, L)
    return clean.removable_tips(tips, config.tip_limit, config.tip_limit).select("n", "ns", "d", "ds", "end", "tip_len", "tip_bp")


def _bubbles(spark, sf_dir, fixture):
    return clean.judged_bubbles(_graph(spark, sf_dir, fixture), stage(spark, sf_dir, "paths", fixture), 10).select("n", "ns", "d", "ds", "len", "match", F.round("depth", 6).alias("depth"), "b_len", "thin", "longer_sibling", "removed")


_LIMIT = AssemblyConfig(L, T).tip_limit
#: Limit of tips, and schedule of their lengths, on the hand-built graphs.
_HAND_TIPS = 8, [1, 2, 3, 4, 6]


_graphs: dict[tuple, clean.Graph] = {}


def _after(fixture, *steps):
    """The graph of a fixture after cleaning steps; kept for the session, as the written tables are."""

    def run(spark, sf_dir):
        key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, fixture, steps)
        if key not in _graphs:
            if not steps:
                _graphs[key] = _graph(spark, sf_dir, fixture)
            elif steps[-1] == "tips" and fixture in HAND:
                _graphs[key] = clean.remove_tips(_after(fixture, *steps[:-1])(spark, sf_dir), *_HAND_TIPS)
            else:
                config = AssemblyConfig(HAND[fixture][0] * 5, HAND[fixture][1] * 3) if fixture in HAND else AssemblyConfig(L, T)
                _graphs[key] = cleaned(_after(fixture, *steps[:-1])(spark, sf_dir), steps[-1], config)
        return _graphs[key]

    return run


def _contigs(spark, sf_dir):
    g, c = _after("base", *STEPS)(spark, sf_dir), AssemblyConfig(L, T)
    g, offsets = clean.trim_dead_ends(g, c.tip_limit)
    return contigs.spell(g.nodes, g.edges, stage(spark, sf_dir, "reads"), L, offsets, c.contig_limit)


def _walk(spark, sf_dir, fixture, limit):
    gone, offsets = clean.dead_end_walk(_after(fixture, "tips")(spark, sf_dir), limit)
    gone = gone.select("read_id", F.lit(-1).cast("long").alias("side"), F.lit(-1).cast("long").alias("offset"))
    return gone.unionByName(offsets.select("read_id", *_long("side", "offset")))


def _hand_votes(spark, sf_dir):
    each = [clean.junction_votes(g, _paths(g), 10).select(F.lit(name).alias("graph"), *_long(*_EL, "votes", "opposite"), "removed") for name in ("thin", "longer") for g in [_graph(spark, sf_dir, name)]]
    return each[0].unionByName(each[1])


def _hand_left(*names, step):
    def run(spark, sf_dir):
        each = [_edges_of(_after(name, step)(spark, sf_dir)).select(F.lit(name).alias("graph"), *_long(*_EL)) for name in names]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out

    return run


def _audit(spark, sf_dir):
    """stage and read_id of each read that a stage removes."""
    graphs = [_after("haplotypes", *STEPS[:k])(spark, sf_dir) for k in range(len(STEPS) + 1)]
    graphs.append(clean.trim_dead_ends(graphs[-1], _LIMIT)[0])
    out = None
    for k, step in enumerate((*STEPS, "dead ends")):
        one = removed_by(f"{k + 1} {step}", graphs[k], graphs[k + 1])
        out = one if out is None else out.unionByName(one)
    return out


def _fasta(spark, sf_dir):
    """The fixture's raw reads as FASTA, written once, as read back."""
    path = f"{shared_dir(spark)}/reads-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}.fa"
    lines = stage(spark, sf_dir, "raw").orderBy("file_ord").select(F.concat(F.lit(">read "), "file_ord", F.lit("\n"), "seq").alias("value"))
    lines.write.mode("overwrite").text(path)
    return path


def _fasta_contigs(spark, sf_dir):
    return assemble(read_fasta(spark, _fasta(spark, sf_dir), L), AssemblyConfig(L, T)).contigs


def _contig_lines(spark, sf_dir):
    path = f"{shared_dir(spark)}/contigs-{uuid.uuid4().hex}"
    write_fasta(_unitigs(spark, sf_dir), path)
    return spark.read.text(path)


def _dump(cands, reads_, edges):
    """Candidate counts of each read before reduction, and its edges before cleaning; reads without edges stand alone."""
    kinds = edges.select(F.col("n").alias("read_id"), "d", F.col("k").cast("long").alias("k"), edge_type(F.col("ns"), F.col("ds")).alias("type"))
    return overlap.candidate_counts(cands, reads_).select("read_id", *_long("olp_b", "olp_f")).join(growing(kinds), "read_id", "left").select("read_id", "olp_b", "olp_f", F.coalesce("d", F.lit(-1)).alias("d"), F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("type", F.lit("")).alias("type"))


def _unitigs(spark, sf_dir):
    return contigs.spell(stage(spark, sf_dir, "nodes"), stage(spark, sf_dir, "edges"), stage(spark, sf_dir, "reads"), L)


def _edges_of(g):
    return g.edges.select("n", "ns", "d", "ds", "k")


_long = lambda *cols: [F.col(c).cast("long").alias(c) for c in cols]
_E = "n, CAST(ns AS BIGINT) AS ns, d, CAST(ds AS BIGINT) AS ds, CAST(k AS BIGINT) AS k"
_EL = ("n", "ns", "d", "ds", "k")

QUERIES = {
    "reads_raw_stats": _of("raw", lambda r: r.agg(F.count(F.lit(1)).alias("n_reads"), F.min(F.length("seq")).cast("long").alias("min_len"), F.max(F.length("seq")).cast("long").alias("max_len"))),
    "reads_valid": _of("raw", lambda r: r.where(is_legal(F.col("seq")) & (F.length("seq") == L)).select("file_ord", "seq")),
    "reads_drop_n": _of("raw", reads.drop_n),
    "reads_dedup": _of("raw", lambda r: reads.dedup_exact(reads.drop_n(r))),
    "reads_ids": _of("reads", lambda r: r),
    "import_metrics": _stages("raw", "reads")(reads.import_metrics),
    "base_histogram": _of("reads", reads.base_histogram),
    "cumulative_c_table": _of("reads", reads.cumulative_counts),
    "first_last_base": _of("reads", reads.first_last_base),
    "reverse_complement": _of("reads", lambda r: r.select("read_id", rc(F.col("seq")).alias("seq"))),
    "canonical_reads": _of("reads", lambda r: r.select("read_id", canonical(F.col("seq")).alias("seq"))),
    "oriented_reads": _of("reads", lambda r: reads.oriented(r).select("read_id", *_long("strand"), "seq")),
    "kmer_count": _of("reads", lambda r: search.kmer_count(r, 9)),
    "substring_count": lambda spark, d: search.count(stage(spark, d, "reads"), _patterns(spark)),
    "substring_locate": lambda spark, d: search.locate(stage(spark, d, "reads"), _patterns(spark)).select("pattern", "read_id", *_long("pos")),
    "suffix_rank": _of("reads", lambda r: search.suffix_rank(r).select("read_id", *_long("pos", "rank"))),
    **{f"overlap_{t}": (lambda t: _of("cands", lambda c: overlap.overlaps_of_type(c, t.upper()).select("n", "d", *_long("k"))))(t) for t in ("fb", "ff", "bb", "bf")},
    "overlap_counts": _stages("cands", "reads")(lambda c, r: overlap.candidate_counts(c, r).select("read_id", *_long("olp_b", "olp_f"))),
    "edges_reduced": _of("edges", lambda e: e.select(*_long(*_EL))),
    "edge_support": _stages("edges", "cands")(lambda e, c: overlap.edge_support(e, c).select(*_long(*_EL, "support"))),
    "edge_type_histogram": _of("edges", lambda e: e.groupBy(edge_type(F.col("ns"), F.col("ds")).alias("type")).agg(F.count(F.lit(1)).alias("n_edges"))),
    "average_overlap": _of("edges", lambda e: graph.average_overlap(e).select(F.round("average_overlap", 6).alias("average_overlap"))),
    "side_degrees": _of("nodes", lambda n: n.select("read_id", *_long("deg_b", "deg_f"))),
    "side_types": _of("nodes", lambda n: n.select("read_id", "b_type", "f_type")),
    "suspect_nodes": _of("nodes", lambda n: n.where("suspect").select("read_id")),
    "junction_nodes": _of("nodes", lambda n: n.where(graph.is_junction()).select("read_id")),
    "isolated_reads": _of("nodes", lambda n: n.where(graph.is_isolated()).select("read_id")),
    "max_overlap_per_side": _of("edges", lambda e: graph.max_overlap(e).select(*_long("n", "ns", "max_k"))),
    "missing_mirror": _of("edges", lambda e: graph.missing_mirror(e).select(*_long(*_EL))),
    "paths": _of("paths", lambda p: p.withColumn("hop", F.coalesce("hop", F.lit(-1))).select(*_long("n", "ns", "d", "ds", "k", "end", "end_s", "hop", "len", "end_len", "bubble_len"), "type")),
    "path_types": _of("paths", lambda p: p.groupBy("type").agg(F.count(F.lit(1)).alias("n_paths"), F.max("len").alias("longest"))),
    "tips_pass1": lambda s, d: _tips_pass(s, d).select(*_long("n", "ns", "d", "ds", "end", "tip_len", "tip_bp")),
    "bubbles_pass1": lambda s, d: _bubbles(s, d, "haplotypes").select(*_long("n", "ns", "d", "ds", "len", "match"), "depth", *_long("b_len"), "thin", "longer_sibling", "removed"),
    "bubble_siblings": lambda s, d: clean.bubble_siblings(stage(s, d, "paths", "haplotypes"), 10).select(*_long("n", "ns", "end", "end_s", "d", "ds", "len", "sib_d", "sib_ds", "sib_len")),
    "bridges": lambda s, d: (lambda g: clean.bridges(g.nodes, _paths(g)))(_graph(s, d, "bridges")),
    "bridges_removed": _hand_left("bridges", step="bridges"),
    "junction_votes": _hand_votes,
    "junctions_fixpoint": _hand_left("thin", "longer", step="junctions"),
    "tips_hand_graph": _hand_left("tips", step="tips"),
    "tip_tails": lambda s, d: _after("tips", "tips")(s, d).tails.select(*_long("n", "ns", "tail_nodes", "tail_bp")),
    "dead_end_walk": lambda s, d: _walk(s, d, "base", _LIMIT),
    "dead_ends_hand_graph": lambda s, d: _walk(s, d, "tips", 4),
    "tips_fixpoint": lambda s, d: _edges_of(_after("base", "tips")(s, d)).select(*_long(*_EL)),
    "bubbles_fixpoint": lambda s, d: _edges_of(_after("haplotypes", "bubbles")(s, d)).select(*_long(*_EL)),
    "cleaned_graph": lambda s, d: _edges_of(_after("haplotypes", *STEPS)(s, d)).select(*_long(*_EL)),
    "cleaning_audit": _audit,
    "branch_split": lambda s, d: contigs.branch_split(stage(s, d, "nodes").where("deg_b + deg_f > 0"), stage(s, d, "edges")),
    "unitigs": lambda s, d: contigs.canonical_set(_unitigs(s, d)),
    "unitig_stats": lambda s, d: contigs.contig_stats(_unitigs(s, d)),
    "contigs": _contigs,
    "contig_stats": lambda s, d: contigs.contig_stats(_contigs(s, d)),
    "contig_reads": lambda s, d: contigs.contig_reads(stage(s, d, "nodes"), stage(s, d, "edges"), stage(s, d, "reads"), L).select("contig_id", "place", "read_id", *_long("strand")),
    "fasta_record_count": lambda s, d: record_count(s, _fasta(s, d)),
    "fasta_reads": lambda s, d: read_fasta(s, _fasta(s, d), L),
    "fasta_to_contigs": _fasta_contigs,
    "fasta_contig_lines": _contig_lines,
    "overlap_dump": _stages("cands", "reads", "edges")(_dump),
    "bwt": _of("reads", lambda r: search.bwt(r).select("rank", "symbol")),
    "occ_table": _of("reads", lambda r: search.occ(search.bwt(r)).select("block", "base", "n_before")),
    "missing_mirror_cut": _of("edges", lambda e: graph.missing_mirror(e.where("not (n % 97 = 3 and ns = 0)")).select(*_long(*_EL))),
    "bloom_dedup": _of("raw", lambda r: reads.dedup_bloom(reads.drop_n(r))),
}

_T = {"fb": (0, 0), "ff": (0, 1), "bb": (1, 0), "bf": (1, 1)}
_SIB = f"""SELECT p.n, CAST(p.ns AS BIGINT) AS ns, p."end", CAST(p.end_s AS BIGINT) AS end_s, p.d, CAST(p.ds AS BIGINT) AS ds, p.len, q.d AS sib_d, CAST(q.ds AS BIGINT) AS sib_ds, q.len AS sib_len
FROM paths p JOIN paths q ON p.n = q.n AND p.ns = q.ns AND p."end" = q."end" AND p.end_s = q.end_s WHERE p.type = 'BUBBLE' AND q.type = 'BUBBLE' AND q.len > p.len + 10"""

#: Limit, schedule, and passes written out in SQL: the fixtures need fewer.
_TIPS = _LIMIT, AssemblyConfig(L, T).tip_schedule, 8
_VOTES = "SELECT '{}' AS graph, n, CAST(ns AS BIGINT) AS ns, d, CAST(ds AS BIGINT) AS ds, CAST(k AS BIGINT) AS k, votes, opposite, removed FROM {}"
_BWT = f""", s AS (SELECT row_number() OVER (ORDER BY substr(seq, CAST(i + 1 AS BIGINT)), read_id, i) - 1 AS rank, CASE i WHEN 0 THEN '$' ELSE substr(seq, CAST(i AS BIGINT), 1) END AS symbol FROM reads, (SELECT unnest(range(0, {L})) AS i)),
b AS MATERIALIZED (SELECT rank, symbol FROM s) """


def _on(fixture: str, select) -> str:
    """The SQL of select(Cleaning over the fixture), which may add to its CTEs."""
    if fixture in HAND:
        c = Cleaning(hand_sql(fixture), *HAND[fixture][:2])
    else:
        tables = _NODES if fixture == "base" else _NODES.replace(RAW_SQL, HAPLOTYPES_SQL)
        c = Cleaning(tables + ",\nedges0 AS MATERIALIZED (SELECT n, ns, d, ds, k FROM edges),\nalive0 AS MATERIALIZED (SELECT read_id, suspect FROM nodes)", L, T)
    return c.sql(select(c))


def _left(c: Cleaning, name: str) -> str:
    return f"SELECT '{name}' AS graph, {_E} FROM edges{c.i}"


def _ends(c: Cleaning, limit: int) -> str:
    gone, offsets = c.dead_ends(limit)
    return f'SELECT read_id, CAST(-1 AS BIGINT) AS side, CAST(-1 AS BIGINT) AS "offset" FROM {gone} UNION ALL SELECT read_id, side, off FROM {offsets}'


def _all(c: Cleaning) -> list[tuple[str, int]]:
    """All steps on c: (step, generation after it)."""
    out = []
    for step, run in zip(STEPS, (lambda: c.tips(*_TIPS), lambda: c.bubbles(10, 4), c.bridges, lambda: c.bubbles(10, 1), lambda: c.junctions(10, 1)), strict=True):
        run()
        out.append((step, c.i))
    return out


def _spans(c: Cleaning) -> list[tuple[str, int, int]]:
    """(stage, generation before, generation after) of all steps and the trim."""
    ends = _all(c)
    c.trim(_LIMIT)
    ends.append(("dead ends", c.i))
    return [(f"{k + 1} {name}", ends[k - 1][1] if k else 0, i) for k, (name, i) in enumerate(ends)]


def _contig_select(c: Cleaning) -> str:
    _all(c)
    c.trim(_LIMIT)
    return f"SELECT contig_id, seq, length FROM {c.spelled(2 * L, 'offsets')}"


ORACLES = {
    "reads_raw_stats": _with(RAW_SQL, "SELECT count(*) AS n_reads, min(length(seq)) AS min_len, max(length(seq)) AS max_len FROM raw"),
    "reads_valid": _with(RAW_SQL, f"SELECT file_ord, seq FROM raw WHERE regexp_full_match(seq, '[ACGTN]+') AND length(seq) = {L}"),
    "reads_drop_n": _with(RAW_SQL, "SELECT file_ord, seq FROM raw WHERE seq NOT LIKE '%N%'"),
    "reads_dedup": _with(_KEPT, "SELECT file_ord, seq FROM reads"),
    "reads_ids": _with(_KEPT, "SELECT read_id, file_ord, seq FROM reads"),
    "import_metrics": _with(_KEPT, "SELECT n_raw, n_with_n, n_raw - n_with_n - n_kept AS n_duplicate, n_kept FROM (SELECT count(*) AS n_raw, count(*) FILTER (seq LIKE '%N%') AS n_with_n FROM raw), (SELECT count(*) AS n_kept FROM reads)"),
    "base_histogram": _with(_KEPT, "SELECT base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM reads) GROUP BY base"),
    "cumulative_c_table": _with(_KEPT, "SELECT base, CAST(coalesce(sum(n) OVER (ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM (SELECT base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM reads) GROUP BY base)"),
    "first_last_base": _with(_KEPT, "SELECT 'first' AS side, substr(seq, 1, 1) AS base, count(*) AS n FROM reads GROUP BY 1, 2 UNION ALL SELECT 'last', right(seq, 1), count(*) FROM reads GROUP BY 1, 2"),
    "reverse_complement": _with(_KEPT, "SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM reads"),
    "canonical_reads": _with(_KEPT, "SELECT read_id, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) AS seq FROM reads"),
    "oriented_reads": _with(_ORI, "SELECT read_id, CAST(strand AS BIGINT) AS strand, seq FROM ori"),
    "kmer_count": _with(_KEPT, f"SELECT substr(seq, CAST(i AS BIGINT), 9) AS kmer, count(*) AS n FROM reads, (SELECT unnest(range(1, {L - 9 + 2})) AS i) GROUP BY 1"),
    "substring_count": _with(f"{_KEPT}, {_PAT_SQL}", f"SELECT pattern, count(read_id) AS n FROM pats LEFT JOIN (SELECT read_id, substr(seq, CAST(i AS BIGINT)) AS s FROM reads, (SELECT unnest(range(1, {L + 1})) AS i)) ON starts_with(s, pattern) GROUP BY pattern"),
    "substring_locate": _with(f"{_KEPT}, {_PAT_SQL}", f"SELECT pattern, read_id, i - 1 AS pos FROM pats JOIN (SELECT read_id, i, substr(seq, CAST(i AS BIGINT)) AS s FROM reads, (SELECT unnest(range(1, {L + 1})) AS i)) ON starts_with(s, pattern)"),
    "suffix_rank": _with(_KEPT, f"SELECT read_id, i AS pos, row_number() OVER (ORDER BY substr(seq, CAST(i + 1 AS BIGINT)), read_id, i) - 1 AS rank FROM reads, (SELECT unnest(range(0, {L})) AS i)"),
    **{f"overlap_{t}": _with(_CAND, f"SELECT n, d, k FROM cands WHERE ns = {a} AND ds = {b}") for t, (a, b) in _T.items()},
    "overlap_counts": _with(_CAND, "SELECT read_id, count(n) FILTER (ns = 1) AS olp_b, count(n) FILTER (ns = 0) AS olp_f FROM reads LEFT JOIN cands ON n = read_id GROUP BY read_id"),
    "edges_reduced": _with(_EDGES, f"SELECT {_E} FROM edges"),
    "edge_support": _with(_EDGES, "SELECT c.n, CAST(c.ns AS BIGINT) AS ns, c.d, CAST(c.ds AS BIGINT) AS ds, c.k, count(*) AS support FROM edges e JOIN cands c USING (n, ns, d, ds, k) JOIN cands o ON o.n = c.n AND o.ns = c.ns AND starts_with(o.ext, c.ext) GROUP BY ALL"),
    "edge_type_histogram": _with(_EDGES, "SELECT CASE WHEN ns = 0 AND ds = 0 THEN 'FB' WHEN ns = 0 THEN 'FF' WHEN ds = 0 THEN 'BB' ELSE 'BF' END AS type, count(*) AS n_edges FROM edges GROUP BY 1"),
    "average_overlap": _with(_EDGES, "SELECT round(avg(k), 6) AS average_overlap FROM edges"),
    "side_degrees": _with(_NODES, "SELECT read_id, deg_b, deg_f FROM nodes"),
    "side_types": _with(_NODES, "SELECT read_id, b_type, f_type FROM nodes"),
    "suspect_nodes": _with(_NODES, "SELECT read_id FROM nodes WHERE suspect"),
    "junction_nodes": _with(_NODES, f"SELECT read_id FROM nodes WHERE {_J}"),
    "isolated_reads": _with(_NODES, "SELECT read_id FROM nodes WHERE deg_b = 0 AND deg_f = 0"),
    "max_overlap_per_side": _with(_EDGES, "SELECT n, CAST(ns AS BIGINT) AS ns, max(k) AS max_k FROM edges GROUP BY n, ns"),
    "missing_mirror": _with(_EDGES, f"SELECT {_E} FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges m WHERE m.n = e.d AND m.ns = 1 - e.ds AND m.d = e.n AND m.ds = 1 - e.ns AND m.k = e.k)"),
    "paths": _with(_PATHS, 'SELECT n, CAST(ns AS BIGINT) AS ns, d, CAST(ds AS BIGINT) AS ds, CAST(k AS BIGINT) AS k, "end", CAST(end_s AS BIGINT) AS end_s, coalesce(hop, -1) AS hop, len, end_len, bubble_len, type FROM paths'),
    "path_types": _with(_PATHS, "SELECT type, count(*) AS n_paths, max(len) AS longest FROM paths GROUP BY type"),
    "tips_pass1": _with(_PATHS, f'SELECT n, CAST(ns AS BIGINT) AS ns, d, CAST(ds AS BIGINT) AS ds, "end", len AS tip_len, end_len - ({L} - k) AS tip_bp FROM paths WHERE type = \'TIP\' AND end_len - ({L} - k) < {2 * L} AND len <= {2 * L}'),
    "bubbles_pass1": _on("haplotypes", lambda c: f"SELECT n, CAST(ns AS BIGINT) AS ns, d, CAST(ds AS BIGINT) AS ds, len, CAST(match AS BIGINT) AS match, round(depth, 6) AS depth, CAST(b_len AS BIGINT) AS b_len, thin, longer_sibling, b_len < {L} AND match < {T} AND (thin OR longer_sibling) AS removed FROM {c.arms(10)}"),
    "bubble_siblings": _on("haplotypes", lambda c: _SIB.replace("paths ", c.paths() + " ")),
    "bridges": _on("bridges", lambda c: f"SELECT read_id FROM {c.bridge_reads()}"),
    "bridges_removed": _on("bridges", lambda c: _left(c.bridges(), "bridges")),
    "tips_hand_graph": _on("tips", lambda c: _left(c.tips(*_HAND_TIPS, 8), "tips")),
    "tip_tails": _on("tips", lambda c: f"SELECT n, CAST(ns AS BIGINT) AS ns, CAST(tail_nodes AS BIGINT) AS tail_nodes, CAST(tail_bp AS BIGINT) AS tail_bp FROM {c.tips(*_HAND_TIPS, 8).tails}"),
    "junction_votes": _on("thin", lambda c: _VOTES.format("thin", c.votes(10))) + " UNION ALL SELECT * FROM (" + _on("longer", lambda c: _VOTES.format("longer", c.votes(10))) + ")",
    "junctions_fixpoint": _on("thin", lambda c: _left(c.junctions(10, 3), "thin")) + " UNION ALL SELECT * FROM (" + _on("longer", lambda c: _left(c.junctions(10, 3), "longer")) + ")",
    "dead_end_walk": _on("base", lambda c: _ends(c.tips(*_TIPS), _LIMIT)),
    "dead_ends_hand_graph": _on("tips", lambda c: _ends(c.tips(*_HAND_TIPS, 8), 4)),
    "tips_fixpoint": _on("base", lambda c: f"SELECT {_E} FROM edges{c.tips(*_TIPS).i}"),
    "bubbles_fixpoint": _on("haplotypes", lambda c: f"SELECT {_E} FROM edges{c.bubbles(10, 4).i}"),
    "cleaned_graph": _on("haplotypes", lambda c: f"SELECT {_E} FROM edges{_all(c)[-1][1]}"),
    "cleaning_audit": _on("haplotypes", lambda c: " UNION ALL ".join(f"SELECT '{name}' AS stage, read_id FROM alive{a} WHERE read_id NOT IN (SELECT read_id FROM alive{b})" for name, a, b in _spans(c))),
    "contigs": _on("base", _contig_select),
    "contig_stats": _on("base", lambda c: f"SELECT count(*) AS n_contigs, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_length, coalesce(max(length), 0) AS longest FROM ({_contig_select(c)})"),
    "contig_reads": _on("base", lambda c: f"SELECT contig_id, place, cur AS read_id, CAST(cur_s AS BIGINT) AS strand FROM {c.spelled(0, None)} JOIN run USING (start, start_s)"),
    "fasta_record_count": _with(RAW_SQL, "SELECT count(*) AS n_records FROM raw"),
    "fasta_reads": _with(RAW_SQL, "SELECT file_ord, 'read ' || file_ord AS header, seq FROM raw"),
    "fasta_to_contigs": _on("base", _contig_select),
    "fasta_contig_lines": _on("base", lambda c: f"SELECT unnest(['>contig ' || contig_id, seq]) AS value FROM {c.spelled(0, None)}"),
    "overlap_dump": _with(_EDGES, """SELECT read_id, olp_b, olp_f, coalesce(d, -1) AS d, coalesce(k, -1) AS k, CASE WHEN ns IS NULL THEN '' WHEN ns = 0 AND ds = 0 THEN 'FB' WHEN ns = 0 THEN 'FF' WHEN ds = 0 THEN 'BB' ELSE 'BF' END AS type
FROM (SELECT read_id, count(n) FILTER (ns = 1) AS olp_b, count(n) FILTER (ns = 0) AS olp_f FROM reads LEFT JOIN cands ON n = read_id GROUP BY read_id) LEFT JOIN edges ON n = read_id"""),
    "bwt": _with(_KEPT, _BWT + "SELECT rank, symbol FROM b"),
    "occ_table": _with(_KEPT, _BWT + "SELECT block, base, CAST((SELECT count(*) FROM b WHERE symbol = base AND rank < block * 4096) AS BIGINT) AS n_before FROM (SELECT DISTINCT rank // 4096 AS block FROM b), (VALUES ('A'), ('C'), ('G'), ('T')) v(base)"),
    "missing_mirror_cut": _with(_EDGES, f"SELECT {_E} FROM edges e WHERE NOT (n % 97 = 3 AND ns = 0) AND EXISTS (SELECT 1 FROM edges m WHERE m.n = e.d AND m.ns = 1 - e.ds AND m.d = e.n AND m.ds = 1 - e.ns AND m.k = e.k AND m.n % 97 = 3 AND m.ns = 0)"),
    "branch_split": _with(_SPLIT, "SELECT n AS read_id, max(e) FILTER (ns = 1) AS b_end, max(e) FILTER (ns = 0) AS f_end FROM ends GROUP BY n"),
    "unitigs": _with(_UNITIGS, "SELECT seq, length FROM unitigs"),
    "unitig_stats": _with(_UNITIGS, "SELECT count(*) AS n_contigs, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_length, coalesce(max(length), 0) AS longest FROM unitigs"),
}
