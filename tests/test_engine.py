"""Operators of the assembly against SQL, hand cases and a direct model."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from readweave import AssemblyConfig, assemble, cli
from readweave.functions.alphabet import canonical, rc
from readweave.operators import clean, contigs, graph, overlap, paths, reads
from readweave.plans import queries as Q
from readweave.sources.fasta import FastaDataSource, FastaError, _Reader, read_fasta, record_count, write_fasta
from readweave.streaming import ingest

SF = "/root/testdata/sf0.001"


def _rows(table, columns):
    return sorted(repr([round(float(v), 6) if not isinstance(v, (str, bool)) and v is not None else v for v in r]) for r in table[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours, theirs = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert _rows(ours, columns) == _rows(theirs, columns)


#: Queries that failed by the driver's memory: a side that grows was broadcast.
GROWING = (
    "substring_count", "substring_locate", "overlap_bb", "overlap_bf", "overlap_dump", "overlap_fb", "overlap_ff", "edge_support", "missing_mirror", "missing_mirror_cut", "side_degrees", "suspect_nodes", "average_overlap", "edge_type_histogram", "path_types", "paths", "branch_split", "unitig_stats", "contig_reads", "tips_fixpoint", "dead_end_walk", "contigs", "contig_stats",
)


@pytest.mark.parametrize("name", GROWING)
def test_only_bounded_tables_are_broadcast(spark, name):
    plans = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = plans().last().executionId() if plans().nonEmpty() else -1
    # Another path: no stage is there yet from other tests.
    Q.QUERIES[name](spark, f"{SF}/").collect()
    ran = [plans().apply(i) for i in range(plans().size())]
    text = "\n".join(x.physicalPlanDescription() for x in ran if x.executionId() > before)
    keys = {k for found in re.findall(r"Broadcast\w+Join\b[^\n]*\nLeft keys[^\[]*\[\d+\]: \[([^\]]*)\]", text) for k in re.sub(r"#\d+L?", "", found).split(", ")}
    # Counts of chunks of ids, and the patterns of substring_locate.
    assert keys <= {"_c", "chunk", "pattern"}
    assert not re.search(r"BroadcastExchange[^\n]*\n[ :|+\-]*(\*? ?\w+ \(\d+\)[ \n:|+\-]*)*Generate", text)


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def model(seqs, t):
    """Candidates and irreducible edges by comparing all pairs."""
    L = len(seqs[0])
    o = {(i, s): q if s == 0 else turned(q) for i, q in enumerate(seqs) for s in (0, 1)}
    cands = {(n, ns, d, ds, k, b[k:]) for (n, ns), a in o.items() for (d, ds), b in o.items() for k in range(t, L) if a[L - k :] == b[:k]}
    edges = set()
    for n, ns, d, ds, k, ext in cands:
        same = [c for c in cands if c[:2] == (n, ns)]
        if n != d and not any((c[4] > k and ext.startswith(c[5])) or (c[2] == d and c[4] == k and c[5] == ext and ds != ns and c[3] == ns) for c in same):
            edges.add((n, ns, d, ds, k))
    return cands, edges


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_match_all_pairs(spark, seed):
    rnd = random.Random(seed)
    pool = ["ACG" * 6, "AT" * 9, "".join(rnd.choice("ACGT") for _ in range(60))]
    seqs, seen = [], set()
    while len(seqs) < 14:
        p = rnd.choice(pool)
        at = rnd.randrange(0, len(p) - 13)
        s = p[at : at + 14]
        s = turned(s) if rnd.random() < 0.5 else s
        if min(s, turned(s)) not in seen:
            seen.add(min(s, turned(s)))
            seqs.append(s)
        elif rnd.random() < 0.3:
            pool.append("".join(rnd.choice("ACGT") for _ in range(40)))
    table = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    found = overlap.candidates(reads.oriented(table), 14, 5)
    cands, edges = model(seqs, 5)
    assert {tuple(r) for r in found.collect()} == cands
    assert {tuple(r) for r in overlap.reduced(found).collect()} == edges
    assert graph.missing_mirror(overlap.reduced(found)).count() == 0


def test_reads(spark):
    raw = spark.createDataFrame([(0, "ACGTT"), (1, "AACGT"), (2, "ACGNT"), (3, "ACGTT"), (4, "CCCCC")], "file_ord long, seq string")
    kept = reads.assign_ids(reads.dedup_exact(reads.drop_n(raw)))
    assert sorted(map(tuple, kept.collect())) == [(0, 0, "ACGTT"), (1, 4, "CCCCC")]
    assert tuple(reads.import_metrics(raw, kept).first()) == (5, 1, 2, 2)
    assert {r.seq for r in reads.dedup_bloom(reads.drop_n(raw)).collect()} <= {"ACGTT", "CCCCC"}
    assert raw.where("file_ord = 0").select(rc(F.col("seq")), canonical(F.col("seq"))).first()[:] == ("AACGT", "AACGT")


def _hand(spark, edges, suspect=()):
    both = {e for n, ns, d, ds, k in edges for e in ((n, ns, d, ds, k), (d, 1 - ds, n, 1 - ns, k))}
    ids = sorted({e[0] for e in both})
    e = spark.createDataFrame(sorted(both), "n long, ns int, d long, ds int, k int")
    about = spark.createDataFrame([(i, 10 if i in suspect else 1, 1) for i in ids], "read_id long, olp_b long, olp_f long")
    return clean.start(graph.nodes(about, e), e, 10, 5)


def chain(*ids, k=8):
    return [(a, 0, b, 0, k) for a, b in zip(ids, ids[1:])]


def test_tip_goes(spark):
    g = _hand(spark, [*chain(*range(12)), (5, 0, 50, 0, 7)])
    out = clean.remove_tips(g, 20, [1, 2, 3])
    assert {r.n for r in out.edges.collect()} == set(range(12))
    p = paths.paths(g.nodes, g.edges, 10)
    assert {(r.d, r.type) for r in p.collect()} >= {(50, "TIP")}


def test_tails_of_removed_tips(spark):
    # 60 and 61 go from 51, whose branch from 5 then counts as two bases longer and stays.
    g = _hand(spark, [*chain(*range(20)), (5, 0, 50, 0, 8), (50, 0, 51, 0, 8), (51, 0, 60, 0, 8), (51, 0, 61, 0, 8)])
    out = clean.remove_tips(g, 3, [1, 2, 3])
    assert {r.n for r in out.edges.collect()} == {*range(20), 50, 51}
    assert {(r.n, r.ns): (r.tail_nodes, r.tail_bp) for r in out.tails.collect()} == {(51, 0): (1, 2)}


def test_long_tips_leave_the_race(spark):
    # The tip of 20 bases is over a read long when it is first seen, so a later, greater length does not remove it.
    g = _hand(spark, [*chain(*range(40)), (9, 0, 50, 0, 5), *chain(50, 51, 52, 53, 54, k=5)])
    assert {r.n for r in clean.remove_tips(g, 40, [1, 3, 5, 7]).edges.collect()} >= {50, 54}
    assert not {r.n for r in clean.remove_tips(g, 40, [5, 7]).edges.collect()} & {50, 54}


def test_dead_ends_that_branch(spark):
    g = _hand(spark, [*chain(0, 1, 2, 3, 4, 5, 6), *chain(0, 11, 12, 13, 14, 15, 16)])
    gone, offsets = clean.dead_end_walk(g, 4)
    assert {r.read_id for r in gone.collect()} == {0, 1, 5, 6, 11, 15, 16}
    assert {tuple(r) for r in offsets.collect()} == {(2, 1, 6), (12, 1, 6), (4, 0, 6), (14, 0, 6)}
    gone, offsets = clean.dead_end_walk(g, 1)
    assert gone.count() == 0 and {tuple(r) for r in offsets.collect()} == {(0, 1, 10), (6, 0, 10), (16, 0, 10)}


def test_bubble_arms(spark):
    g = _hand(spark, [*chain(0, 1, 2), *chain(2, 10, 3, k=5), *chain(2, *range(20, 34), 3), *chain(3, 4, 5)])
    p = paths.paths(g.nodes, g.edges, 10)
    assert {(r.n, r.d, r.type) for r in p.where("n in (2, 3) and d in (10, 20, 33)").collect()} == {(2, 10, "BUBBLE"), (2, 20, "BUBBLE"), (3, 10, "BUBBLE"), (3, 33, "BUBBLE")}
    assert {(r.d, r.sib_d) for r in clean.bubble_siblings(p, 10).collect()} == {(10, 20), (10, 33)}
    judged = {(r.d, r.thin, r.longer_sibling, r.removed) for r in clean.judged_bubbles(g, p, 10).collect()}
    assert judged == {(10, True, True, True), (20, False, False, False), (33, False, False, False)}
    for best in (False, True):
        assert {r.n for r in clean.remove_bubbles(g, 10, keep_best_arm=best).edges.collect()} == {*range(6), *range(20, 34)}


def test_bloom_dedup_is_that_of_a_filter_filled_in_order(spark):
    mask = (1 << 32) - 1
    folds = [lambda h, c: h ^ ((h << 5) + (h >> 2) + c) & mask, lambda h, c: (c + (h << 6) + (h << 16) - h) & mask, lambda h, c: h + c, lambda h, c: h ^ c, lambda h, c: (33 * h + c) & mask]
    seqs = [_genome(10, seed=i % 350) for i in range(400)]
    table = spark.createDataFrame(list(enumerate(seqs)), "file_ord long, seq string")

    def places(s, n):
        for f in folds[:n]:
            h = 0
            for b in s:
                h = f(h, "ACGT".index(b) + 1)
            yield h % (6 * len(seqs))

    for n in (2, 5):
        bits, kept = set(), []
        for i, s in enumerate(seqs):
            if not (set(places(s, n)) <= bits or set(places(turned(s), n)) <= bits):
                bits |= set(places(s, n))
                kept.append(i)
        assert sorted(r.file_ord for r in reads.dedup_bloom(table, 6, n).collect()) == kept
        assert len(kept) < 350


def test_bridge(spark):
    edges = [*chain(0, 1, 2, 3), *chain(10, 11, 12, 13), (1, 0, 99, 0, 7), (99, 0, 12, 0, 7), (99, 0, 13, 0, 7)]
    g = _hand(spark, edges, suspect={99})
    assert [r.read_id for r in clean.bridges(g.nodes, paths.paths(g.nodes, g.edges, 10)).collect()] == []  # it has a tip at 13
    more = [*edges, *chain(13, 14, 15), *chain(3, 4)]
    g = _hand(spark, more, suspect={99})
    assert [r.read_id for r in clean.bridges(g.nodes, paths.paths(g.nodes, g.edges, 10)).collect()] == [99]
    assert {r.n for r in clean.remove_bridges(g).edges.collect()} == {*range(5), *range(10, 16)}
    g = _hand(spark, more)
    assert clean.bridges(g.nodes, paths.paths(g.nodes, g.edges, 10)).count() == 0


def test_ring_has_no_path_and_no_contig(spark):
    g = _hand(spark, [*chain(0, 1, 2, 3, 0)])
    table = spark.createDataFrame([(i, "ACGTACGTAC") for i in range(4)], "read_id long, seq string")
    assert paths.paths(g.nodes, g.edges, 10).count() == 0
    assert contigs.spell(g.nodes, g.edges, table, 10).count() == 0


def _genome(n, seed=1):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize("shuffle", [False, True])
def test_error_free_genome_comes_back(spark, shuffle):
    genome = _genome(600)
    seqs = [genome[i : i + 50] for i in range(0, 551, 3)]
    rows = [(i, turned(s) if i % 2 else s) for i, s in enumerate(seqs)]
    if shuffle:
        random.Random(3).shuffle(rows)
        rows = [(i, turned(r[1])) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(rows, "file_ord long, seq string")
    found = assemble(raw, AssemblyConfig(50, 31, trim_dead_ends=False))
    (one,) = found.contigs.collect()
    assert min(one.seq, turned(one.seq)) == min(genome[: one.length], turned(genome[: one.length]))
    assert one.length == len(seqs) * 3 - 3 + 50
    trimmed = assemble(raw, AssemblyConfig(50, 31)).contigs.collect()
    assert all(c.seq in genome or turned(c.seq) in genome for c in trimmed) and sum(c.length for c in trimmed) < one.length


def test_config():
    c = AssemblyConfig(50, 31)
    assert (c.tip_limit, c.contig_limit, c.tip_schedule) == (100, 100, [*range(1, 100, 5), 100])
    assert AssemblyConfig(50, 31, max_tiplen=9, num_iters=2).tip_schedule == [1, 5, 9]
    with pytest.raises(ValueError):
        AssemblyConfig(50, 9)
    with pytest.warns(UserWarning):
        assert AssemblyConfig(50, 31, max_tiplen=3, num_iters=9).tip_schedule == [1, 2, 3]


def _fasta(tmp_path, text):
    p = tmp_path / "in.fa"
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    good = _fasta(tmp_path, ">a\nACGTN\n>b\r\nacgtt")
    assert [tuple(r) for r in read_fasta(spark, good, 5).orderBy("file_ord").collect()] == [(0, "a", "ACGTN"), (1, "b", "ACGTT")]
    assert record_count(spark, good).first().n_records == 2
    spark.dataSource.register(FastaDataSource)
    assert spark.read.format("fasta").option("path", good).option("readlen", 5).load().count() == 2
    # Byte ranges of every size read each record once, and a stray line is found wherever a range begins.
    some, stray = tmp_path / "some.fa", tmp_path / "stray.fa"
    some.write_text("".join(f">read {k}\r\n{'ACGTN'[k % 5] * 5}\n" for k in range(9)))
    stray.write_text(">a\nACGTA\nACGTA\n>b\nACGTA\n")
    for size in (*range(1, 30), 1000):
        reader = _Reader({"path": str(some), "readlen": "5", "blockbytes": size})
        found = [r for p in reader.partitions() for r in reader.read(p)]
        assert [(h, s) for _, h, s in found] == [(f"read {k}", "ACGTN"[k % 5] * 5) for k in range(9)] and found == sorted(found)
        reader = _Reader({"path": str(stray), "readlen": "5", "blockbytes": size})
        with pytest.raises(FastaError):
            [list(reader.read(p)) for p in reader.partitions()]
    out = str(tmp_path / "out")
    write_fasta(spark.createDataFrame([(1, "CC"), (0, "AA")], "contig_id long, seq string"), out)
    assert [r.value for r in spark.read.text(out).collect()] == [">contig 0", "AA", ">contig 1", "CC"]


@pytest.mark.parametrize("text", ["ACGTT\n", ">a\n", ">a\nACG\n", ">a\nACGTX\n", ">a\nACG\nTT\n"])
def test_bad_fasta(spark, tmp_path, text):
    with pytest.raises(Exception, match="record|sequence|header"):
        read_fasta(spark, _fasta(tmp_path, text), 5).collect()


def test_fasta_keeps_order_over_files_and_blocks(spark, tmp_path):
    reads = [turned(_genome(20, seed=i)) for i in range(300)]
    folder = tmp_path / "many"
    folder.mkdir()
    for name, low, high in (("a", 0, 130), ("b", 130, 150), ("c", 150, 300)):
        (folder / f"{name}.fa").write_text("".join(f">r{i}\n{reads[i]}\n" for i in range(low, high)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "999b")
    try:
        rows = read_fasta(spark, str(folder), 20).orderBy("file_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.file_ord, r.header, r.seq) for r in rows] == [(i, f"r{i}", s) for i, s in enumerate(reads)]


def test_command_line(spark, tmp_path, capsys):
    genome = _genome(400, seed=2)
    text = "".join(f">r{i}\n{genome[i : i + 50]}\n" for i in range(0, 351, 3))
    out, dump = str(tmp_path / "contigs"), str(tmp_path / "dump")
    assert cli.main(["-l", "50", "-t", "31", "--singlereads", _fasta(tmp_path, text), "--out", out, "--keep-dead-ends", "--dump", dump]) == 0
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[0] == ">contig 0" and lines[1] in (genome[: len(lines[1])], turned(genome)[: len(lines[1])])
    assert spark.read.parquet(f"{dump}/reads").count() == 117 == spark.read.parquet(f"{dump}/counts").count()
    assert spark.read.parquet(f"{dump}/overlaps").count() >= 232 and spark.read.parquet(f"{dump}/audit").columns == ["stage", "read_id"]
    assert [r.place for r in spark.read.parquet(f"{dump}/members").orderBy("contig_id", "place").collect()] == list(range(117))
    assert "contigs: 1," in capsys.readouterr().out
    for wrong in (["-l", "50", "-t", "9", "--singlereads", "x"], ["-l", "50", "--singlereads", "x"], ["-l", "50", "-t", "31", "--singlereads", "x", "more"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)


def test_stream_of_reads(spark, tmp_path):
    stored = [(0, _genome(50, seed=4))]
    new = stored[0][1]
    genome = _genome(10, seed=5) + new
    arriving = [(10, genome[:50]), (11, turned(genome[:50])), (12, "N" * 50)]
    schema = "read_id long, file_ord long, seq string"
    spark.createDataFrame([(i, i, s) for i, s in arriving], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = ingest.overlaps_with(ingest.distinct_reads(source), spark.createDataFrame(stored, "read_id long, seq string"), 50, 31)
    query = found.writeStream.format("memory").queryName("stream_overlaps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("stream_overlaps").select("n", "ns", "d", "ds", "k").collect()
    # One of the two equal arriving reads stays; read either way, it overlaps the stored read by 40 bases.
    assert len({r.n for r in rows}) == 1 and {(r.d, r.ds, r.k) for r in rows} == {(0, 0, 40)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_steps_that_remove_nothing_walk_once(spark, monkeypatch):
    L, walks, edges = 50, [], [(i, 0, i + 1, 0, 40) for i in range(5)]
    both = spark.createDataFrame([*edges, *[(d, 1 - ds, n, 1 - ns, k) for n, ns, d, ds, k in edges]], "n long, ns int, d long, ds int, k int")
    nodes = graph.nodes(spark.createDataFrame([(i, 1, 1) for i in range(6)], "read_id long, olp_b long, olp_f long"), both)
    monkeypatch.setattr(clean, "chains", lambda *a, f=clean.chains: walks.append(1) or f(*a))
    g = clean.remove_tips(clean.start(nodes, both, L, 31), 100, [1, 2])
    g = clean.remove_junctions(clean.remove_bridges(clean.remove_bubbles(g, 10)), 10)
    assert g.edges.count() == 10 and len(walks) == 1
    # The trim takes the chain's ends; what is left is walked anew.
    g, _ = clean.trim_dead_ends(g, 15)
    assert len(walks) == 1 and g.chains().count() < nodes.count() * 2 and len(walks) == 2


def test_path_rounds_ask_no_query_of_their_own(spark):
    """The driver's memory grew with the queries of the rounds: one to write, and one to count what was written."""
    steps = spark.createDataFrame([(i, 0, i + 1, 0, 1) for i in range(40)], "x long, xs int, y long, ys int, bp int")
    last = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = last()
    walks = paths.doubled(steps)
    # One before the rounds, and one for each of the six in which walks of up to 40 steps end.
    assert last() - before <= 7
    assert sorted((r.x, r.y, r.steps) for r in walks.collect()) == [(i, 40, 40 - i) for i in range(40)]
    assert paths.doubled(steps.where("x < 0")).count() == 0


def test_shortlist_reduces_as_all_candidates_do(spark):
    rnd = random.Random(9)
    genomes = ["".join(rnd.choice("ACGT") for _ in range(60)), "ACG" * 15, "AT" * 20]
    genomes.append(genomes[0][:30] + turned(genomes[0][30:]))
    seqs = list({min(s, turned(s)): s for g in genomes for i in range(0, len(g) - 13, 2) for s in (g[i : i + 14],)}.values())
    table = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    found, (cands, edges) = overlap.candidates(reads.oriented(table), 14, 5), model(seqs, 5)
    short = overlap.shortlist(found)
    rows = {tuple(r) for r in short.drop("olp").collect()}
    assert rows < cands and len(rows) < len(cands) / 2
    assert {tuple(r) for r in overlap.reduced(short).collect()} == edges
    assert sorted(map(tuple, overlap.shortlist_counts(short, table).collect())) == sorted(map(tuple, overlap.candidate_counts(found, table).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_walks_in_one_task_are_those_of_rounds(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    ids, rows = iter(rnd.sample(range(1000), 200)), []
    for n in (1, 2, 3, 17, 40):
        walk = [(next(ids), rnd.randrange(2)) for _ in range(n + 1)]
        rows += [(*a, *b, rnd.randrange(1, 20)) for a, b in zip(walk, walk[1:])]
    for n in (1, 5):
        ring = [(next(ids), rnd.randrange(2)) for _ in range(n)]
        rows += [(*a, *b, 1) for a, b in zip(ring, ring[1:] + ring[:1])]
    steps = spark.createDataFrame(rnd.sample(rows, len(rows)), "x long, xs int, y long, ys int, bp int")
    queries = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = queries()
    one = paths.doubled(steps)
    # One to write the steps and one to walk; rounds of joins took one each.
    assert queries() - before <= 2
    monkeypatch.setattr(paths, "ONE_TASK", 0)
    rounds = paths.doubled(steps)
    assert one.schema == rounds.schema and len(rows) - 6 == one.count()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, rounds.collect()))


def test_bubbles_are_judged_once_on_a_graph_that_stays(spark, monkeypatch):
    judged = []
    monkeypatch.setattr(clean, "judged_bubbles", lambda *a, f=clean.judged_bubbles: judged.append(1) or f(*a))
    g = _hand(spark, [*chain(0, 1, 2), *chain(2, 10, 3, k=5), *chain(2, *range(20, 34), 3), *chain(3, 4, 5)])
    once = clean.remove_bubbles(g, 10)
    # Once to find the arm and once to find no other.
    assert len(judged) == 2
    assert clean.remove_bubbles(clean.remove_bridges(once), 10) is once and len(judged) == 2
    # Another length is another question, as is another graph.
    clean.remove_bubbles(once, 11)
    clean.remove_bubbles(clean.without(once, gone_nodes=spark.createDataFrame([(0,)], "read_id long")), 10)
    assert len(judged) == 4


def test_dedup_hashes_numbers_and_sorts_no_reads(spark):
    rows = [(3, "ACGTT"), (1, "AACGT"), (7, "GGGCA"), (2, "TGCCC"), (5, "ACGCA"), (5, "TGCGT"), (9, "ACGT"), (8, "ACGT")]
    raw = spark.createDataFrame(rows, "file_ord long, seq string")
    for table in (raw, raw.withColumn("turned", rc(F.col("seq")))):
        kept = reads.dedup_exact(table)
        # Of two forms under one number, which files do not have, the lesser stays.
        assert sorted(map(tuple, kept.collect())) == [(1, "AACGT"), (2, "TGCCC"), (5, "ACGCA"), (8, "ACGT")]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("n", [50, 700, 7919 + 49])
def test_reads_are_cut_where_their_numbers_say(spark, tmp_path, n):
    from readweave.plans import fixtures

    bases = _genome(n, seed=n)
    spark.createDataFrame([(i, "ACGT".index(b)) for i, b in enumerate(bases)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    other = "".join("CGTA"["ACGT".index(b)] if i % 400 == 200 else b for i, b in enumerate(bases))
    want = []
    for genome, cover, step, at in ((bases, 30, 7919, 0), (other, 8, 6007, 1000000)):
        for i in range(n * cover // 50):
            s = genome[(i * step) % (n - 49) :][:50]
            want.append((i + at, *((turned(s), s) if i % 2 else (s, turned(s)))))
    found = fixtures.haplotype_reads(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # No table of reads is dealt out to meet the genome.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
