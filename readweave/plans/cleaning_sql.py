"""SQL that states the cleaning passes: generation i of a graph is edges{i}, alive{i}, and what is derived from them.

Loops are written out for a number of passes; a pass that finds nothing leaves the graph as it is, so passes beyond the
fixpoint change nothing.
"""

from __future__ import annotations


class Cleaning:
    """CTEs of one graph after the other; `tables` begins with edges0 and alive0 (read_id, suspect)."""

    def __init__(self, tables: str, read_len: int, min_overlap: int):
        self.parts = [tables.strip()]
        self.L, self.t, self.i, self.walked = read_len, min_overlap, 0, -1
        self.parts.append("average AS MATERIALIZED (SELECT coalesce(avg(k), 0) AS a FROM edges0)")
        self.tails = "tails0"
        self.parts.append("tails0(n, ns, tail_nodes, tail_bp) AS MATERIALIZED (SELECT CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) WHERE false)")
        self._nodes()

    def add(self, name: str, sql: str) -> str:
        self.parts.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def sql(self, select: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + select

    def _nodes(self) -> None:
        i = self.i
        side = lambda c: f"CASE {c} WHEN 0 THEN 'ENDING' WHEN 1 THEN 'ONE' ELSE 'BRANCH' END"
        self.add(f"nodes{i}", f"""SELECT read_id, suspect, db, df, {side('db')} AS b, {side('df')} AS f FROM (
  SELECT read_id, suspect, count(n) FILTER (ns = 1) AS db, count(n) FILTER (ns = 0) AS df FROM alive{i} LEFT JOIN edges{i} ON n = read_id GROUP BY read_id, suspect)""")

    @property
    def junction(self) -> str:
        return "((b = 'BRANCH' AND f <> 'ENDING') OR (f = 'BRANCH' AND b <> 'ENDING'))"

    def paths(self) -> str:
        """paths{i}: paths out of junctions, and steps{i}: their inner reads, of the present generation."""
        i, L = self.i, self.L
        if self.walked == i:
            return f"paths{i}"
        self.walked = i
        self.add(f"walk{i}", f"""
  SELECT e.n, e.ns, e.d, e.ds, e.k, e.d AS cur, e.ds AS cur_s, CAST(NULL AS BIGINT) AS hop, CAST(1 AS BIGINT) AS len, CAST({L} - e.k AS BIGINT) AS end_len, CAST(0 AS BIGINT) AS bubble_len
  FROM edges{i} e JOIN nodes{i} ON e.n = read_id WHERE {self.junction}
  UNION ALL
  SELECT w.n, w.ns, w.d, w.ds, w.k, e.d, e.ds, w.cur, w.len + 1, w.end_len + {L} - e.k, w.end_len
  FROM walk{i} w JOIN nodes{i} ON w.cur = read_id AND b = 'ONE' AND f = 'ONE' JOIN edges{i} e ON e.n = w.cur AND e.ns = w.cur_s""")
        self.add(f"paths{i}", f"""SELECT n, ns, d, ds, k, cur AS "end", cur_s AS end_s, hop, len, end_len, bubble_len,
  CASE WHEN b = 'ENDING' OR f = 'ENDING' THEN 'TIP' WHEN (CASE cur_s WHEN 0 THEN b ELSE f END) = 'BRANCH' THEN 'BUBBLE' ELSE 'NONE' END AS type
  FROM walk{i} JOIN nodes{i} ON cur = read_id WHERE NOT (b = 'ONE' AND f = 'ONE')""")
        self.add(f"steps{i}", f"SELECT w.n, w.ns, w.d, w.ds, cur FROM walk{i} w JOIN nodes{i} ON cur = read_id WHERE b = 'ONE' AND f = 'ONE'")
        return f"paths{i}"

    def _next(self, gone: str, cut: str | None = None) -> None:
        """The next generation, without the reads of `gone` and the edges of `cut` and their mirrors."""
        i, j = self.i, self.i + 1
        lost = f" AND NOT EXISTS (SELECT 1 FROM {cut} c WHERE (c.n, c.ns, c.d, c.ds, c.k) = (e.n, e.ns, e.d, e.ds, e.k) OR (c.d, 1 - c.ds, c.n, 1 - c.ns, c.k) = (e.n, e.ns, e.d, e.ds, e.k))" if cut else ""
        if cut:
            self.add(f"cut{j}", f"SELECT n, ns, d, ds, k FROM {cut} UNION SELECT d, 1 - ds, n, 1 - ns, k FROM {cut}")
            lost = f" AND (n, ns, d, ds, k) NOT IN (SELECT (n, ns, d, ds, k) FROM cut{j})"
        self.add(f"edges{j}", f"SELECT * FROM edges{i} e WHERE n NOT IN (SELECT read_id FROM {gone}) AND d NOT IN (SELECT read_id FROM {gone}){lost}")
        self.add(f"alive{j}", f"SELECT * FROM alive{i} WHERE read_id NOT IN (SELECT read_id FROM {gone})")
        self.i = j
        self._nodes()

    def tip_lengths(self) -> str:
        """tips{i}: TIP paths with tip_len and tip_bp."""
        p = self.paths()
        return self.add(f"tips{self.i}", f"""SELECT p.n, p.ns, p.d, p.ds, p.k, p."end", len + coalesce(tail_nodes, 0) AS tip_len, end_len - ({self.L} - k) + coalesce(tail_bp, 0) AS tip_bp
  FROM {p} p LEFT JOIN {self.tails} t ON t.n = p."end" AND t.ns = p.end_s WHERE type = 'TIP'""")

    def tips(self, limit: int, schedule: list[int], passes: int) -> Cleaning:
        L, steps = self.L, ", ".join(f"({x})" for x in schedule)
        self.parts.append(f"schedule(x) AS (VALUES {steps})")
        self.add("allowed0", f"SELECT {schedule[0]} AS x")
        self.add("done0", "SELECT CAST(0 AS BIGINT) AS n, 0 AS ns, CAST(0 AS BIGINT) AS d, 0 AS ds WHERE false")
        late = []
        for p in range(passes):
            i = self.i
            tips = self.tip_lengths()
            self.add(f"open{p}", f"SELECT * FROM {tips} WHERE (n, ns, d, ds) NOT IN (SELECT (n, ns, d, ds) FROM done{p})")
            self.add(f"now{p}", f"SELECT * FROM open{p} WHERE tip_bp < {limit} AND tip_len <= (SELECT x FROM allowed{p})")
            self.add(f"done{p + 1}", f"SELECT * FROM done{p} UNION SELECT n, ns, d, ds FROM open{p} WHERE (tip_bp >= {L} OR tip_len > {limit}) AND (n, ns, d, ds) NOT IN (SELECT (n, ns, d, ds) FROM now{p})")
            self.add(f"left{p}", f"SELECT * FROM open{p} WHERE tip_bp < {limit} AND (n, ns, d, ds) NOT IN (SELECT (n, ns, d, ds) FROM done{p + 1})")
            self.add(f"allowed{p + 1}", f"SELECT CASE WHEN EXISTS (SELECT 1 FROM now{p}) THEN (SELECT x FROM allowed{p}) ELSE coalesce((SELECT min(x) FROM schedule WHERE x > (SELECT x FROM allowed{p}) AND x >= (SELECT min(tip_len) FROM left{p})), (SELECT x FROM allowed{p})) END AS x")
            self.add(f"out{p}", f"SELECT * FROM now{p} UNION SELECT * FROM left{p} WHERE NOT EXISTS (SELECT 1 FROM now{p}) AND tip_len <= (SELECT x FROM allowed{p + 1})")
            gone = self.add(f"tipreads{p}", f'SELECT cur AS read_id FROM steps{i} s JOIN out{p} o ON (s.n, s.ns, s.d, s.ds) = (o.n, o.ns, o.d, o.ds) UNION SELECT "end" FROM out{p}')
            late.append(self.add(f"late{p}", f"""SELECT e.n, e.ns, max(coalesce(tail_bp, 0) + {L} - e.k) AS tail_bp FROM edges{i} e JOIN nodes{i} o ON o.read_id = e.n AND NOT {self.junction}
  LEFT JOIN {self.tails} t ON t.n = e.d AND t.ns = e.ds WHERE e.d IN (SELECT read_id FROM {gone}) AND e.n NOT IN (SELECT read_id FROM {gone}) GROUP BY e.n, e.ns"""))
            before = self.tails
            self.tails = self.add(f"tails{p + 1}", f"SELECT n, ns, max(tail_nodes) AS tail_nodes, max(tail_bp) AS tail_bp FROM (SELECT * FROM {before} UNION ALL SELECT n, ns, tip_len, tip_bp + {L} - k FROM out{p}) GROUP BY n, ns")
            self._next(gone)
        every = " UNION ALL ".join(f"SELECT n, ns, 0, tail_bp FROM {x} WHERE n IN (SELECT read_id FROM alive{self.i})" for x in late)
        self.tails = self.add("tails_all", f"SELECT n, ns, max(tail_nodes) AS tail_nodes, max(tail_bp) AS tail_bp FROM (SELECT * FROM {self.tails} UNION ALL {every}) GROUP BY n, ns")
        return self

    def arms(self, margin: int) -> str:
        """arms{i}: BUBBLE paths out of branching sides with what decides on them."""
        p, i, L = self.paths(), self.i, self.L
        self.add(f"most{i}", f"SELECT n, ns, max(k) AS m FROM edges{i} GROUP BY n, ns")
        return self.add(f"arms{i}", f"""SELECT p.*, {L} - p.end_len + ({L} - m.m - 1) + ({L} - 1 - e.m) AS match, {L} - p.end_len / p.len AS depth, p.bubble_len - ({L} - p.k) AS b_len,
  {L} - p.end_len / p.len < (SELECT a FROM average) AS thin,
  EXISTS (SELECT 1 FROM {p} q WHERE q.type = 'BUBBLE' AND q.n = p.n AND q.ns = p.ns AND q."end" = p."end" AND q.end_s = p.end_s AND q.len > p.len + {margin}) AS longer_sibling
  FROM {p} p JOIN nodes{i} o ON o.read_id = p.n JOIN most{i} m ON m.n = p.n AND m.ns = p.ns JOIN most{i} e ON e.n = p."end" AND e.ns = 1 - p.end_s
  WHERE p.type = 'BUBBLE' AND (CASE p.ns WHEN 1 THEN o.b ELSE o.f END) = 'BRANCH' AND (CASE p.ns WHEN 1 THEN o.f ELSE o.b END) <> 'ENDING'""")

    def _without_paths(self, out: str, more: str = "") -> None:
        i = self.i
        gone = self.add(f"inner{i}", f"SELECT cur AS read_id FROM steps{i} s JOIN {out} o ON (s.n, s.ns, s.d, s.ds) = (o.n, o.ns, o.d, o.ds){more}")
        self._next(gone, out)

    def bubbles(self, margin: int, passes: int) -> Cleaning:
        for _ in range(passes):
            arms = self.arms(margin)
            self._without_paths(self.add(f"thinned{self.i}", f"SELECT * FROM {arms} WHERE b_len < {self.L} AND match < {self.t} AND (thin OR longer_sibling)"))
        return self

    def bridge_reads(self) -> str:
        p = self.paths()
        return self.add(f"bridge{self.i}", f"SELECT read_id FROM nodes{self.i} WHERE suspect AND {self.junction} AND NOT EXISTS (SELECT 1 FROM {p} WHERE n = read_id AND (type = 'TIP' OR len >= 3))")

    def bridges(self) -> Cleaning:
        i, gone = self.i, self.bridge_reads()
        out = self.add(f"bridged{i}", f"SELECT * FROM paths{i} WHERE n IN (SELECT read_id FROM {gone})")
        self._without_paths(out, f" UNION SELECT read_id FROM {gone}")
        return self

    def votes(self, margin: int) -> str:
        """votes{i}: paths of all-BUBBLE junctions with the opposite paths that vote against each."""
        p, i, L = self.paths(), self.i, self.L
        self.add(f"far{i}", f"SELECT n, ns, max(k) AS m FROM edges{i} GROUP BY n, ns")
        self.add(f"pure{i}", f"""SELECT p.*, {L} - 1 - e.m AS spare FROM {p} p JOIN far{i} e ON e.n = p."end" AND e.ns = 1 - p.end_s WHERE p.n NOT IN (SELECT n FROM {p} WHERE type <> 'BUBBLE')""")
        self.add(f"pairs{i}", f"""SELECT x.n, x.d AS d1, x.ds AS ds1, x.k AS k1, y.d AS d2, y.ds AS ds2, y.k AS k2 FROM pure{i} x JOIN pure{i} y ON y.n = x.n AND x.ns = 1 AND y.ns = 0
  WHERE x.bubble_len + y.bubble_len < {L} AND {L} - (x.end_len + y.end_len) + x.spare + y.spare < {self.t} AND (
    {L} - (x.end_len + y.end_len) / (x.len + y.len) < (SELECT a FROM average) OR EXISTS (SELECT 1 FROM {p} q WHERE q.type = 'BUBBLE' AND q.n = y."end" AND q.ns = 1 - y.end_s
      AND q."end" = x."end" AND q.end_s = x.end_s AND q.d <> coalesce(y.hop, x.n) AND q.d <> x.n AND q.len > x.len + y.len + {margin}))""")
        return self.add(f"votes{i}", f"""SELECT v.*, votes = opposite AND opposite > 0 AS removed FROM (SELECT u.n, u.ns, u.d, u.ds, u.k,
    (SELECT count(*) FROM pairs{i} a WHERE a.n = u.n AND ((u.ns = 1 AND (a.d1, a.ds1, a.k1) = (u.d, u.ds, u.k)) OR (u.ns = 0 AND (a.d2, a.ds2, a.k2) = (u.d, u.ds, u.k)))) AS votes,
    (SELECT count(*) FROM pure{i} o WHERE o.n = u.n AND o.ns = 1 - u.ns) AS opposite FROM pure{i} u) v""")

    def junctions(self, margin: int, passes: int) -> Cleaning:
        for _ in range(passes):
            votes = self.votes(margin)
            self._without_paths(self.add(f"voted{self.i}", f"SELECT p.* FROM paths{self.i} p JOIN {votes} v ON (p.n, p.ns, p.d, p.ds, p.k) = (v.n, v.ns, v.d, v.ds, v.k) WHERE removed"))
        return self

    def dead_ends(self, limit: int) -> tuple[str, str]:
        """trimmed: reads that go; offsets: read_id, side, offset."""
        i, L = self.i, self.L
        self.add("front0", f"""SELECT x, xs, coalesce(tail_bp, 0) AS cum FROM (SELECT read_id AS x, 0 AS xs FROM nodes{i} WHERE b = 'ENDING' AND db + df > 0 UNION ALL SELECT read_id, 1 FROM nodes{i} WHERE f = 'ENDING' AND db + df > 0)
  LEFT JOIN {self.tails} t ON t.n = x AND t.ns = 1 - xs""")
        self.add("front", f"""SELECT x, xs, CAST(cum AS BIGINT) AS cum FROM front0 UNION ALL
  SELECT e.d, e.ds, w.cum + {L} - e.k FROM front w JOIN edges{i} e ON e.n = w.x AND e.ns = w.xs JOIN nodes{i} o ON o.read_id = e.d AND o.b = 'ONE' AND o.f = 'ONE' WHERE w.cum + {L} - e.k <= {limit}""")
        fits = f"EXISTS (SELECT 1 FROM edges{i} e WHERE e.n = x AND e.ns = xs AND cum + {L} - e.k <= {limit})"
        self.add("trimmed", f"SELECT DISTINCT x AS read_id FROM front WHERE {fits}")
        self.add("offsets", f"SELECT x AS read_id, 1 - xs AS side, min(greatest(0, least({L}, {L} - cum))) AS off FROM front WHERE NOT {fits} AND x NOT IN (SELECT read_id FROM trimmed) GROUP BY x, xs")
        return "trimmed", "offsets"

    def trim(self, limit: int) -> Cleaning:
        gone, _ = self.dead_ends(limit)
        self._next(gone)
        return self

    def spelled(self, min_len: int, offsets: str | None) -> str:
        """contigs: contig_id, seq, length; needs ori (read_id, strand, seq)."""
        i, L = self.i, self.L
        off = f"(SELECT off FROM {offsets} o WHERE o.read_id = x.n AND o.side = x.ns)" if offsets else "0"
        self.add("kinds", f"SELECT read_id AS n, 1 AS ns, b AS t FROM nodes{i} WHERE db + df > 0 UNION ALL SELECT read_id, 0, f FROM nodes{i} WHERE db + df > 0")
        self.add("sides", f"""SELECT n, ns, CASE WHEN t = 'ENDING' THEN 'TENDING' WHEN EXISTS (SELECT 1 FROM edges{i} e JOIN kinds o ON o.n = e.d AND o.ns = 1 - e.ds AND o.t = 'BRANCH' WHERE e.n = x.n AND e.ns = x.ns) THEN 'HALF'
  WHEN t = 'BRANCH' THEN 'TENDING' ELSE 'ONE' END AS e FROM kinds x""")
        self.add("losses", f"SELECT n, ns, e, CASE e WHEN 'TENDING' THEN coalesce({off}, 0) ELSE m END AS leave, CASE e WHEN 'TENDING' THEN coalesce({off}, 0) WHEN 'HALF' THEN m ELSE 0 END AS enter FROM (SELECT s.*, (SELECT max(k) FROM edges{i} e WHERE e.n = s.n AND e.ns = s.ns) AS m FROM sides s) x")
        self.add("run", f"""SELECT n AS start, CAST(1 - ns AS INTEGER) AS start_s, n AS cur, CAST(1 - ns AS INTEGER) AS cur_s, CAST(0 AS BIGINT) AS place FROM losses WHERE e <> 'ONE'
  UNION ALL SELECT r.start, r.start_s, e.d, e.ds, r.place + 1 FROM run r JOIN losses c ON c.n = r.cur AND c.ns = r.cur_s AND c.e = 'ONE' JOIN edges{i} e ON e.n = r.cur AND e.ns = r.cur_s JOIN losses o ON o.n = e.d AND o.ns = 1 - e.ds AND o.e = 'ONE'""")
        self.add("said", f"""SELECT start, start_s, string_agg(substr(seq, CAST(i.enter + 1 AS BIGINT), CAST(greatest(0, {L} - o.leave - i.enter) AS BIGINT)), '' ORDER BY place) AS seq, arg_max(cur, place) AS last, arg_max(cur_s, place) AS last_s
  FROM run JOIN ori ON ori.read_id = cur AND ori.strand = cur_s JOIN losses i ON i.n = cur AND i.ns = 1 - cur_s JOIN losses o ON o.n = cur AND o.ns = cur_s GROUP BY start, start_s""")
        return self.add("contigs", f"""SELECT row_number() OVER (ORDER BY start, start_s) - 1 AS contig_id, seq, CAST(length(seq) AS BIGINT) AS length, start, start_s FROM said
  WHERE (start < last OR (start = last AND start_s <= 1 - last_s)) AND length(seq) > {L} AND length(seq) >= {min_len}""")
