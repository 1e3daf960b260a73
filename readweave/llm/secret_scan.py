"""Secret scans: spans of credentials, and weak parts that only count beside a complementary part.

Base kinds are reported wherever they stand.  The parts of a multipart credential - access identifier,
secret, endpoint - are joined by interval within a scope of some characters: a weak part is reported
only if its complement's interval, widened by the scope, meets its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length: fixed values of the base kinds, in their order.  The least
#: length of an identifier or hex run stands in the pattern too: a run that is too short holds no other match.
BASE = (("assign", _ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
#: kind, pattern, group, least and most length, part: candidates too common to be reported alone.
WEAK = (
    ("weak_access", r"AKIA[A-Z0-9]{8,}", 0, 12, 17, "access"),
    ("weak_login", r"""((?i:user_?name|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 2, 3, None, "access"),
    ("weak_assign", _ASSIGN, 2, 4, 11, "secret"),
    # A run of characters is tried from its start only, and never given back, so a long one takes linear time.
    ("weak_mail", r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9][A-Za-z0-9._+-]*+", 0, 6, None, "access"),
    ("weak_endpoint", r"""(?<![a-z0-9+])[a-z0-9+]++://[^\x00-\x20"'<>]++""", 0, 8, None, "endpoint"),
)
_PART = {"assign": "secret", "hex": "secret", "access": "access"} | {w[0]: w[5] for w in WEAK}
_RANK = {k: i for i, k in enumerate([b[0] for b in BASE] + [w[0] for w in WEAK])}
_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches whose places are summed up together.
_MATCHES = 256


def _spans(kind: str, pattern: str, group: int, least: int, most: int | None) -> Column:
    """Leftmost non-overlapping matches, as (start, kind, end) in code points: the text between matches tells their places."""
    text, rx = F.col("text"), F.lit(pattern)
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, rx, 0)
    value = hits if group == 0 else F.regexp_extract_all(text, rx, group)
    each = F.arrays_zip(F.transform(hits, lambda h: F.length(h)).alias("n"), F.transform(value, lambda v: F.length(v)).alias("v"), F.transform(F.slice(parts, 1, F.size(hits)), lambda p: F.length(p)).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        good = m["v"] >= least if most is None else (m["v"] >= least) & (m["v"] <= most)
        new = F.array(F.struct(start.alias("start"), F.lit(_RANK[kind]).alias("kind"), (start + m["n"]).alias("end")))
        return F.struct((start + m["n"]).alias("at"), F.when(good, F.concat(state["out"], new)).otherwise(state["out"]).alias("out"))

    def shifted(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    # Places are summed up within blocks of matches and then over blocks, so that no array grows by one span at a time.
    blocks = lambda e: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(e) / _MATCHES).cast("int") - 1)), lambda b: F.aggregate(F.slice(e, b * _MATCHES + 1, _MATCHES), empty, step))
    found = F.transform(F.array(each), lambda e: F.flatten(F.aggregate(blocks(e), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), shifted)["out"]))[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _named(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in _RANK]), kind + 1)


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per document: doc_id, base and linked (arrays of start, kind, end in code points, by start, then kind as listed).

    base: assignments, access identifiers and hex runs.  linked: weak parts within `scope` characters of a
    complementary part, weak or base: an identifier or endpoint beside a secret, a secret beside an
    identifier or endpoint.  Null and empty texts have none; equal rows get equal results; null ids stay
    null.  Other columns are not read.  Parts meet by cell of text, so no task pairs a document with itself.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = F.array_sort(F.concat(*[_spans(kind, rx, group, least, None) for kind, rx, group, least in BASE]))
    weak = F.array_sort(F.concat(*[_spans(kind, rx, group, least, most) for kind, rx, group, least, most, _ in WEAK]))
    key = F.xxhash64("text")
    found = written(docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("key"), key.alias("mark"), F.octet_length("text").alias("bytes"), base.alias("base"), weak.alias("weak")))

    part = F.element_at(F.array(*[F.lit(_PART[k]) for k in _RANK]), F.col("s.kind") + 1)
    rows = found.where(F.size("weak") > 0).select("key", "mark", "bytes", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    rows = rows.select("key", "mark", "bytes", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), part.alias("part"))
    # A weak part looks in the cells that its widened interval meets; a part stands in all cells of its own.
    cells = lambda low, high: F.explode(F.sequence(F.expr(f"({low}) div {scope}"), F.expr(f"({high}) div {scope}")))
    asks = rows.where(F.col("kind") >= len(BASE)).withColumn("cell", cells(f"greatest(start - {scope}, 0)", f"end + {scope}"))
    there = rows.select("key", "mark", "bytes", F.col("start").alias("low"), F.col("end").alias("high"), F.col("part").alias("with"), cells("start", "end").alias("cell"))
    complement = F.when(F.col("part") == "secret", F.col("with") != "secret").otherwise(F.col("with") == "secret")
    near = (F.col("low") <= F.col("end") + scope) & (F.col("high") >= F.col("start") - scope)
    same = ["key", "mark", "bytes", "cell"]
    on = [asks[c] == there[c] for c in same] + [near, complement]
    linked = asks.join(there, on, "left_semi").select("key", "mark", "bytes", F.struct("start", "kind", "end").alias("s")).distinct()
    linked = linked.groupBy("key", "mark", "bytes").agg(F.array_sort(F.collect_list("s")).alias("linked"))
    both = found.join(linked, ["key", "mark", "bytes"], "left")
    named = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), _named(s["kind"]).alias("kind"), s["end"].alias("end")))
    return both.select("doc_id", named("base").alias("base"), named(F.coalesce("linked", F.array().cast(_SPANS))).alias("linked"))
