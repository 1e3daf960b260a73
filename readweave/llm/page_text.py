"""HTML extraction: page structure, and a suffix array of each host for what structure leaves open.

Markup is read first: elements that are chrome by name or class are dropped, and article (or main) elements declare main
text.  What is left open, and short blocks inside declared text, are the token streams of a host's pages.  Their
suffixes are sorted to the depth of a long substring, host by host, a large host in parts by the suffixes' first tokens;
suffixes that agree to that depth are a substring that pages share.  Blocks that shared substrings cover are removed: open
ones if two pages share them, declared ones if they recur on three pages and half of the host's, so that what one article
quotes from another stays.  Structure guards two cases by size: declared text of which half or more would go is an article
that recurs and stays whole, and text outside it counts only where it is longer than the declared text or none is declared.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import U64, Words, mix, sums_by_place, tidied

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CHROME = frozenset("head nav footer aside form menu dialog button select object canvas map audio video".split())
_CHROME_NAMES = frozenset(
    "ad ads adv advert advertisement adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments reply replies disqus discussion widget toolbar pagination pager search".split()
)
#: Tokens from which a shared substring counts as long.
LONG = 8
#: Words up to which a block of declared text can be boilerplate.
NOTICE = 60
#: Tokens of a host that one task sorts; beyond, its suffixes are dealt out by their first tokens.
HOST_TOKENS = 2_000_000
#: Bytes of shared places up to which they are broadcast to the pages; beyond, Spark shuffles both.
BROADCAST_BYTES = 32 << 20


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in _CHROME or (name == "header" and not in_article):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    names = {w for m in _NAMED.finditer(attributes) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())}
    return bool(names & _CHROME_NAMES) and name not in ("html", "body", "article", "main") or bool(names & {"comment", "comments"}) and name == "article"


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, state) of each block in page order; state 2: declared main text, 1: open, 0: chrome."""
    # element, whether chrome encloses it, articles that enclose it, whether a chrome block encloses it
    stack: list[tuple[str, bool, int, bool]] = []
    out: list[tuple[str, int]] = []
    run: list[str] = []
    state = [False, 0, False]

    def close():
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append((text, 0 if state[2] else 2 if state[1] else 1))

    def enter():
        state[:] = stack[-1][1:] if stack else (False, 0, False)

    for m in _PIECE.finditer(page):
        name = (m[3] or "").lower()
        if not name:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                # An inline element that is chrome leaves its block whole but for its own text.
                run.append(" " if state[0] and not state[2] else piece)
            elif m[1]:
                run.append(" ")
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in _BLOCK:
            close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    enter()
                    break
                if name == "p" and stack[k][0] in _BLOCK:
                    break
        elif name not in _VOID:
            if stack and any(e[0] == "head" for e in stack) and (name == "body" or stack[-1][0] == "head"):
                # The head ends at the body, or at the first element that cannot stand in it.
                close()
                del stack[next(k for k, e in enumerate(stack) if e[0] == "head") :]
                enter()
            if name in _BLOCK:
                # A block ends an open paragraph, with what stands open inside it.
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        enter()
                        break
                    if stack[k][0] in _BLOCK:
                        break
            chrome = state[0] or _is_chrome(name, m[4], state[1] > 0)
            inside = state[1] + (name in ("article", "main") or bool(re.search(r"""role\s*=\s*["']?main|articleBody""", m[4])))
            if not m[4].endswith("/"):
                stack.append((name, chrome, inside, chrome if name in _BLOCK else state[2]))
                enter()
    close()
    return out


def suffix_classes(tokens: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of concatenated streams to `depth` tokens: (order, class), by prefix doubling.

    stop: for each place the end of its stream, which no comparison crosses.  Suffixes of one class share their first
    `depth` tokens, or all of them where the stream ends sooner.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    at, reach = np.arange(n), 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.where(at + step < stop, rank[np.minimum(at + step, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        reach += step
    return np.argsort(rank, kind="stable"), rank


def _layout(blocks: list[tuple[str, int]]) -> list[tuple[int, int, int]]:
    """(block, words, run) of the blocks in the stream; a run ends where the state changes or a block is left out."""
    out: list[tuple[int, int, int]] = []
    run, before = -1, None
    for i, (text, state) in enumerate(blocks):
        n = text.count(" ") + 1
        if state == 1 or (state == 2 and n <= NOTICE):
            run += state != before
            before = state
            out.append((i, n, run))
        else:
            before = None
    return out


def _ends(lengths: np.ndarray) -> np.ndarray:
    """For each token of runs of these lengths, where its run ends."""
    return np.repeat(np.cumsum(lengths), lengths)


_STREAM = pa.schema([("host", pa.string()), ("mark", pa.int64()), ("mark2", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("runs", pa.binary())])


def _streams(batches):
    """Per page: a print of its text, tokens as 32 bits each, and lengths of runs."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            rows = batch.slice(low, 256).to_pylist()
            parsed = [blocks_of(r["html"] or "") for r in rows]
            laid = [_layout(p) for p in parsed]
            words = Words(pa.array([" ".join(p[i][0] for i, _, _ in lay) for p, lay in zip(parsed, laid, strict=True)], pa.string()))
            whole = Words(pa.array([" ".join(b[0] for b in p) for p in parsed], pa.string()))
            prints = sums_by_place(whole.hash, whole.count).view(np.int64)
            out = []
            for k, r in enumerate(rows):
                tokens = words.hash[words.first[k] : words.first[k + 1]].astype(np.uint32)
                runs = np.zeros((laid[k][-1][2] + 1) if laid[k] else 0, np.uint32)
                for _, n, run in laid[k]:
                    runs[run] += n
                out.append((r["host"], r["mark"], r["mark2"], int(prints[k]), len(tokens), tokens.tobytes(), runs.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_STREAM)], schema=_STREAM)


_DEALT = pa.schema([("host", pa.string()), ("part", pa.int64()), ("pages", pa.int64()), ("mark", pa.int64()), ("mark2", pa.int64()), ("print", pa.int64()), ("tokens", pa.binary()), ("runs", pa.binary()), ("at", pa.binary())])


def _windows(tokens: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` tokens of each suffix, and how many it has."""
    at = np.arange(len(tokens))[:, None] + np.arange(depth)
    inside = at < stop[:, None]
    out = np.where(inside, tokens[np.minimum(at, max(0, len(tokens) - 1))], 0) if len(tokens) else np.zeros((0, depth), np.uint32)
    return np.concatenate([out, inside.sum(1, keepdims=True)], axis=1).astype(np.uint32)


def _parts(depth: int):
    """Pages of a large host become rows of suffixes, dealt by their first tokens; others pass as they are."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                if r["parts"] is None:
                    out.append((r["host"], 0, None, r["mark"], r["mark2"], r["print"], r["tokens"], r["runs"], None))
                else:
                    tokens, runs = np.frombuffer(r["tokens"], np.uint32), np.frombuffer(r["runs"], np.uint32).astype(np.int64)
                    rows = _windows(tokens, _ends(runs), depth)
                    dealt = mix(rows[:, 0].astype(U64) << U64(32) | rows[:, 1].astype(U64)) % U64(r["parts"])
                    for part in np.unique(dealt).tolist():
                        at = np.flatnonzero(dealt == part)
                        out.append((r["host"], int(part), r["pages"], r["mark"], r["mark2"], r["print"], rows[at].tobytes(), r["runs"], at.astype(np.uint32).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_DEALT)], schema=_DEALT)

    return run


_SHARED = pa.schema([("mark", pa.int64()), ("mark2", pa.int64()), ("part", pa.int64()), ("two", pa.binary()), ("common", pa.binary())])


def _shared(depth: int):
    """Sorts the suffixes of a host, or of a part of it: places of each page whose next `depth` tokens other pages share."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens, stops, ats, starts, size = [], [], [], [], 0
        for r in rows:
            lengths = np.frombuffer(r["runs"], np.uint32).astype(np.int64)
            begins = np.zeros(int(lengths.sum()) + 1, bool)
            begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            at = np.arange(int(lengths.sum())) if r["at"] is None else np.frombuffer(r["at"], np.uint32).astype(np.int64)
            starts.append(begins[at])
            ats.append(at)
            if r["at"] is None:
                tokens.append(np.frombuffer(r["tokens"], np.uint32))
                stops.append(_ends(lengths) + size)
                size += len(at)
            else:
                tokens.append(np.frombuffer(r["tokens"], np.uint32).reshape(-1, depth + 1))
        out = []
        if sum(map(len, ats)):
            if rows[0]["at"] is None:
                flat, stop = np.concatenate(tokens), np.concatenate(stops)
                cls = suffix_classes(flat, stop, depth)[1]
                full = stop - np.arange(len(flat)) >= depth
            else:
                flat = np.ascontiguousarray(np.concatenate(tokens))
                cls = np.unique(flat.view(f"V{4 * (depth + 1)}").ravel(), return_inverse=True)[1]
                full = flat[:, depth] == depth
            page = np.repeat(np.arange(len(rows)), [len(a) for a in ats])
            prints = np.unique(np.array([r["print"] for r in rows]), return_inverse=True)[1]
            # A run of fewer tokens counts as a whole.
            listed = np.flatnonzero(full | np.concatenate(starts))
            pairs = np.unique(np.stack([cls[listed], prints[page[listed]]], 1), axis=0)
            many = np.bincount(pairs[:, 0], minlength=int(cls.max()) + 1)
            pages = int(prints.max()) + 1 if rows[0]["pages"] is None else rows[0]["pages"]
            places = np.concatenate(ats)
            held = listed[many[cls[listed]] > 1]
            of = page[held]
            for k in np.unique(of).tolist():
                own = held[of == k] if len(rows) < 64 else held[np.searchsorted(of, k) : np.searchsorted(of, k, "right")]
                often = many[cls[own]]
                common = own[(often >= 3) & (2 * often >= pages)]
                r = rows[k]
                out.append((r["mark"], r["mark2"], r["part"], places[own].astype(np.uint32).tobytes(), places[common].astype(np.uint32).tobytes()))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_SHARED)], schema=_SHARED)

    return run


_HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def page_text(pages: DataFrame, depth: int = LONG, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """One row per page: page_id, url, text (main text; blocks joined by newlines), n_chars.

    White space inside a block becomes one space.  Null and empty html give an empty text; pages without a url, or
    with one that names no host, make one host.  Pages of equal text count as one page when shared substrings are sought,
    so a page that was fetched twice keeps its text.  Repeated rows give repeated rows; other columns are not read.
    Pages are read twice, so that only tokens and shared places are moved.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    html_ = F.coalesce("html", F.lit(""))
    pages = pages.select("*", host.alias("host"), F.xxhash64(host, html_).alias("mark"), F.xxhash64(F.lit("other"), host, html_).alias("mark2"))
    streams = written(pages.select("host", "mark", "mark2", "html").mapInArrow(tidied(_streams), "host string, mark long, mark2 long, print long, n long, tokens binary, runs binary").where("n > 0"))
    large = streams.groupBy("host").agg(F.sum("n").alias("all")).where(F.col("all") > host_tokens)
    # At most one host for every host_tokens tokens.
    large = streams.join(F.broadcast(large), "host").groupBy("host", "all").agg(F.countDistinct("print").alias("pages")).select("host", "pages", F.ceil(F.col("all") / host_tokens).alias("parts"))
    dealt = streams.join(F.broadcast(written(large)), "host", "left").mapInArrow(tidied(_parts(depth)), "host string, part long, pages long, mark long, mark2 long, print long, tokens binary, runs binary, at binary")
    found = dealt.groupBy("host", "part").applyInArrow(_shared(depth), "mark long, mark2 long, part long, two binary, common binary")
    found = found.groupBy("mark", "mark2", "part").agg(F.first("two").alias("two"), F.first("common").alias("common")).groupBy("mark", "mark2")
    found = written(found.agg(F.collect_list("two").alias("two"), F.collect_list("common").alias("common")))
    size = found.agg(F.sum(F.aggregate(F.concat("two", "common"), F.lit(64), lambda a, b: a + F.octet_length(b)))).first()[0] or 0
    both = pages.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["mark", "mark2"], "left")
    both = both.select("page_id", "url", "html", "two", "common").mapInArrow(tidied(_unique(depth)), "page_id long, url string, text string")
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def decided(blocks: list[tuple[str, int]], two: np.ndarray, common: np.ndarray, depth: int) -> list[bool]:
    """Which blocks shared substrings remove, given the stream's places where those of two pages, and common ones, start."""
    laid = _layout(blocks)
    lengths = np.array([n for _, n, _ in laid], np.int64)
    total, gone = int(lengths.sum()), [False] * len(blocks)
    if not len(two):
        return gone
    runs = np.array([run for _, _, run in laid])
    stop = _ends(np.bincount(runs, weights=lengths).astype(np.int64))
    covered = []
    for at in (two, common):
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + depth, stop[at]) if len(at) else at, -1)
        covered.append(np.cumsum(edge[:-1]) > 0)
    first = 0
    for i, n, _ in laid:
        gone[i] = bool(covered[blocks[i][1] == 2][first : first + n].all())
        first += n
    return gone


def main_text(blocks: list[tuple[str, int]], gone: list[bool]) -> str:
    words = lambda state, out: sum(b[0].count(" ") + 1 for b, g in zip(blocks, gone, strict=True) if b[1] == state and g == out)
    if 2 * words(2, True) >= words(2, True) + words(2, False):
        gone = [g and b[1] != 2 for b, g in zip(blocks, gone, strict=True)]
    least = 1 if words(1, False) > words(2, False) else 2
    return "\n".join(b[0] for b, g in zip(blocks, gone, strict=True) if b[1] >= least and not g)


def _unique(depth: int):
    def run(batches):
        joined = lambda parts: np.frombuffer(b"".join(parts or []), np.uint32).astype(np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(low, 256).to_pylist():
                    blocks = blocks_of(r["html"] or "")
                    out.append((r["page_id"], r["url"], main_text(blocks, decided(blocks, joined(r["two"]), joined(r["common"]), depth))))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])

    return run
