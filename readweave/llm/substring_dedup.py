"""Substring dedup: Rabin-Karp window hashes, compared in Spark, merged into removal intervals."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import OTHER_BASE, U64, Words, mix, slices, sums_by_place, tidied

#: Text bytes for which one bucket of fingerprints, and one group of documents, are made.
BUCKET_BYTES, HOME_BYTES = 8 << 20, 4 << 20
#: Parts into which one slice, or one bucket, deals its windows; where more buckets or groups than this are due, each
#: part is dealt again by its own task, so that packed runs stay long at every size.
PARTS = 4096
#: A fingerprint is this many bytes besides the bucket, which an independent hash chooses.
KEY_BYTES = 7
_LAST = np.iinfo(np.int64).max


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _pack(doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries in order of document: runs of (doc, mark), positions as differences; zstd."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    at = np.flatnonzero(new)
    step = pos.astype(np.int64)
    step[1:] -= np.where(new[1:], 0, pos[:-1].astype(np.int64))
    parts = [_planes(np.diff(doc[at], prepend=0)), _planes(mark[at]), _planes(np.diff(np.append(at, len(doc))).astype(np.uint32)), _planes(step.astype(np.uint32))]
    return np.array([len(at), len(doc)], np.uint32).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs, n = (int(x) for x in np.frombuffer(blob[:8], np.uint32))
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
    for dtype, many in ((np.int64, runs), (U64, runs), (np.uint32, runs), (np.uint32, n)):
        size = np.dtype(dtype).itemsize * many
        out.append(_unplanes(raw[at : at + size], dtype))
        at += size
    doc, mark, many, step = np.cumsum(out[0]), out[1], out[2], out[3]
    total = np.cumsum(step, dtype=np.int64)
    first = np.cumsum(many) - many
    before = np.where(first > 0, total[first - 1], 0)
    return np.repeat(doc, many), np.repeat(mark, many), (total - np.repeat(before, many)).astype(np.uint32)


def _marks(words: Words) -> np.ndarray:
    """64 bits of each text's words, which tell rows of one doc_id apart."""
    return sums_by_place(words.hash, words.count)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)


def _row(doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A hash of the row: its doc_id and its text's mark, so that rows of one id, or of none, do not meet in one group."""
    return mix(mix(doc.astype(np.int64).view(U64)) ^ mark)


def _home(row: np.ndarray, homes: int) -> np.ndarray:
    return (row % U64(homes)).astype(np.int64)


def _by(key: np.ndarray):
    """(value, indices) of each run of equal values, in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield key[part[0]], part


_FOUND = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("body", pa.binary())])


def _scan(window: int, groups: int, homes: int):
    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(1), 4 << 20):
                part = batch.slice(at, to - at)
                words = Words(part.column(1))
                start, key = words.windows(window)
                if not len(start):
                    continue
                doc = _ids(part.column(0))
                row = words.doc[start]
                of, mark, pos = doc[row], _marks(words)[row], (start - words.first[row]).astype(np.uint32)
                # Within the slice the least document of a hash answers for the others.
                order = np.lexsort((of, key))
                new = np.ones(len(order), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                least = of[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                gone = np.zeros(len(order), bool)
                gone[order] = of[order] > least
                out = []
                rest = np.flatnonzero(gone)
                for home, i in _by(_home(_row(of[rest], mark[rest]), homes)) if len(rest) else ():
                    i = rest[i]
                    i = i[np.lexsort((pos[i], mark[i], of[i]))]
                    out.append((int(home), 1, b"", _pack(of[i], mark[i], pos[i])))
                rest = np.flatnonzero(~gone)
                second = words.windows(window, OTHER_BASE)[1]
                for bucket, i in _by((second[rest] % U64(groups)).astype(np.int64)):
                    i = rest[i]
                    i = i[np.lexsort((pos[i], mark[i], of[i]))]
                    keys = np.ascontiguousarray(key[i].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
                    out.append((int(bucket), 0, keys.tobytes(), _pack(of[i], mark[i], pos[i])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

    return run


_GONE = pa.schema([("home", pa.int64()), ("body", pa.binary())])


def _decide(homes: int):
    def run(table: pa.Table) -> pa.Table:
        out, found = [], []
        for kind, bucket, keys, body in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "keys", "body")), strict=True):
            if kind:
                out.append((bucket, body))
                continue
            wide = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
            wide[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
            found.append((wide.view(U64).ravel(), *_unpack(body)))
        if found:
            key, doc, mark, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((doc, key))
            new = np.ones(len(order), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            gone = order[doc[order] > least]
            for home, i in _by(_home(_row(doc[gone], mark[gone]), homes)) if len(gone) else ():
                i = gone[i]
                i = i[np.lexsort((pos[i], mark[i], doc[i]))]
                out.append((int(home), _pack(doc[i], mark[i], pos[i])))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_GONE)], schema=_GONE)

    return run


def _intervals(window: int, pos: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, pos, 1)
    np.add.at(edge, np.minimum(pos + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            # Entries become sorted row hashes with their positions.
            row, pos = np.zeros(0, U64), np.zeros(0, np.uint32)
            if gone.num_rows:
                doc, mark, pos = (np.concatenate(x) for x in zip(*(_unpack(b) for b in gone.column("body").to_pylist()), strict=True))
                row = _row(doc, mark)
                order = np.argsort(row, kind="stable")
                row, pos = row[order], pos[order]
            texts = docs.column("text").combine_chunks()
            texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
            ids = _ids(docs.column("doc_id").combine_chunks())
            for at, to in slices(texts):
                part = texts.slice(at, to - at)
                mine_of = _row(ids[at:to], _marks(Words(part)))
                low, high = np.searchsorted(row, mine_of), np.searchsorted(row, mine_of, "right")
                for k, text in enumerate(part.to_pylist()):
                    own = (text or "").encode().split()
                    mine = pos[low[k] : high[k]].astype(np.int64)
                    out = _intervals(window, mine, len(own)) if len(mine) else np.zeros(len(own), bool)
                    kept = b" ".join(compress(own, ~out) if len(mine) else own)
                    rows.append((None if ids[at + k] == _LAST else int(ids[at + k]), len(own), int(out.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
        types = dict(doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string(), kept_text=pa.string())
        return pa.table({c: pa.array([r[k] for r in rows], types[c]) for k, c in enumerate(names)})

    return run


def substring_dedup(docs: DataFrame, window: int = 13, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES, home_bytes: int = HOME_BYTES, parts: int = PARTS) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts in a document of smaller id.

    Input: doc_id, text; other columns are not read.  Output: doc_id, n_words, n_removed, kept_sha256
    and, if asked for, kept_text (kept words joined by one space).  Windows are judged on the input.
    Null and blank texts have no words; texts shorter than a window lose nothing.  A null doc_id counts
    as larger than any other.  Repeated rows are judged alike, and equal doc_ids never remove each other.

    Windows are compared by 56 bits of a Rabin-Karp hash besides an independent bucket, rows by 64 bits of id and text.
    Each task sends a window's least document per slice of text, so a window that is everywhere arrives
    once a slice.  Buckets and document groups grow in number, not in size, with the input.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, homes = max(8, -(-total // bucket_bytes)), max(8, -(-total // home_bytes))
    found = docs.mapInArrow(tidied(_scan(window, min(groups, parts), min(homes, parts))), "bucket long, kind tinyint, keys binary, body binary")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if groups > parts:
        found = found.repartition(max(width, parts), "bucket").mapInArrow(tidied(_again(-(-groups // parts), parts)), "bucket long, kind tinyint, keys binary, body binary")
    gone = found.groupBy("bucket").applyInArrow(_decide(min(homes, parts)), "home long, body binary")
    if homes > parts:
        gone = gone.repartition(max(width, parts), "home").mapInArrow(tidied(_homes_again(homes)), "home long, body binary")
    rows = docs.mapInArrow(tidied(_with_home(homes)), "home long, doc_id long, text string")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.groupBy("home").cogroup(gone.groupBy("home")).applyInArrow(_remove(window, with_text), schema)


def _with_home(homes: int):
    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                home = pa.array(_home(_row(_ids(part.column(0)), _marks(Words(part.column(1)))), homes), pa.int64())
                yield pa.RecordBatch.from_arrays([home, part.column(0), part.column(1)], names=["home", "doc_id", "text"])

    return run


def _gathered(batches, most: int = 16 << 20):
    """Lists of rows of about `most` bytes."""
    rows, size = [], 0
    for batch in batches:
        rows += batch.to_pylist()
        size += batch.nbytes
        if size >= most:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _again(width: int, parts: int):
    """Deals each bucket's windows into `width` finer buckets by their fingerprints."""

    def run(batches):
        for rows in _gathered(batches):
            out = [(r["bucket"], 1, b"", r["body"]) for r in rows if r["kind"]]
            of: dict[int, list] = {}
            for r in rows:
                if not r["kind"]:
                    of.setdefault(r["bucket"], []).append(r)
            for bucket, own in of.items():
                keys = np.concatenate([np.frombuffer(r["keys"], np.uint8).reshape(-1, KEY_BYTES) for r in own])
                doc, mark, pos = (np.concatenate(x) for x in zip(*(_unpack(r["body"]) for r in own), strict=True))
                wide = np.zeros((len(keys), 8), np.uint8)
                wide[:, :KEY_BYTES] = keys
                for fine, i in _by((mix(wide.view(U64).ravel()) % U64(width)).astype(np.int64)):
                    i = i[np.lexsort((pos[i], mark[i], doc[i]))]
                    out.append((bucket + parts * int(fine), 0, np.ascontiguousarray(keys[i]).tobytes(), _pack(doc[i], mark[i], pos[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def _homes_again(homes: int):
    """Deals each group's entries into the `homes` finer groups."""

    def run(batches):
        for rows in _gathered(batches):
            doc, mark, pos = (np.concatenate(x) for x in zip(*(_unpack(r["body"]) for r in rows), strict=True))
            out = []
            for home, i in _by(_home(_row(doc, mark), homes)):
                i = i[np.lexsort((pos[i], mark[i], doc[i]))]
                out.append((int(home), _pack(doc[i], mark[i], pos[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_GONE)], schema=_GONE)

    return run
