"""Token-ID output: a wavelet matrix per shard, in one compressed file that answers by rank and select.

Image: b"WVM2" and counts, then a directory, then zstd frames.  The directory has for each bit of the ids, highest first,
the zeros of its plane, and for each block of a plane the set bits before it and where its frame ends; so an access opens
one block of each plane, and a rank counts within one block.  The frames are document lengths and the blocks, plane by
plane.  An image is the one row of a Parquet file of its own, so Spark's commit protocol decides which attempt of a
task counts, on any store that Spark can write.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .words import prefix_hash, slices, tidied

_MAGIC, _HEAD = b"WVM2", "<4sBQQQ"
#: Ids in a shard, but for a longer document; bounds the memory of a task.
SHARD_IDS = 1_000_000
#: Bits of a block: what a rank, select or access opens of a plane.
_BLOCK = 1 << 16


def _kind(bits: int):
    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """Ids of a shard and its documents; access, rank, select and extraction from the blocks of an image."""

    #: Blocks kept open.
    OPEN = 256

    def __init__(self, image: bytes):
        magic, self.bits, self.n, docs, size = struct.unpack_from(_HEAD, image)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix image")
        self.image, self.blocks = image, -(-self.n // _BLOCK)
        at = struct.calcsize(_HEAD)
        table = np.frombuffer(image, "<u8", self.bits * (2 * self.blocks + 1), at).astype(np.int64).reshape(self.bits, -1)
        at += 8 * table.size
        self.zeros, self.before, ends = table[:, 0], table[:, 1 : 1 + self.blocks], table[:, 1 + self.blocks :].ravel()
        self._open: dict[tuple[int, int], np.ndarray] = {}
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.lengths = np.frombuffer(self._unpack(image[at : at + size]), "<u8").astype(np.int64)[:docs]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.frames = at + size + np.concatenate([[0], ends]).astype(np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, lengths: np.ndarray) -> WaveletMatrix:
        pack = zstandard.ZstdCompressor(level=1).compress
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind, row = _kind(bits), ids.astype(_kind(bits))
        table, frames = [], []
        for k in range(bits - 1, -1, -1):
            ones = (row & kind(1 << k)).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), _BLOCK // 8), dtype=np.int64) if len(row) else np.zeros(0, np.int64)
            plane = plane.tobytes()
            frames += [pack(plane[i : i + _BLOCK // 8]) for i in range(0, len(plane), _BLOCK // 8)]
            table.append(np.concatenate([[len(row) - counts.sum()], np.cumsum(counts) - counts]))
            row = np.concatenate([row.take(np.flatnonzero(~ones)), row.take(np.flatnonzero(ones))])
        documents = pack(lengths.astype("<u8").tobytes())
        ends = np.cumsum([len(f) for f in frames]).reshape(bits, -1)
        head = struct.pack(_HEAD, _MAGIC, bits, len(ids), len(lengths), len(documents))
        return cls(head + np.concatenate([np.array(table), ends], axis=1).astype("<u8").tobytes() + documents + b"".join(frames))

    def dump(self) -> bytes:
        return self.image

    @classmethod
    def load(cls, image: bytes) -> WaveletMatrix:
        return cls(image)

    def _frame(self, plane: int, block: int) -> np.ndarray:
        at = plane * self.blocks + block
        return np.frombuffer(self._unpack(self.image[self.frames[at] : self.frames[at + 1]]), np.uint8)

    def _block(self, plane: int, block: int) -> np.ndarray:
        found = self._open.get((plane, block))
        if found is None:
            if len(self._open) >= self.OPEN:
                self._open.pop(next(iter(self._open)))
            found = self._open[plane, block] = self._frame(plane, block)
        return found

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // _BLOCK)[i % _BLOCK >> 3]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Set bits before place i."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        block, rest = self._block(plane, i // _BLOCK), i % _BLOCK
        found = int(self.before[plane, i // _BLOCK]) + int(np.bitwise_count(block[: rest >> 3]).sum(dtype=np.int64))
        return found + ((int(block[rest >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if value >> (self.bits - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often an id stands in places low .. high-1 (rank)."""
        if value < 0 or value >> self.bits:
            return 0
        low, high = self._range(value, low, self.n if high is None else high)
        return high - low

    def _select(self, plane: int, bit: int, nth: int) -> int:
        before = self.before[plane] if bit else np.arange(self.blocks) * _BLOCK - self.before[plane]
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def select(self, value: int, nth: int) -> int:
        """The place of the nth occurrence (from 0) of an id."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        i = self._range(value, 0, self.n)[0] + nth
        for k in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def occurrences(self, value: int) -> list[tuple[int, int]]:
        """(document of the shard, place in it) of all occurrences of an id."""
        places = np.array([self.select(value, k) for k in range(self.count(value))], np.int64)
        doc = np.searchsorted(self.starts, places, "right") - 1
        return list(zip(doc.tolist(), (places - self.starts[doc]).tolist(), strict=True))

    def ids(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane says where the values of the next one stood before."""
        kind = _kind(self.bits)
        value = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._frame(k, b) for b in range(self.blocks)] or [np.zeros(0, np.uint8)])
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros, before = int(self.zeros[k]), np.empty(self.n, kind)
            before[np.flatnonzero(~ones)], before[np.flatnonzero(ones)] = value[:zeros], value[zeros:] | kind(1 << (self.bits - 1 - k))
            value = before
        return value

    def document(self, d: int) -> np.ndarray:
        """The ids of one document of the shard, by access."""
        return np.array([self.access(i) for i in range(self.starts[d], self.starts[d + 1])], np.uint32)


_SHARD = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())])


#: Bytes that are, or may begin, white space inside a segment, and a space at its end.
_ODD = re.compile(rb"[\x00-\x1f\x7f\xc2\xe1-\xe3]|[^\x00]\x20|\x20\Z|\A\Z")
#: The character in which a byte-level tokenizer writes each byte: those without a printable Latin-1 character from 256 on,
#: in their order.  Bytes 1 and 2, which no word holds, stand for a space and for the end of a text.
_BYTE_LEVEL = np.arange(256, dtype="<u2")
_BYTE_LEVEL[[b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]] = np.arange(256, 324)
_BYTE_LEVEL[[1, 2]] = 0x20, 2
#: What a byte may be, as bits: before a cut, the first of a character of two bytes, behind a cut, an ASCII letter, a mark other
#: than ', the second of a letter that begins with 0xC3 (U+00C0-U+00FF but the signs of multiplication and division), a
#: later byte of a character.
_ENDS, _TWO, _BEGINS, _LETTER, _MARK, _LATIN, _LATER = (1 << k for k in range(7))


def _may_be(b: int) -> int:
    printed, two, letter = 0x20 < b < 0x80, 0xC3 <= b <= 0xDF, chr(b).isalpha() and b < 0x80
    found = _ENDS * printed | _TWO * two | _BEGINS * (printed or two or b >= 0xE4) | _LETTER * letter
    found |= _MARK * (0x20 < b < 0x7F and not chr(b).isalnum() and b != 0x27)
    return found | _LATIN * (0x80 <= b <= 0xBF and b not in (0x97, 0xB7)) | _LATER * (b >= 0x80)


_CLASS = bytes(map(_may_be, range(256)))


class SegmentEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct segment of a slice once.

    A segment begins at a text's start, at a single space between two characters that are no white space, before
    and after a single line end between two such characters, and, with GPT-2's splitting pattern, at an ASCII mark other
    than ' behind a letter (ASCII or U+00C0-U+00FF), so that a word is the same segment before any mark.  The tokenizer's
    splitting pattern always cuts there, and merges never cross a cut, so the ids of a text are those of its segments one after the other.  Bytes that may belong to other Unicode white space never make a cut.  A text that
    holds the string of an added token goes to the tokenizer whole.
    """

    #: Bytes of segments, their ids and what holds them, kept between slices: the first ones met, among them the frequent ones.
    KEPT_BYTES = 64 << 20
    #: New segments encoded as the lines of one text.
    LINES = 24

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.kind = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.wide = np.dtype(self.kind).itemsize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.lean = self._lean_tokenizer()

    def _lean_tokenizer(self):
        """The same merges behind a split at white space, for segments that are cut here; None for another kind of tokenizer."""
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not known or made["normalizer"] is not None or made["model"].get("type") != "BPE" or made["model"].get("dropout") or len(self.line) != 1:
            return None
        lean = Tokenizer(self.tokenizer.model)
        lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return lean

    def _lines(self, batch, texts: list[str], n: int) -> list[bytes] | None:
        """Ids of the n lines of all texts; None if line ends don't come out as one token each."""
        between = np.array(self.line, self.kind)
        ids = np.concatenate([x for e in batch(texts, add_special_tokens=False) for x in (np.array(e.ids, self.kind), between)])
        cuts = np.flatnonzero(ids == between[0]).tolist()
        if len(between) != 1 or len(cuts) != n:
            return None
        own = ids.tobytes()
        return [own[self.wide * a : self.wide * b] for a, b in zip([0, *[c + 1 for c in cuts[:-1]]], cuts, strict=True)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of segments that are letters behind a space or none, spelled in byte-level characters here: they go to the merges as they are."""
        texts = b"\2".join(b"\1\n\1".join(words[k : k + self.LINES]) for k in range(0, len(words), self.LINES))
        spelled = _BYTE_LEVEL[np.frombuffer(texts, np.uint8)].tobytes().decode("utf-16-le")
        return self._lines(getattr(self.lean, "encode_batch_fast", self.lean.encode_batch), spelled.split("\2"), len(words)) or self._patterned(words)

    def _patterned(self, segments: list[bytes]) -> list[bytes]:
        """Ids of segments by the tokenizer's own splitting pattern.

        Segments without line ends are encoded as lines of one text: the pattern gives each line end a token of its own,
        which leaves the next line's leading space to its word.
        """
        odd = [_ODD.search(x) is not None for x in segments]
        plain = [x for x, o in zip(segments, odd, strict=True) if not o] if any(odd) else segments
        encode = lambda texts: [np.array(e.ids, self.kind) for e in self.batch(texts, add_special_tokens=False)]
        texts = [b"\n".join(plain[k : k + self.LINES]).decode() for k in range(0, len(plain), self.LINES)]
        lines: list[bytes] = []
        if texts:
            lines = self._lines(self.batch, texts, len(plain)) or [x.tobytes() for x in encode([x.decode() for x in plain])]
        if len(plain) == len(segments):
            return lines
        other, line = iter([x.tobytes() for x in encode([x.decode() for x, o in zip(segments, odd, strict=True) if o])]), iter(lines)
        return [next(other) if o else next(line) for o in odd]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        import pyarrow.compute as pc

        texts = pa.concat_arrays([texts.cast(pa.large_string())]).fill_null("")
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cut(texts)
        ids, many = self._cut(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts))
        parts, at = [], np.concatenate([[0], np.cumsum(many)])
        low = 0
        for i in np.flatnonzero(whole).tolist():
            own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind)
            parts += [ids[at[low] : at[i]], own]
            many[i], low = len(own), i
        return np.concatenate([*parts, ids[at[low] :]]), many

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        texts = pa.concat_arrays([texts])
        n, buffers = len(texts), texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        raw = data.tobytes()
        cut, kind = np.zeros(len(data), bool), np.frombuffer(raw.translate(_CLASS), np.uint8)
        has = lambda bits, low, high: kind[low:high] & bits != 0
        between = (has(_ENDS, 1, -2) | has(_TWO, 0, -3) & has(_LATER, 1, -2)) & has(_BEGINS, 3, None)
        line = (data[2:-1] == 0x0A) & between
        cut[2:-1] = (data[2:-1] == 0x20) & between | line
        cut[3:] |= line
        # White space at either end of a text has no neighbour inside it.
        edges = offsets[:-1][offsets[1:] > offsets[:-1]]
        cut[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
        cut[edges] = True
        letter = has(_LETTER, 0, None)
        if self.lean is not None:
            pair = (data[:-1] == 0xC3) & has(_LATIN, 1, None)
            letter[:-1] |= pair
            letter[1:] |= pair
            cut[1:] |= letter[:-1] & has(_MARK, 1, None)
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        # Bytes are compared after it, so a plain polynomial hash will do.
        code = pd.factorize(prefix_hash(data, start, end))[0]
        code, first = self._same(data, start, end, code)
        known, segments = self.known, [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        found = list(map(known.get, segments))
        new = np.array([x is None for x in found])
        letter[start] |= (data[start] == 0x20) & (end - start > 1)
        word = np.logical_and.reduceat(letter, start)[first] if self.lean is not None else np.zeros(len(first), bool)
        for own, encoded in ((np.flatnonzero(new & word).tolist(), self._words), (np.flatnonzero(new & ~word).tolist(), self._patterned)):
            for i, ids in zip(own, encoded([segments[i] for i in own]) if own else [], strict=True):
                found[i] = ids
                size = len(segments[i]) + len(ids) + 200
                if self.held + size <= self.KEPT_BYTES:
                    known[segments[i]] = ids
                    self.held += size
        many = np.fromiter(map(len, found), np.int64, len(found)) // self.wide
        flat = np.frombuffer(b"".join(found), self.kind)
        at = np.cumsum(many) - many
        each = many[code]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(at[code] - total[:-1], each) + np.arange(total[-1])]
        bounds = total[np.searchsorted(start, offsets)]
        return ids, np.diff(bounds)

    @staticmethod
    def _same(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, first segment of each code), where segments of a code are equal byte by byte: what only hashes alike gets a code of its own."""
        first = np.empty(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        length, like = end - start, first[code]
        unlike = length != length[like]
        other = np.repeat((start[like] - start).astype(np.int32 if len(data) < 1 << 31 else np.int64), length)
        other += np.arange(len(data), dtype=other.dtype)
        differs = data != data.take(other, mode="clip")
        if differs.any():
            unlike |= np.logical_or.reduceat(differs, start)
        if unlike.any():
            raw, names, more = data.tobytes(), {}, list(first)
            for i in np.flatnonzero(unlike).tolist():
                name = raw[start[i] : end[i]]
                if name not in names:
                    names[name] = len(more)
                    more.append(i)
                code[i] = names[name]
            first = np.array(more)
        return code, first


_encoders: dict[str, SegmentEncoder] = {}


def encoder_of(path: str) -> SegmentEncoder:
    """The worker's encoder for that file; a module's function, so that tasks share it."""
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        encoder = encoder_of(path)
        part, nth, size = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []

        def shard():
            image = WaveletMatrix.build(np.concatenate(ids), np.array(lengths, np.int64)).dump()
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, nth, sum(lengths), docs, image), _SHARD, strict=True)], schema=_SHARD)
            docs.clear(), ids.clear(), lengths.clear()
            return out

        for batch in batches:
            for at, to in slices(batch.column(1), 2 << 20):
                found, many = encoder(batch.column(1).slice(at, to - at))
                ends = np.cumsum(many)
                # Each document with its end id, then cut where a shard is full.
                found = np.insert(found, ends, end_id)
                many, ends = many + 1, ends + np.arange(1, len(many) + 1)
                names, low = batch.column(0).slice(at, to - at).to_pylist(), 0
                while low < len(names):
                    before = ends[low - 1] if low else 0
                    high = int(np.searchsorted(ends, before + most - size, "right"))
                    if high <= low and docs:
                        yield shard()
                        nth, size = nth + 1, 0
                        continue
                    high = max(high, low + 1)
                    docs += names[low:high]
                    ids.append(found[before : ends[high - 1]])
                    lengths += many[low:high].tolist()
                    size += int(ends[high - 1] - before)
                    low = high
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes whole texts, in order of doc_id (nulls first, ties by a hash of the text), into the images of a written table.

    Columns: part, nth (order of shards), start (ids before the shard), n_ids, doc_ids, image.  A null text is
    empty; each document ends with end_id.  Repeated rows are documents of their own; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, are spread by a hash of their text.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_mark")]
    ordered = docs.withColumn("_mark", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    images = ordered.mapInArrow(tidied(_encode(tokenizer, end_id, shard_ids)), "part int, nth int, n_ids long, doc_ids array<long>, image binary")
    images = written(images, rows_in_file=1)
    # Offsets: one row per part is ordered in one task, the shards of a part in another.
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = images.select("part", "nth", own.alias("inside")).join(parts, "part").select("part", "nth", (F.col("base") + F.col("inside")).alias("start"))
    return images.join(starts, ["part", "nth"])


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            shard = WaveletMatrix.load(row["image"])
            raw, at = shard.ids().astype("<u4").tobytes(), shard.starts
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + row["start"]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from ids extracted from the images."""
    return images.select("start", "doc_ids", "image").mapInArrow(tidied(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
