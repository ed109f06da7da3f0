"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each partition keeps a fixed number of open windows. A document goes best-fit into the
window with the least room that still holds it; when none fits, the fullest window is
emitted. Documents longer than a window are cut into full windows first, and the emitted
window's gap is filled by a cut from the waiting document where it is worth a cut. What is
still open when a partition ends is small metadata; those windows are merged across
partitions in bounded groups.

Cases: null text is empty; an empty text is one end token; null ids pass through; repeated
ids are separate documents; very long texts are cut; an empty table gives no rows; extra
columns are ignored. Tokens never leave the task that made them: only piece metadata does.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, hold, materialize, trim

MAX_LENGTH = 2048
OPEN_WINDOWS = 64
#: A gap smaller than this is padded, not filled by a cut.
MIN_CUT = 32
END_ID = 1
#: Words remembered by a worker; later ones are encoded each time.
CACHE_ENTRIES = 1_200_000
#: Bytes of text whose new words are encoded together.
GROUP_BYTES = 1 << 20
#: Rows of a batch that are Python objects at a time.
SLICE = 512
#: The tokenizer splits between a letter and a run of punctuation, so a space there changes nothing.
BEFORE_STOP = re.compile(rb"([a-z])([.,])")
MERGE_GROUP = 8192
#: What a tokenizer must encode alike word by word and whole, for words to be remembered.
PROBES = [b"The Quick  brown\tfox.\nJumps, over 3.14 (lazy) dogs...", "Na\u00efve \u00c9t\u00e9,x a.b,c \u6f22\u5b57 don't_stop\r\n#1!".encode()]

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, unit long, offset long, used int, closed boolean"


class Encoder:
    """Token ids as little-endian uint32 bytes.

    Runs without ASCII white space (lower-cased) are remembered. The new ones of some texts are taken
    apart before a full stop or comma after a letter, and new parts are encoded in one call. That
    holds for tokenizers that lower-case, split at white space and drop it, and split there; it is
    tried on probes, and texts go to any other tokenizer whole. So do texts that may hold
    special-token strings.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()] or [b"\x00\x00"]
        self.cache: dict[bytes, bytes] = {}
        self.by_word = all(self._ids(p.decode()) == next(self._by_word([p])) for p in PROBES)
        self.cache.clear()

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; words are looked up for GROUP_BYTES of texts at a time."""
        group, size = [], 0
        for text in texts:
            if not self.by_word or any(s in text for s in self.special):
                yield from self._by_word(group)
                group, size = [], 0
                yield self._ids(text.decode("utf-8", "replace"))
                continue
            group.append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield from self._by_word(group)
                group, size = [], 0
        yield from self._by_word(group)

    def _by_word(self, texts: list[bytes]) -> Iterator[bytes]:
        cache = self.cache
        words = [text.translate(ASCII_LOWER).split() for text in texts]
        parts = {w: BEFORE_STOP.sub(rb"\1 \2", w).split() for w in set().union(*words).difference(cache)}
        found = self._encoded(list(set().union(*parts.values()).difference(cache)))
        for w, own in parts.items():
            if len(own) > 1:
                found[w] = b"".join([found[p] if p in found else cache[p] for p in own])
        if len(cache) + len(found) <= CACHE_ENTRIES:
            cache.update(found)
            for own in words:
                yield b"".join(map(cache.__getitem__, own))
        else:
            for own in words:
                yield b"".join([found[w] if w in found else cache[w] for w in own])

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        if not words:
            return {}
        texts = [w.decode("utf-8", "replace") for w in words]
        one = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = _pack(one.ids)
        # A token belongs to the word that its first character lies in.
        ends = np.cumsum([len(t) + 1 for t in texts])
        cut = (4 * np.searchsorted(np.array([a for a, _ in one.offsets], np.int64), ends)).tolist()
        return {w: ids[a:b] for w, a, b in zip(words, [0, *cut], cut, strict=False)}

    def _ids(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _pack(ids: list[int]) -> bytes:
    import array
    import sys

    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Packer:
    """Open windows of one partition. Pieces are tuples (payload..., length)."""

    def __init__(self, size: int, windows: int, min_cut: int | None):
        self.size, self.windows, self.min_cut = size, windows, min_cut
        self.open: list[tuple[int, int]] = []  # (room, unit), sorted
        self.held: dict[int, list] = {}
        self.next = 0
        self.done: list[tuple[int, list, int, bool]] = []
        self.cuts: list[tuple[int, int]] = []  # (start, length) of the document added last

    def _close(self, room: int, unit: int, closed: bool = True) -> None:
        self.done.append((unit, self.held.pop(unit), self.size - room, closed))

    def _put(self, room: int, unit: int, piece: tuple, length: int) -> None:
        self.held[unit].append((piece, length, self.size - room))
        self.cuts.append((piece[1], length))
        if room == length:
            self._close(0, unit)
        else:
            bisect.insort(self.open, (room - length, unit))

    def _new(self) -> tuple[int, int]:
        unit = self.next
        self.next += 1
        self.held[unit] = []
        return self.size, unit

    def add(self, key: tuple, length: int) -> None:
        start, self.cuts = 0, []
        while length - start >= self.size:
            room, unit = self._new()
            self._put(room, unit, (key, start), self.size)
            start += self.size
        while start < length or (length == 0 and start == 0):
            rest = length - start
            at = bisect.bisect_left(self.open, (rest, -1))
            if at < len(self.open):
                room, unit = self.open.pop(at)
                self._put(room, unit, (key, start), rest)
                return
            if len(self.open) < self.windows:
                room, unit = self._new()
                self._put(room, unit, (key, start), rest)
                return
            room, unit = self.open.pop(0)
            if self.min_cut is not None and room >= self.min_cut and rest - room >= self.min_cut:
                self._put(room, unit, (key, start), room)
                start += room
            else:
                self._close(room, unit)

    def finish(self) -> None:
        for room, unit in self.open:
            self._close(room, unit, False)
        self.open = []


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, size: int, windows: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_encoders)
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        base = TaskContext.get().partitionId() << 33
        packer = Packer(size, windows, min_cut)
        end = _pack([END_ID])

        def flush() -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(9)]
            for unit, held, used, closed in packer.done:
                for (key, start), length, offset in held:
                    doc_id, total, crcs = key
                    for c, v in zip(out, (doc_id, start, length, crcs[start], total, base + unit, offset, used, closed), strict=True):
                        c.append(v)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 7 + [pa.int32(), pa.bool_()], strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([text or b"" for text in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    crcs: dict[int, int] = {}
                    packer.add((doc_id, total, crcs), total)
                    for start, length in packer.cuts:
                        crcs[start] = zlib.crc32(ids[4 * start : 4 * (start + length)])
            yield flush()
        trim()
        packer.finish()
        yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = materialize(raw.mapInArrow(_pieces(tokenizer_path, max_length, open_windows, min_cut), PIECES), "pieces")
    closed = pieces.filter("closed").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("unit").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    left = pieces.filter("not closed")
    units = left.filter("offset = 0").select("unit", "used")
    groups = max(1, -(-units.count() // MERGE_GROUP))
    merged = units.repartition(groups, "unit").sortWithinPartitions(F.desc("used"), "unit").mapInArrow(_merge(max_length), "unit long, sequence_id long, base long")
    moved = left.join(merged, "unit").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return closed.unionByName(moved)


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer = Packer(size, MERGE_GROUP, None)
        for batch in batches:
            for unit, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add((unit,), used)
        packer.finish()
        rows = [(key[0], -(base + seq) - 1, offset) for seq, held, _, _ in packer.done for (key, _), _, offset in held]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["unit", "sequence_id", "base"])

    return run
