"""Removal of repeated byte strings, by difference-cover blockwise suffix sorting.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere else in the
collection (judged on the input). The strings, as suffixes cut at LENGTH bytes, are sorted one
suffix bucket at a time:

* A bucket holds the suffixes that share an anchor: the least-hashed GRAM-byte string among those
  inside the first LENGTH bytes (the leftmost of equals). Equal strings have equal anchors at the
  same place, so no repeat is ever split between buckets. Suffixes next to each other share their
  anchor mostly; such a run moves as one short row of digests, not as text.
* Runs that are equal as a whole are settled by their 128-bit digests. Where runs of a bucket
  differ, they are cut on a grid around the anchor, and the parts go to finer buckets by the
  bytes that all suffixes of the part share.
* Within a block of finer buckets (BLOCK bytes at a time) suffixes are sorted by their first and
  last bytes, and long ties between them are resolved by ranks computed beforehand for the
  suffixes at difference-cover positions only: {0, 1, 3} modulo 7.
* A finer bucket larger than a block leaves as digests of its single suffixes, which are counted
  by a distributed aggregate; so memory is bounded whatever repeats.

Digests of equal strings are equal; for different ones 128 bits are taken to differ.

A passage of over 50 words is often shorter than LENGTH bytes. With ``passages``, bytes also go when
a passage of WORDS words that covers them starts anywhere else; white space between the words may
differ. Its suffixes are those of the sequence of word hashes (64 bits), bucketed by anchors of
WORD_GRAM words and settled as above; where runs of a bucket differ, their passages are counted
by digest, one row each.

Cases: null text is empty; texts below LENGTH bytes keep all; equal documents and repeated rows
are repeats of each other; an empty table gives no rows; extra columns pass through ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, hold, materialize, release, sent_if_small

LENGTH = 400
GRAM = 160
GRID = 32
WORDS, WORD_GRAM = 51, 16
BLOCK = 2_000_000
PIECE = 1 << 22
COVER, PERIOD = (0, 1, 3), 7
SHIFT = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            x = np.full(size, b)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def runs(text: bytes | np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first suffix, last suffix, anchor) of every run of a text or of its word hashes."""
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        part = text[at : at + PIECE + length - 1]
        n = len(part)
        if n < length:
            return
        up, down = _power(n)
        total = np.zeros(n + 1, np.uint64)
        units = np.frombuffer(part, np.uint8).astype(np.uint64) if isinstance(part, bytes) else part
        np.cumsum((units + np.uint64(1)) * up, out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        width = length - gram + 1
        bits = np.uint64(23)
        key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // width)
        grid = np.full(rows * width, np.iinfo(np.uint64).max)
        grid[: len(key)] = key
        grid = grid.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - length + 1
        anchor = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [m - 1]])
        a = anchor[first]
        yield from zip(h[a].view(np.int64).tolist(), (first + at).tolist(), (last + at).tolist(), (a + at).tolist(), strict=True)


def _digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


RUNS = "g long, r1 long, r2 long, t1 long, t2 long, first long, last long, anchor long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold(_powers)
    names = [x.split()[0] for x in RUNS.split(", ")]
    for b in batches:
        rows = []
        for text, t1, t2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for g, first, last, anchor in runs(text):
                rows.append((g, *_digest(text[first : last + LENGTH]), t1, t2, first, last, anchor))
                if len(rows) >= 50_000:
                    yield _batch(rows, names, [pa.int64()] * 8)
                    rows = []
        yield _batch(rows, names, [pa.int64()] * 8)


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold(_powers, _hashes)
    names = [x.split()[0] for x in RUNS.split(", ")]
    for b in batches:
        rows = []
        for text, t1, t2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = word_hashes(text)
            data = words.tobytes()
            for g, first, last, anchor in runs(words, WORDS, WORD_GRAM):
                rows.append((g, *_digest(data[8 * first : 8 * (last + WORDS)]), t1, t2, first, last, anchor))
                if len(rows) >= 50_000:
                    yield _batch(rows, names, [pa.int64()] * 8)
                    rows = []
        yield _batch(rows, names, [pa.int64()] * 8)


PARTS = "c1 long, c2 long, t1 long, t2 long, at long, lead int, content binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts runs on the grid around their anchor; c: digest of what all suffixes of a part share."""
    hold(_powers)
    names, kinds = [x.split()[0] for x in PARTS.split(", ")], [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    for b in batches:
        rows = []
        for text, t1, t2, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for w in wanted:
                first, last, anchor = w["first"], w["last"], w["anchor"]
                for q in range((first - anchor) // GRID, (last - anchor) // GRID + 1):
                    low = anchor + GRID * q
                    lo, hi = max(first, low), min(last, low + GRID - 1)
                    rows.append((*_digest(text[low + GRID - 1 : low + LENGTH]), t1, t2, lo, lo - low, text[lo : hi + LENGTH]))
            if len(rows) > 5_000:
                yield _batch(rows, names, kinds)
                rows = []
        yield _batch(rows, names, kinds)


def repeated(contents: list[bytes], leads: list[int]) -> list[np.ndarray]:
    """For each content, which of its suffixes (cut at LENGTH) occur at another place of the block.

    Equal suffixes have equal places on the grid (lead + position), so contents are laid out
    with grid places congruent to text positions modulo the cover's period.
    """
    starts, at = [], 0
    pieces = []
    for c, lead in zip(contents, leads, strict=True):
        pad = (lead - at) % PERIOD
        pieces += [b"\0" * pad, c]
        starts.append(at + pad)
        at += pad + len(c)
    size = -(-(at + 2 * LENGTH) // PERIOD) * PERIOD
    text = np.zeros(size + 8, np.uint64)
    text[:at] = np.frombuffer(b"".join(pieces), np.uint8)
    eight = np.zeros(size, np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | text[k : size + k]
    # Ranks of the cover's suffixes, cut at 7, 14, .. 224 bytes and then at 392.
    cells = size // PERIOD
    rank = np.empty((len(COVER), cells), np.int64)
    _, r = np.unique(np.stack([eight.reshape(cells, PERIOD)[:, c] >> np.uint64(8) for c in COVER]).ravel(), return_inverse=True)
    rank[:] = r.reshape(rank.shape)

    def joined(step: int) -> np.ndarray:
        after = np.zeros_like(rank)
        after[:, : cells - step] = rank[:, step:] + 1
        _, r = np.unique((rank * (rank.max() + 2) + after).ravel(), return_inverse=True)
        return r.reshape(rank.shape)

    for step in (1, 2, 4, 8, 16):
        rank = joined(step)
    rank = joined(24)  # 224 bytes, and 224 from 168 on
    spots = np.concatenate([s + np.arange(len(c) - LENGTH + 1) for s, c in zip(starts, contents, strict=True)])
    covered = spots + SHIFT[spots % PERIOD]
    row = np.zeros(PERIOD, np.int64)
    row[list(COVER)] = range(len(COVER))
    middle = rank[row[covered % PERIOD], covered // PERIOD]
    order = np.lexsort((eight[spots + 392], middle, spots % PERIOD, eight[spots]))
    s, m = spots[order], middle[order]
    same = (eight[s][1:] == eight[s][:-1]) & (m[1:] == m[:-1]) & (s[1:] % PERIOD == s[:-1] % PERIOD) & (eight[s + 392][1:] == eight[s + 392][:-1])
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.zeros(len(s), bool)
    out[order] = hit
    return np.split(out, np.cumsum([len(c) - LENGTH + 1 for c in contents])[:-1])


FOUND = "t1 long, t2 long, first long, last long, s1 long, s2 long"


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole finer buckets, sorted one at a time; a bucket beyond a block leaves as digests (s1, s2)."""
    hold()
    names, kinds = [x.split()[0] for x in FOUND.split(", ")], [pa.int64()] * 6
    block: list[tuple] = []
    bucket: list[tuple] = []
    block_size = bucket_size = 0
    key, spilled, place = None, False, None

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (t1, t2, at, _, _), hit in zip(rows, repeated([r[4] for r in rows], [r[3] for r in rows]), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
            out += [(t1, t2, at + a, at + b - 1, None, None) for a, b in edges.reshape(-1, 2).tolist()]
        return _batch(out, names, kinds)

    def single(rows: list[tuple]) -> pa.RecordBatch:
        return _batch([(t1, t2, at + k, at + k, *_digest(c[k : k + LENGTH])) for t1, t2, at, _, c in rows for k in range(len(c) - LENGTH + 1)], names, kinds)

    def close():
        nonlocal block, bucket, block_size, bucket_size
        if spilled:
            yield single(bucket)
        elif len(bucket) > 1:
            block += bucket
            block_size += bucket_size
            if block_size >= BLOCK:
                yield sort(block)
                block, block_size = [], 0
        bucket, bucket_size = [], 0

    for b in batches:
        for c1, c2, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (c1, c2):
                yield from close()
                key, spilled, place = (c1, c2), False, None
            if place == row[:3]:
                continue
            place = row[:3]
            bucket.append(tuple(row))
            bucket_size += len(row[4])
            if bucket_size > BLOCK:
                yield single(bucket)
                spilled, bucket, bucket_size = True, [], 0
    yield from close()
    if block:
        yield sort(block)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of wanted runs, each by its digest."""
    hold(_hashes)
    names, kinds = [x.split()[0] for x in FOUND.split(", ")], [pa.int64()] * 6
    for b in batches:
        rows = []
        for text, t1, t2, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = word_hashes(text).tobytes()
            for w in wanted:
                rows += [(t1, t2, k, k, *_digest(data[8 * k : 8 * (k + WORDS)])) for k in range(w["first"], w["last"] + 1)]
            if len(rows) > 50_000:
                yield _batch(rows, names, kinds)
                rows = []
        yield _batch(rows, names, kinds)


def text_key(text: Column) -> list[Column]:
    """128 bits of the SHA-256 of the bytes, as two numbers."""
    h = F.sha2(text, 256)
    return [F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("t1"), F.conv(F.substring(h, 17, 15), 16, 10).cast("long").alias("t2")]


def spans(docs: DataFrame, text_col: str = "text", of_words: bool = False) -> DataFrame:
    """(t1, t2, found): per distinct text with repeats, its suffixes [first, last] that start a repeated string, or by words a repeated passage."""
    least = 2 * WORDS - 1 if of_words else LENGTH
    texts = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).filter(F.length("text") >= least)
    texts = texts.select("text", *text_key(F.col("text")))
    spark = docs.sparkSession
    every = materialize(texts.mapInArrow(_word_runs if of_words else _runs, RUNS), "runs")
    # Most anchors occur once; their runs have no repeat and take no further part.
    lively = materialize(every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "anchors")
    release(spark)
    some = materialize(every.join(sent_if_small(lively), "g", "left_semi"), "runs")
    discard(every)
    discard(lively)
    release(spark)
    kinds = some.groupBy("g", "r1", "r2").agg(F.count("*").alias("n"))
    # Of buckets with several kinds of run, one run per kind is looked into.
    mixed = kinds.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("g")
    open_ = some.join(mixed, "g", "left_semi").groupBy("g", "r1", "r2").agg(F.min(F.struct("t1", "t2", "first", "last", "anchor")).alias("one")).select("one.*")
    wanted = materialize(open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last", "anchor")).alias("wanted")), "wanted")
    del open_
    release(spark)
    found = materialize(_looked_into(texts, wanted, of_words), "found")
    discard(wanted)
    release(spark)
    whole = kinds.filter("n > 1").select("r1", "r2")
    settled = some.join(whole, ["r1", "r2"]).select("t1", "t2", "first", "last")
    big = found.filter("s1 IS NOT NULL")
    # Copies of one text bring the same place again.
    places = [c for k in ("t1", "t2", "first") for c in (F.min(k).alias(f"a_{k}"), F.max(k).alias(f"z_{k}"))]
    many = big.groupBy("s1", "s2").agg(*places).filter("a_t1 <> z_t1 OR a_t2 <> z_t2 OR a_first <> z_first").select("s1", "s2")
    sorted_ = found.filter("s1 IS NULL").select("t1", "t2", "first", "last").unionByName(big.join(many, ["s1", "s2"]).select("t1", "t2", "first", "last"))
    out = materialize(settled.unionByName(sorted_).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("found")), "spans")
    discard(some)
    discard(found)
    del kinds, mixed, whole, settled, big, many, sorted_
    release(spark)
    return out


def _looked_into(texts: DataFrame, wanted: DataFrame, of_words: bool) -> DataFrame:
    asked = texts.join(sent_if_small(wanted), ["t1", "t2"]).select("text", "t1", "t2", "wanted")
    if of_words:
        return asked.mapInArrow(_passages, FOUND)
    parts = asked.mapInArrow(_parts, PARTS)
    # Copies of one text bring equal parts, which the order puts side by side; _sort takes one of them.
    return parts.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "t1", "t2", "at").mapInArrow(_sort, FOUND)


def _removed(found: list | None, passages: list | None = None, text: bytes = b"") -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove."""
    out: list[list[int]] = []
    cuts = [(f["first"], f["last"] + LENGTH) for f in found or ()]
    if passages:
        words = [m.span() for m in re.finditer(rb"\S+", text)]
        cuts += [(words[f["first"]][0], words[f["last"] + WORDS - 1][1]) for f in passages]
    for a, b in sorted(cuts):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: bytes, drop: list[tuple[int, int]]) -> bytes:
    done, kept = 0, []
    for a, b in drop:
        kept.append(text[done:a])
        done = b
    return b"".join([*kept, text[done:]])


def _apply(docs: DataFrame, keep: list[str], text_col: str, fn, names: list[str], kinds: list[pa.DataType], ddl: str, passages: bool) -> DataFrame:
    """Joins every document with its text's spans and maps (text, removed) to new columns."""
    found = spans(docs, text_col)
    if passages:
        found = found.join(spans(docs, text_col, of_words=True).withColumnRenamed("found", "passages"), ["t1", "t2"], "full_outer")
    else:
        found = found.withColumn("passages", F.lit(None).cast("array<struct<first:bigint,last:bigint>>"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    left = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text.alias("text"), *text_key(text))
    rows = left.join(found, ["t1", "t2"], "left").select(*[f"k{i}" for i in range(len(keep))], "text", "found", "passages")
    fields = StructType(docs.select(*keep).schema.fields)
    schema = ", ".join([f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + [ddl])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fn(t, _removed(f, p, t)) for t, f, p in zip(*(b.column(n + k).to_pylist() for k in range(3)), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*b.schema.names[:n], *names])

    return rows.mapInArrow(run, schema).toDF(*keep, *names)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. passages: repeated passages of WORDS words go as well."""

    def fn(text: bytes, drop: list[tuple[int, int]]) -> tuple:
        return len(text), sum(b - a for a, b in drop), len(drop), hashlib.sha256(_cut(text, drop)).hexdigest()

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return _apply(docs, [id_col], text_col, fn, names, [pa.int64()] * 3 + [pa.string()], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", passages)


def clean(docs: DataFrame, text_col: str = "text", passages: bool = False) -> DataFrame:
    """docs with repeated strings (and passages) cut out of the text; a character cut in part goes whole. Null texts stay null."""
    keep = [c for c in docs.columns if c != text_col]
    flagged = docs.withColumn("__null", F.col(text_col).isNull())

    def fn(text: bytes, drop: list[tuple[int, int]]) -> tuple:
        return (_cut(text, drop).decode("utf-8", "ignore"),)

    out = _apply(flagged, [*keep, "__null"], text_col, fn, [text_col], [pa.string()], "new string", passages)
    return out.withColumn(text_col, F.when(~F.col("__null"), F.col(text_col))).select(*docs.columns)
