"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised alike (ASCII lower case; words are runs of digits, letters
and non-ASCII bytes). One automaton holds all items of a bounded shard. A document streams
through it once; the automaton tracks the longest match that ends at each word, and suffix
links lead from there to every item window (``window`` words, or a whole shorter item) that
ends there. Spans at least ``max_span`` words long are removed, and documents whose share of
hit words passes ``max_coverage`` are dropped.

The benchmark is cut into shards of at most SHARD_WORDS words (long items into overlapping
pieces), so what a task holds is bounded however large the benchmark grows; every shard is one
more pass over the documents.

An item of fewer than ``max_span`` words is found and counted as any other, but ``clean`` leaves its
words in a document that it keeps, unless they are part of a longer hit span.

Cases: null text has no words; null or empty items, and items with null ids, hit nothing;
repeated items count once per id; an empty benchmark leaves every document clean; extra
columns pass through; columns that clash with the operator's own are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialize

WINDOW = 8
#: Words of benchmark text in one automaton.
SHARD_WORDS = 200_000
PIECE_WORDS = 20_000

_keep = [c for c in range(256) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128]
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _keep else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """States: next maps of words, suffix links, longest lengths, and the windows that a state ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        ends: list[dict[int, set[str]]] = [{} for _ in self.next]
        for item, seq in items:
            size = min(window, len(seq))
            state = length = 0
            for w in seq:
                state, length = self.step(state, length, w)
                at = state
                while self.len[self.link[at]] >= size:
                    at = self.link[at]
                if length >= size:
                    ends[at].setdefault(size, set()).add(item)
        # outputs[s]: (length, items) of windows on the suffix path of s, shortest first
        self.outputs: list[tuple] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            own = tuple((n, tuple(sorted(x))) for n, x in sorted(ends[s].items()))
            self.outputs[s] = self.outputs[self.link[s]] + own

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        return len(self.next) - 1

    def step(self, state: int, length: int, w: bytes) -> tuple[int, int]:
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            length = self.len[state]
        if w in nxt[state]:
            return nxt[state][w], length + 1
        return 0, 0

    def scan(self, seq: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal hit spans as [first, past last] word, and the items hit."""
        spans: list[list[int]] = []
        hit: set[str] = set()
        root, nxt, outputs, step = self.next[0], self.next, self.outputs, self.step
        state = length = 0
        for i, w in enumerate(seq):
            if not state:
                if w in root:
                    state, length = root[w], 1
                else:
                    continue
            elif w in nxt[state]:
                state = nxt[state][w]
                length += 1
            else:
                state, length = step(state, length, w)
            out = outputs[state]
            if out and out[0][0] <= length:
                best = 0
                for n, items in out:
                    if n <= length:
                        best = n
                        hit.update(items)
                first = i + 1 - best
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return spans, hit


_automata: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str, list[bytes]]], window: int) -> Automaton:
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(items, window)
    return _automata[key]


def _cut(window: int):
    """Items as pieces of a bounded size that overlap by a window less one word."""
    size = max(PIECE_WORDS, 2 * window)
    step = size - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, b" ".join(w[k : k + size]), len(w[k : k + size])) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and (w := words(t)) for k in (range(0, max(1, len(w) - window + 1), step))]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["item_id", "piece", "n"])

    return run


def shards(bench: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> list[list[tuple[str, list[bytes]]]]:
    """The benchmark's pieces, in shards whose size is checked before any of them is fetched."""
    pieces = bench.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_cut(window), "item_id string, piece binary, n long").distinct()
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= SHARD_WORDS:
        return [[(r.item_id, bytes(r.piece).split()) for r in pieces.collect()]] if total else []
    pieces = materialize(pieces, "benchmark")
    n = -(-2 * total // SHARD_WORDS)
    return [_Lazy(pieces, n, k) for k in range(n)]


class _Lazy:
    """One shard of a large benchmark, fetched only when its pass begins."""

    def __init__(self, pieces: DataFrame, n: int, k: int):
        self.pieces, self.n, self.k = pieces, n, k

    def __iter__(self):
        rows = self.pieces.filter(F.pmod(F.xxhash64("item_id", "piece"), F.lit(self.n)) == self.k).collect()
        return iter([(r.item_id, bytes(r.piece).split()) for r in rows])


FOUND = "spans array<array<int>>, items array<string>, n_words long"


def find(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, cut: int | None = None) -> DataFrame:
    """docs with ``spans`` (merged hit word spans), ``items`` (ids hit, sorted as strings) and ``n_words``.

    cut: spans of so many words or more are taken out of the text, by the pass that finds them (another
    Python function would need more workers, which stay in memory).
    """
    docs = docs.drop("spans", "items", "n_words")
    parts = shards(bench, item_id, item_text, window) or [[]]
    out = docs
    for k, part in enumerate(parts):
        if k:
            out = materialize(out, "scanned")
        out = _pass(out, list(part), text_col, window, bool(k), cut if k == len(parts) - 1 else None)
    return out


def _pass(docs: DataFrame, items: list, text_col: str, window: int, more: bool, cut: int | None) -> DataFrame:
    spark = docs.sparkSession
    key = hashlib.sha256(json.dumps([[i, [w.hex() for w in s]] for i, s in items]).encode() + b"%d" % window).hexdigest()
    held = spark.sparkContext.broadcast(items)
    at = docs.columns.index(text_col)
    n = len(docs.columns) - 3 * more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_automata)
        sam = _automaton(key, held.value, window)
        for b in batches:
            spans, hit, counts, kept = [], [], [], []
            for k, text in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
                seq = words(text)
                s, h = sam.scan(seq)
                if more:
                    s = merge(b.column(n)[k].as_py() + s)
                    h |= set(b.column(n + 1)[k].as_py())
                spans.append(s)
                hit.append(sorted(h))
                counts.append(len(seq))
                if cut is not None:
                    drop = [x for x in s if x[1] - x[0] >= cut]
                    kept.append(_remove(text, drop) if drop else text)
            own = [b.column(i) for i in range(n)]
            if cut is not None:
                own[at] = pa.array(kept, pa.binary()).cast(own[at].type, safe=False)
            cols = own + [pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(hit, pa.list_(pa.string())), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:n], "spans", "items", "n_words"])

    schema = docs.schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:n])
    return docs.mapInArrow(run, f"{kept}, {FOUND}" if kept else FOUND)


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without hit spans of ``max_span`` words or more, and without documents hit beyond ``max_coverage``; columns as they came."""
    names = docs.columns
    found = find(docs, bench, text_col, item_id, item_text, window, max_span).filter(hit_words() <= max_coverage * F.col("n_words"))
    return found.select(*names)


def _remove(raw: bytes, drop: list[list[int]]) -> bytes:
    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    done, kept = 0, []
    for a, b in drop:
        kept.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*kept, raw[done:]])
