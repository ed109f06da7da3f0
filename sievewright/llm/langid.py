"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of byte counts. A byte that its context has seen
costs -log2(c / (n + d)) bits, where the context saw it c times among n bytes of d kinds; else
the escape costs -log2(d / (n + d)) and the next shorter context is asked, down to a uniform
choice over all byte values. The statistics are frozen after training, so the cost of every
(context, byte) is worked out once, for all languages side by side; scoring a text is then exact
table look-ups over the whole of it, and the language of the shortest code wins.

Training reads a bounded sample: SAMPLE_BYTES over all languages, in expectation, by a hash of the
id. It takes texts of up to SAMPLE_TEXT bytes whole, and longer ones in pieces of that size, each
drawn by itself.

Cases: null text and text without a letter is ``und`` with score 0; so is everything when nothing
was learned; null languages teach nothing; very long texts are scored in pieces that know what
came before; rows repeated are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
SAMPLE_BYTES = 6_000_000
SAMPLE_TEXT = 65_536
#: A context is kept when the languages together saw it so often.
LEAST_SEEN = 3
#: Cells of the cost table: contexts x symbols x languages.
MAX_CELLS = 12_000_000
PIECE = 1 << 20


class Trees:
    """Cost tables of all languages. Symbol 0 stands before a text, symbol 1 for bytes never seen."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.langs = order, sorted(texts)
        nl = len(self.langs)
        seen = np.zeros(256, np.int64)
        for x in texts.values():
            for t in x:
                seen += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        self.symbol = np.ones(256, np.uint8) if not seen.any() else np.where(seen > 0, np.cumsum(seen > 0) + 1, 1).astype(np.uint8)
        a = self.a = int((seen > 0).sum()) + 2
        if not nl:
            return
        joined = []
        for lang in self.langs:
            parts = []
            for t in texts[lang]:
                parts += [np.zeros(order, np.int64), self.symbol[np.frombuffer(t, np.uint8)].astype(np.int64)]
            joined.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        # Counts of (context of k symbols, symbol), per language; pads are no symbols to predict.
        room = max(1, MAX_CELLS // (a * nl) - 1)
        floor = np.full((1, a, nl), 1.0 / 256)
        self.next: list[np.ndarray] = []
        tables, codes_before = [], np.zeros(1, np.int64)
        base_before, above = 0, None
        for k in range(order + 1):
            counts = []
            for s in joined:
                n = len(s) - k
                code = np.zeros(max(0, n), np.int64)
                for j in range(k + 1):
                    code = code * a + s[j : j + n]
                u, c = np.unique(code[s[k:] > 0] if n > 0 else code, return_counts=True)
                counts.append((u, c))
            if k == 0:
                codes = np.zeros(1, np.int64)
            else:
                total: dict[int, int] = {}
                ctx = np.concatenate([u // a for u, _ in counts])
                u, at = np.unique(ctx, return_inverse=True)
                sums = np.bincount(at, np.concatenate([c for _, c in counts]), len(u))
                keep = np.flatnonzero(sums >= LEAST_SEEN)
                if len(keep) > room:
                    keep = np.sort(keep[np.argsort(-sums[keep], kind="stable")[:room]])
                codes = u[keep]
                room -= len(codes)
                del total
            grid = np.zeros((len(codes), a, nl))
            for i, (u, c) in enumerate(counts):
                row = np.searchsorted(codes, u // a)
                ok = (row < len(codes)) & (codes[np.minimum(row, max(0, len(codes) - 1))] == u // a) if len(codes) else np.zeros(len(u), bool)
                grid[row[ok], u[ok] % a, i] = c[ok]
            n, d = grid.sum(1, keepdims=True), (grid > 0).sum(1, keepdims=True)
            if k == 0:
                shorter = np.repeat(floor, len(codes), axis=0)
            else:
                # The suffix context: the oldest symbol dropped; its longest kept form.
                shorter = above[self._rows(tables, codes % a ** (k - 1), k - 1)]
            p = np.where(grid > 0, grid / np.maximum(1, n + d), np.where(n > 0, d / np.maximum(1, n + d), 1.0) * shorter)
            tables.append(codes)
            above = p if above is None else np.concatenate([above, p])
        self.codes = tables
        self.cost = (-np.log2(above)).astype(np.float32)
        self.base = np.concatenate([[0], np.cumsum([len(c) for c in tables])])
        # next[k][id of the k-1 symbols before, symbol] -> id + 1 of the k-symbol context, 0: none
        for k in range(1, order + 1):
            step = np.zeros((len(tables[k - 1]) + 1, a), np.int32)
            old, new = tables[k] // a, tables[k] % a
            row = np.searchsorted(tables[k - 1], old)
            ok = (row < len(tables[k - 1])) & (tables[k - 1][np.minimum(row, len(tables[k - 1]) - 1)] == old) if len(tables[k - 1]) else np.zeros(len(old), bool)
            step[row[ok] + 1, new[ok]] = np.flatnonzero(ok) + 1
            self.next.append(step)

    def _rows(self, tables: list[np.ndarray], codes: np.ndarray, k: int) -> np.ndarray:
        """Row of the longest kept suffix of each k-symbol context."""
        base = np.concatenate([[0], np.cumsum([len(c) for c in tables])])
        out = np.zeros(len(codes), np.int64)
        open_ = np.ones(len(codes), bool)
        for j in range(k, -1, -1):
            want = codes % self.a**j
            t = tables[j]
            if not len(t):
                continue
            row = np.searchsorted(t, want)
            hit = open_ & (row < len(t)) & (t[np.minimum(row, len(t) - 1)] == want)
            out[hit] = base[j] + row[hit]
            open_ &= ~hit
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, bytes, bytes]] = []
        size = 0
        for k, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                held.append((k, t[max(0, at - self.order) : at] if at else b"", t[at : at + PIECE]))
                size += len(held[-1][2])
                if size >= PIECE:
                    self._add(held, out)
                    held, size = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes, bytes]], out: np.ndarray) -> None:
        parts, edges, at = [], [], 0
        for _, before, t in held:
            pad = np.zeros(self.order, np.uint8)
            if before:
                pad[self.order - len(before) :] = self.symbol[np.frombuffer(before, np.uint8)]
            parts += [pad, self.symbol[np.frombuffer(t, np.uint8)]]
            edges += [at + self.order, at + self.order + len(t)]
            at += self.order + len(t)
        s = np.concatenate(parts).astype(np.int32)
        row = np.zeros(len(s), np.int64)  # of the longest context that ends at each place
        ids = np.ones(len(s), np.int32)  # of the empty context
        for k in range(1, self.order + 1):
            now = np.zeros(len(s), np.int32)
            if k == 1:
                now[:] = self.next[0][1, s]
            else:
                now[1:] = self.next[k - 1][ids[:-1], s[1:]]
            row = np.where(now > 0, self.base[k] + now - 1, row)
            ids = now
        nl = len(self.langs)
        spent = np.zeros((len(s) + 1, nl), np.float32)
        spent[1:-1] = self.cost.reshape(-1, nl)[row[:-1] * self.a + s[1:]]
        sums = np.add.reduceat(spent, edges, axis=0, dtype=np.float64)[::2]
        np.add.at(out, [k for k, _, _ in held], sums)


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Trees:
    own = docs.filter(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    own = own.select("lang", "id", F.posexplode(F.expr(f"transform(sequence(0, CAST(greatest(length(text) - 1, 0) DIV {SAMPLE_TEXT} AS INT)), k -> substring(text, k * {SAMPLE_TEXT} + 1, {SAMPLE_TEXT}))")).alias("k", "text"))
    own = own.select("lang", F.when(F.col("k") == 0, F.xxhash64("id")).otherwise(F.xxhash64("id", "k")).alias("h"), "text")
    there = own.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    each = sample_bytes / max(1, len(there))
    share = F.create_map(*[x for r in there for x in (F.lit(r.lang), F.lit(int(min(1.0, each / max(1, r.n)) * (1 << 30))))]) if there else None
    texts: dict[str, list[bytes]] = {r.lang: [] for r in there}
    if there:
        some = own.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")]).orderBy("lang", "h", "text")
        for r in some.select("lang", "text").toArrow().to_pylist():
            texts[r["lang"]].append(bytes(r["text"]))
    return Trees(texts)


def identify(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score`` (the posterior of that language under the code lengths)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(trees)
    kept = docs.select(*names)
    at = names.index(text_col)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in batches:
            has = b.column(len(names)).to_pylist()
            lang: list[str] = ["und"] * len(has)
            score = np.zeros(len(has))
            if t.langs:
                texts = [x if y else b"" for x, y in zip(b.column(at).cast(pa.binary()).to_pylist(), has, strict=True)]
                bits = t.bits(texts)
                best = bits.argmin(1)
                sure = 1 / np.exp2(-np.minimum(1000, bits - bits.min(1, keepdims=True))).sum(1)
                for k, y in enumerate(has):
                    if y:
                        lang[k], score[k] = t.langs[best[k]], sure[k]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select(*names, letter).mapInArrow(run, f"{fields}, lang_pred string, score double")
