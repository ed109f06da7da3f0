"""Quality classification by positive-unlabelled learning.

A linear scorer over binned text statistics is fitted by minimising the non-negative unbiased
risk: trusted positives, unlabelled documents, and a class prior. Where the training labels
hold both classes the prior is their share of positives; else it is estimated from the mean
score of the unlabelled against that of the positives. Features are computed where the texts
lie; what is fitted on is a bounded sample of feature rows (MAX_POSITIVE, MAX_UNLABELLED).

Cases: null and empty texts have the features of an empty text and are scored like any other;
conflicting labels of one document make it no positive; rows repeated are scored alike; with no
positives every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that is fitted on, in documents.
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 30_000
BINS = 24
EPOCHS = 60
BATCHES = 20

_class = np.full(256, 5, np.uint8)  # other marks
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".,;:'\"-()?"]):
    _class[list(_chars)] = _k
_class[128:] = 6
_class[10] = 7
N_CLASSES = 8
N_FEATURES = N_CLASSES + 12


def features(text: bytes) -> list[float]:
    """Statistics of the whole text."""
    n = len(text)
    kinds = np.bincount(_class[np.frombuffer(text, np.uint8)], minlength=N_CLASSES) / max(1, n)
    words = text.split()
    m = len(words)
    if not m:
        return [*kinds.tolist(), 0.0, *[0.0] * 11]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    counts = np.fromiter(seen.values(), np.int64, len(seen))
    sizes = np.fromiter(map(len, words), np.int64, m)
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        *kinds.tolist(),
        float(np.log1p(n)),
        float(np.log1p(m)),
        len(seen) / m,
        float(np.log1p(m) - np.log1p(len(seen))),
        float(counts.max()) / m,
        pairs / max(1, m - 1),
        runs / max(1, m - 1),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(lines))),
        float(sizes.mean()),
        float(sizes.std()),
        float((counts == 1).sum()) / m,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    weight: np.ndarray
    prior: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([j * BINS + np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.weight[self.binned(x)].sum(1) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 1) -> Model:
    """Non-negative PU risk with the sigmoid loss, by Adam over stochastic batches."""
    d = unlabelled.shape[1] if len(unlabelled) else N_FEATURES
    both = np.concatenate([positive, unlabelled]) if len(unlabelled) else positive
    model = Model([np.unique(np.quantile(both[:, j], np.linspace(0, 1, BINS)[1:-1])) if len(both) else np.zeros(0) for j in range(d)], np.zeros(d * BINS + 1), 1.0)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.binned(positive), model.binned(unlabelled)
    if prior is None:
        first = _descend(model, p, u, 0.5, seed)
        prior = float(np.clip(first.score(unlabelled).mean() / max(1e-6, first.score(positive).mean()), 0.02, 0.98))
    return _descend(model, p, u, prior, seed)


def _descend(model: Model, p: np.ndarray, u: np.ndarray, prior: float, seed: int) -> Model:
    r = np.random.default_rng(seed)
    w = np.zeros_like(model.weight)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0

    def loss(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss at the label sign, and its gradient."""
        z = 1 / (1 + np.exp(np.clip(sign * (w[x].sum(1) + w[-1]), -30, 30)))
        g = -sign * z * (1 - z) / len(x)
        grad = np.bincount(x.ravel(), np.repeat(g, x.shape[1]), len(w))
        grad[-1] += g.sum()
        return float(z.mean()), grad

    for epoch in range(EPOCHS):
        for a, b in zip(np.array_split(r.permutation(len(p)), BATCHES), np.array_split(r.permutation(len(u)), BATCHES), strict=True):
            if not len(a) or not len(b):
                continue
            _, up = loss(p[a], 1)
            pn, gpn = loss(p[a], -1)
            un, gun = loss(u[b], -1)
            if un - prior * pn >= 0:
                grad = prior * up + gun - prior * gpn
            else:  # the negative part may not fall below nought
                grad = prior * gpn - gun
            grad += 1e-5 * w
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w = w - 0.1 * (0.97**epoch) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(model.cuts, w, prior)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t or b"") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["kind", "x"])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on labels of rows where may_learn holds (a column of labels)."""
    own = labels.filter(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("least"), F.max(label_col).alias("most"))
    known = own.agg(F.count_if(F.col("least") == 1).alias("pos"), F.count_if(F.col("most") == 0).alias("neg")).first()
    share = lambda seed, want, there: F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, want / max(1, there)) * (1 << 20))
    # At most MAX_POSITIVE ids (within sampling error), whatever the tables hold.
    positive = F.broadcast(own.filter("least = 1").filter(share(1, MAX_POSITIVE, known.pos)).select(F.col(id_col).alias("known_id")))
    there = docs.count()
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), share(2, MAX_UNLABELLED, there).alias("u"))
    rows = some.join(positive, F.col("id") == F.col("known_id"), "left").select("text", "u", F.col("known_id").isNotNull().alias("p")).filter("u OR p")
    rows = rows.select(F.when(F.col("p") & F.col("u"), 2).when(F.col("p"), 1).otherwise(0).alias("kind"), "text")
    got = rows.mapInArrow(_vectors, "kind int, x array<double>").toArrow()
    kind = got["kind"].to_numpy()
    flat = pa.chunked_array(got["x"].chunks, pa.list_(pa.float64())).combine_chunks()
    x = (flat.flatten() if len(kind) else pa.array([], pa.float64())).to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    prior = known.pos / (known.pos + known.neg) if known.pos and known.neg else None
    return fit(x[kind > 0], x[kind != 1], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``score``: the probability of high quality."""
    names = [c for c in docs.columns if c != "score"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(x), pa.float64())], names=[*names, "score"])

    kept = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, score double")
