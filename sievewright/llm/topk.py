"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped by length, so that lengths within a bucket differ by a bounded factor, and
a bucket is split into chunks of a bounded size (a bucket may hold every row). The longest
chunk gives each query a first lower bound of its k-th score. That bound, divided by the
query's length and the bucket's greatest length, is the local cosine threshold: above 1 the
bucket is not visited by the query at all; where it is high, candidates must lie in the
feasible range of the query's largest coordinates (coordinate pruning); elsewhere the
candidates' lengths prune (length pruning). What is left is verified by exact products.

Queries are a stated set, met with the chunks in blocks: a task holds one chunk and one block.
Every chunk sends only its k best per query on.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; only vectors of one dimension are compared; equal rows count once; ties go to
the smaller id; fewer than k candidates give fewer rows; an empty table gives none; extra
columns are ignored. Scores beyond 64 bits are clipped to them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lengths in a bucket differ by this factor at most.
RATIO = 1.1
CHUNK = 32_768
BLOCK = 4_096
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.8
FOCUS = 4


def quantised(c: Column, scale: int) -> Column:
    return F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def finite(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products over every other row."""
    v = F.col(vec_col)
    rows = vectors.filter(finite(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), (quantised(v, scale) if scale else F.transform(v, lambda x: x.cast("double"))).alias("v"), is_query.alias("q")).distinct()
    rows = rows.withColumn("dim", F.size("v")).withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = rows.withColumn("bucket", F.when(F.col("len") > 0, F.floor(F.log("len") / math.log(RATIO))).otherwise(-(10**6)).cast("int"))
    # One row per bucket: their number is bounded by the range of a double, not by the data.
    buckets = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("len").alias("max_len"), F.count_if("q").alias("nq")).collect()
    spark = vectors.sparkSession
    plan, dims = [], {}
    for b in sorted(buckets, key=lambda b: (b["dim"], -b["bucket"])):
        chunks = -(-b["n"] // CHUNK)
        dims.setdefault(b["dim"], [0, 0])
        plan.append((b["dim"], b["bucket"], chunks, b["max_len"], dims[b["dim"]][0]))
        dims[b["dim"]][0] += chunks
        dims[b["dim"]][1] += b["nq"]
    bucket_table = F.broadcast(spark.createDataFrame(plan, "dim int, bucket int, chunks int, max_len double, before int"))
    blocks = F.broadcast(spark.createDataFrame([(d, max(1, -(-nq // BLOCK))) for d, (_, nq) in dims.items()], "dim int, blocks int"))
    placed = rows.join(bucket_table, ["dim", "bucket"]).withColumn("chunk", F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).join(blocks, "dim")
    cand = placed.select("dim", "chunk", "vec_id", "v", "len", "blocks")
    queries = placed.filter("q").select("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).alias("block"), "vec_id", "v", "len")

    first = _meet(cand.filter("chunk = 0"), queries.withColumn("chunk", F.lit(0).cast("long")).withColumn("floor", F.lit(None).cast("double")), k)
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    rest = queries.join(floors, "vec_id", "left").join(bucket_table.select("dim", "chunks", "max_len", "before"), "dim")
    rest = rest.filter(F.col("floor").isNull() | (F.col("len") * F.col("max_len") * (1 + 1e-9) >= F.col("floor")))
    rest = rest.withColumn("chunk", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("chunks") - 1))).filter("chunk > 0")
    later = _meet(cand.filter("chunk > 0"), rest.select("dim", "block", "vec_id", "v", "len", "chunk", "floor"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(later).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(cand: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    left = cand.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).select("dim", F.col("chunk").cast("long").alias("chunk"), "block", "vec_id", "v", "len")
    # Fresh aliases: both sides come from one table.
    right = queries.select(*(F.col(c).cast("long").alias(c) if c in ("chunk", "block") else F.col(c).alias(c) for c in ("dim", "chunk", "block", "vec_id", "v", "len", "floor")))
    keys = ("dim", "chunk", "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _best(left, right, k) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 3
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = t["vec_id"].to_numpy()
    v = t["v"].combine_chunks()
    flat = (pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1), t["len"].to_numpy()


def _best(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, p, plen = _matrix(left)
    order = np.argsort(-plen, kind="stable")
    ids, p, plen = ids[order], p[order], plen[order]
    qids, q, qlen = _matrix(right)
    floor = right["floor"].to_numpy(zero_copy_only=False).astype(float)
    floor = np.where(np.isnan(floor), -np.inf, floor)
    # 64-bit floats hold the products exactly up to 2**53.
    exact = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, q.shape[1]) < 2**53
    with np.errstate(divide="ignore", invalid="ignore"):
        local = floor / (qlen * plen[0])
    by_length = ~(local >= COORDINATE_FROM) | (qlen == 0)
    outs = []
    rows = np.flatnonzero(by_length)
    for at in range(0, len(rows), 64):
        r = rows[at : at + 64]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((floor[r] > 0) & (qlen[r] > 0), floor[r] / qlen[r], 0).min() * (1 - 1e-9)
        n = int(np.searchsorted(-plen, -need, side="right"))
        outs.append(_verify(r, np.arange(n), ids, p, qids, q, floor, k, exact))
    unit = None
    for r in np.flatnonzero(~by_length & (local <= 1 + 1e-9)):
        if unit is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = np.nan_to_num(p / plen[:, None]).T.copy()
        direction = q[r] / qlen[r]
        spread = math.acos(min(1.0, local[r]))
        keep = None
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            at = math.acos(max(-1.0, min(1.0, direction[f])))
            low, high = math.cos(min(math.pi, at + spread)) - 1e-9, math.cos(max(0.0, at - spread)) + 1e-9
            x = unit[f] if keep is None else unit[f][keep]
            inside = np.flatnonzero((x >= low) & (x <= high))
            keep = inside if keep is None else keep[inside]
        keep = keep[plen[keep] * qlen[r] * (1 + 1e-9) >= floor[r]]
        outs.append(_verify(np.array([r]), keep, ids, p, qids, q, floor, k, exact))
    if not outs:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*outs, strict=True))


def _verify(rows, keep, ids, p, qids, q, floor, k, exact):
    """The k best of the kept candidates for each of the queries, own rows left out."""
    if not len(keep):
        return (np.zeros(0, np.int64),) * 3
    cid = ids[keep]
    if exact:
        score = q[rows] @ p[keep].T
    else:
        score = np.array([[min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in p[keep]] for x in q[rows]], dtype=object)
    free = cid[None, :] != qids[rows][:, None]
    ok = free & (score >= floor[rows][:, None])
    if exact and len(keep) > 4 * k:
        least = np.partition(np.where(free, score, -np.inf), -k, axis=1)[:, -k]
        ok &= score >= least[:, None]
    a, b = np.nonzero(ok)
    s = score[a, b].astype(np.int64)
    order = np.lexsort((cid[b], -s.astype(float) if exact else np.array([-int(x) for x in s], dtype=float), a))
    a, b, s = a[order], b[order], s[order]
    start = np.searchsorted(a, a, side="left")
    best = np.arange(len(a)) - start < k
    return qids[rows][a[best]], cid[b[best]], s[best]
