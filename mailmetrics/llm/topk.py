"""Exact top-k inner products by norm buckets.

Vectors are range-partitioned by their length (ties by id), so a partition
holds a narrow band of lengths; inside it, runs of ``BUCKET`` vectors in order
of length are the buckets (they go on over Arrow batches; vectors of different
sizes in a run are searched apart).  A first pass scores the queries against the
``BUCKET`` longest vectors, which gives every query a threshold: its k-th best
score so far.  For a bucket with longest length m, a query needs a cosine of
t = threshold / (|q| * m):

* t > 1: the bucket holds nothing for the query (length pruning of it all);
* t >= ``COORDINATE_FROM``: coordinate pruning: in each of the query's largest
  coordinates f, a direction at cosine t has its f-th coordinate within
  t*q_f +- sqrt((1-t^2)(1-q_f^2)); vectors outside in any are left out;
* less: length pruning: only vectors of length threshold / |q| or more.

What is left is verified with full products, and thresholds rise from bucket
to bucket.  Pruning compares strictly and with a margin for rounding, so no
tie is lost.

Components become floor(256 * x).  Scores are integers: products stay in
double precision while lengths prove them exact, else in 64-bit integers
(which wrap beyond 2^63).  Vectors that are null, or hold a null or a
non-finite component, take no part; vectors of different sizes are not
compared; rows without an id take no part; rows that repeat an id are
candidates each, but never of a query with their own id, and a repeated query
id is one query (its first vector in sort order).
Vectors in order of length and queries are written once, the queries in blocks
of about ``QUERY_BLOCK``.  One block at a time is broadcast and sees all rows;
its k best a query are written before the next block is read, so driver and
executors hold one block however many there are, and a lost executor costs
tasks of one block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, out

SCALE = 256
K = 5
BUCKET = 4096
QUERY_BLOCK = 4096
#: Queries multiplied with a bucket at once (bounds the matrix of scores).
QUERY_ROWS = 512
FOCUS = 4
COORDINATE_FROM = 0.7
#: Marks no score; its negative is an integer too.
NONE = -(2**63) + 1
NO_ID = 2**63 - 1

RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, size, norm) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # doubles: floor() of Spark gives 64-bit integers, exact for |256 x| < 2^63
    t = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    return t.withColumn("size", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


class Queries:
    def __init__(self, ids: list[int], vectors: list[list[float]], k: int):
        order = np.lexsort((np.asarray(ids),))
        self.k = k
        self.ids = np.asarray(ids, np.int64)[order]
        self.by_size = {}
        sizes = np.array([len(v) for v in vectors])
        for s in sorted(set(sizes.tolist())):
            own = [i for i in order.tolist() if sizes[i] == s]
            q = np.array([vectors[i] for i in own], float).reshape(len(own), s)
            norm = np.sqrt((q * q).sum(1))
            self.by_size[s] = (np.asarray(ids, np.int64)[own], q, norm, np.full(len(own), -np.inf))


class Best:
    """The k best (score, smaller id first) of each query of one size, so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), NO_ID)
        self.floor = floor.copy()

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: (rows, m), NONE where there is none; ids: (rows, m)."""
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], 1)
        i = np.concatenate([self.id[rows], np.where(score == NONE, NO_ID, ids)], 1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        last = self.score[rows][:, -1]
        self.floor[rows] = np.maximum(self.floor[rows], np.where(last > NONE, last.astype(float), -np.inf))


def products(q: np.ndarray, v: np.ndarray, qn: np.ndarray, vn: np.ndarray) -> np.ndarray:
    if len(q) and len(v) and qn.max() * vn.max() < 2.0**52:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row: all that reach the k-th best score, then by id."""
    if score.shape[1] <= 4 * k:
        return score, np.broadcast_to(ids, score.shape)
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
    got_s = np.full((len(score), k), NONE)
    got_i = np.full((len(score), k), NO_ID)
    row, col = np.nonzero(score >= least)
    s, i = score[row, col], ids[col]
    order = np.lexsort((i, ~s, row))
    row, s, i = row[order], s[order], i[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    got_s[row[keep], place[keep]], got_i[row[keep], place[keep]] = s[keep], i[keep]
    return got_s, got_i


def search_bucket(best: Best, k: int, qid, q, qn, ids, v, vn) -> None:
    """v in descending order of vn."""
    m = vn[0]
    need = np.divide(best.floor, qn * m, out=np.full(len(qn), -np.inf), where=(qn * m > 0) & np.isfinite(best.floor))
    live = np.flatnonzero(~(need > 1 + 1e-9))
    steep = live[need[live] >= COORDINATE_FROM]
    # coordinate pruning, query by query
    if len(steep):
        unit = v / np.maximum(vn, 1e-300)[:, None]
        for r in steep.tolist():
            t = min(1.0, need[r] - 1e-9)
            u = q[r] / qn[r]
            keep = np.ones(len(v), bool)
            for f in np.argsort(-np.abs(u))[:FOCUS].tolist():
                half = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-7
                # directions at cosine t or more lie between these
                low = -1.0 if -u[f] >= t else t * u[f] - half
                high = 1.0 if u[f] >= t else t * u[f] + half
                keep &= (unit[:, f] >= low) & (unit[:, f] <= high)
            at = np.flatnonzero(keep & (ids != qid[r]))
            if len(at):
                best.offer(np.array([r]), *top(products(q[r:r + 1], v[at], qn[r:r + 1], vn[at]), ids[at], k))
    # length pruning, queries of like thresholds together, longest vectors first
    flat = live[need[live] < COORDINATE_FROM]
    least = np.where(np.isfinite(best.floor[flat]) & (qn[flat] > 0), best.floor[flat] / np.maximum(qn[flat], 1e-300), -np.inf)
    order = np.argsort(-least, kind="stable")
    flat, least = flat[order], least[order]
    for i in range(0, len(flat), QUERY_ROWS):
        rows, low = flat[i:i + QUERY_ROWS], least[i:i + QUERY_ROWS].min()
        n = int(np.searchsorted(-vn, -low * (1 - 1e-9), side="right")) if low > 0 else len(v)
        if n:
            score = products(q[rows], v[:n], qn[rows], vn[:n])
            score[qid[rows][:, None] == ids[:n][None, :]] = NONE
            best.offer(rows, *top(score, ids[:n], k))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of ``BUCKET`` rows, whatever the size of the batches."""
    held, rows = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, BUCKET - rows)
            b = b.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == BUCKET:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = queries.value.k
    found = {s: Best(len(x[0]), k, x[3]) for s, x in queries.value.by_size.items()}
    for bucket in _buckets(batches):
        sizes = np.asarray(bucket["size"])
        for s in np.unique(sizes).tolist():
            if s not in found:
                continue
            part = bucket.filter(pa.array(sizes == s)).combine_chunks()
            vn = np.asarray(part["norm"])
            order = np.argsort(-vn, kind="stable")
            v = np.concatenate([np.asarray(c.flatten()) for c in part["v"].chunks]).reshape(part.num_rows, s)[order]
            qid, q, qn, _ = queries.value.by_size[s]
            search_bucket(found[s], k, qid, q, qn, np.asarray(part["vec_id"])[order], v, vn[order])
    for s, best in found.items():
        qid, _, _, floor = queries.value.by_size[s]
        real = (best.score > NONE) & (best.score >= floor[:, None])  # k rows of the first pass reach the floor
        row = np.nonzero(real)[0]
        yield out(RESULT, query_id=qid[row], vec_id=best.id[real], score=best.score[real])


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows. ``is_query``: a Column over ``vec_id``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_norm = [F.col("norm").desc(), F.col("vec_id")]
    dealt = scratch.stage(
        quantised(vectors, id_col, vector_col).repartitionByRange(parts, *by_norm).sortWithinPartitions(*by_norm)
        .select("vec_id", "v", "size", "norm"), "vectors")
    asked = dealt.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-dealt.where(is_query).select("vec_id").distinct().count() // query_block))
    asked = scratch.stage(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
                          .repartition("block"), "queries", ["block"])
    longest = dealt.orderBy(*by_norm).limit(BUCKET).collect()  # at most BUCKET rows
    best_first = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    result = None
    for i in range(blocks):
        own = asked.where(F.col("block") == i).collect()  # about query_block rows, from their own folder
        queries = Queries([r.vec_id for r in own], [r.v for r in own], k)
        for s, (qid, q, qn, floor) in queries.by_size.items():
            first = Best(len(qid), k, floor)
            near = [r for r in longest if r.size == s]
            if near:
                search_bucket(first, k, qid, q, qn, np.array([r.vec_id for r in near]), np.array([r.v for r in near], float).reshape(len(near), s),
                              np.array([r.norm for r in near]))
            # only a floor: the rows themselves are met again
            floor[:] = first.floor
        sent = spark.sparkContext.broadcast(queries)
        got = dealt.mapInArrow(functools.partial(_search, sent), "query_id long, vec_id long, score long")
        ranked = got.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        result = scratch.stage(ranked, f"found/part={i}").schema
        sent.destroy()
    scratch.drop("vectors", "queries")
    return spark.read.schema(result).parquet(scratch.path("found")).select("query_id", "rank", "vec_id", "score")
