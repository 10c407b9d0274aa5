"""N-gram Jaccard join by MinHash banding.

Two documents are linked if the Jaccard similarity of their sets of word
n-grams is at least ``threshold``.  Words are maximal runs of characters other
than 0x20 and 0x09-0x0D; a text of fewer than ``n`` words, but not none, has
one n-gram.  Null texts and texts without words have no n-gram: they take no
part and are linked to nothing.

1. Every document gets ``bands * rows`` MinHash values.  The number of bands
   is the least that finds a pair at the threshold with probability
   ``recall`` (rows are given).  Documents with equal n-gram sets become one
   class, represented by its smallest row.
2. Shuffle on band hashes; buckets of one class are done with.  A bucket's
   classes are compared by their MinHash vectors: those that agree in
   ``agree`` or more of the values (the mean at the threshold less 4.5
   standard deviations) are candidates.  A bucket is compared in pairs of
   blocks of at most ``BLOCK`` classes, each pair of blocks by a task group
   of its own, which passes on a spanning forest of what it found, not pairs.
3. Candidate links make groups (connected components).  Inside a group, pairs
   that share a band and agree are verified on full n-gram sets, again in
   pairs of blocks; verified links are counted for both classes, weighted by
   the other class's copies, and again only a spanning forest is passed on.
4. Components of verified links are the near-duplicate groups.

Result, one row per row of the input: doc_id, class_id (smallest doc_id of its
near-duplicate group, its own if it has none), copy_id (smallest doc_id with
the same n-gram set), n_links (other rows linked to it, copies included).

No bucket, group or number of partners is capped.  What can be missed is
given by ``recall`` and by the agreement margin (below 1e-5 of pairs at the
threshold, less above it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqhash
from .common import Scratch, grouped, keyed, out, row_key, slices, text_bytes
from .components import components
from .phrases import word_hashes

NGRAM = 5
THRESHOLD = 0.8
ROWS = 4
RECALL = 0.9999
#: Classes compared at once with as many others.
BLOCK = 512

_MERSENNE = np.uint64((1 << 31) - 1)


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands that finds a pair at the threshold with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def least_agreement(values: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.floor(values * threshold - 4.5 * math.sqrt(values * threshold * (1 - threshold))))


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct n-grams of each text, sorted; offsets)."""
    sym, first = word_hashes(*text_bytes(texts))
    pre = seqhash.prefix(sym)
    sizes = np.diff(first)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc]
    h = seqhash.runs(pre, start, np.minimum(start + n, first[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(sizes) + 1))


def signatures(h: np.ndarray, offsets: np.ndarray, values: int) -> np.ndarray:
    """(texts with n-grams, values) MinHash values of 32 bits."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 62, values, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 62, values, np.int64).astype(np.uint64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    got = np.empty((len(starts), values), np.uint32)
    for j in range(values if len(starts) else 0):
        x = (h * a[j] + b[j]) >> np.uint64(32)
        got[:, j] = np.minimum.reduceat(x.astype(np.uint32), starts)
    return got


SIGNED = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", pa.binary())])
BUCKET = pa.schema([("id", pa.int64()), ("key", pa.int64())])
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
PROVED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _sign(n: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, offsets = ngram_sets(b.column(2), n)
            some = np.flatnonzero(np.diff(offsets) > 0)
            sig = signatures(h, offsets, values)
            size = np.diff(offsets)[some].astype(np.uint64)
            c1 = c2 = np.zeros(0, np.uint64)
            if len(some):
                c1 = seqhash.mix(np.add.reduceat(seqhash.mix(h), offsets[:-1][some]) + size)
                c2 = seqhash.mix(np.bitwise_xor.reduceat(seqhash.mix(h + np.uint64(1)), offsets[:-1][some]) ^ size)
            take = pa.array(some)
            yield out(SIGNED, dk=b.column(0).take(take), rk=b.column(1).take(take), c1=seqhash.i64(c1), c2=seqhash.i64(c2),
                      sig=[x.tobytes() for x in sig])
    return run


def _vectors(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), -1)


def _bands(rows: int):
    """(id, key of each band)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = _vectors(b.column(1))
            keys = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
            for j in range(rows):
                keys = seqhash.mix(keys + sig[:, j::rows])
            keys = seqhash.mix(keys ^ np.arange(keys.shape[1], dtype=np.uint64)[None, :])
            yield out(BUCKET, id=np.repeat(np.asarray(b.column(0)), keys.shape[1]), key=seqhash.i64(keys.reshape(-1)))
    return run


def forest(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a, b) among ``count`` vertices."""
    root = np.arange(count)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
            if len(keep) == count - 1:
                break
    return a[keep], b[keep]


def blocked(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Members of each group (``n``: its size) dealt to pairs of blocks: sorted rows (group, x, y, second, columns).

    A group of one block is one pair (0, 0) with each member once; of m
    blocks every pair of them, so a member is sent to m pairs.
    """
    rows = rows.withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(11)), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select(group, F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"),
                       (F.col("blk") > F.col("other")).alias("second"), *columns)
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def _candidates(sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, rows: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that share a band and agree in enough values."""
    found = []
    for i in left.tolist():
        js = right[right > i] if same else right
        if not len(js):
            continue
        eq = sig[js] == sig[i]
        n = eq.sum(1)
        js, eq = js[n >= agree], eq[n >= agree]
        if len(js):
            js = js[eq.reshape(len(js), -1, rows).all(2).any(1)]
        if len(js):
            found.append((np.full(len(js), i), js))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _pairs(sig: np.ndarray, second: np.ndarray, rows: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one pair of blocks: across them, or within if it is one block."""
    if len(sig) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if second.any():
        return _candidates(sig, np.flatnonzero(~second), np.flatnonzero(second), False, rows, agree)
    at = np.arange(len(sig))
    return _candidates(sig, at, at, True, rows, agree)


def _one_block(x: np.ndarray, y: np.ndarray, second: np.ndarray) -> bool:
    """Whether the rows of a pair of blocks hold anything to compare."""
    return bool(x[0] == y[0] or (second.any() and not second.all()))


def _propose(rows: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, 3):
            x, y, second, ids = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
            sig = _vectors(t.column(5))
            u, v = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2 or not _one_block(x[a:b], y[a:b], second[a:b]):
                    continue
                i, j = _pairs(sig[a:b], second[a:b], rows, agree)
                i, j = forest(i, j, b - a)
                u.append(ids[a:b][i])
                v.append(ids[a:b][j])
            if u:
                yield out(EDGE, u=np.concatenate(u), v=np.concatenate(v))
    return run


def _verify(rows: int, agree: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in grouped(batches, 3):
            x, y, second, ids, copies = (t.column(i).to_numpy() for i in (1, 2, 3, 4, 5))
            sig, grams = _vectors(t.column(6)), t.column(7).to_pylist()
            u, v, n = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2 or not _one_block(x[a:b], y[a:b], second[a:b]):
                    continue
                i, j = _pairs(sig[a:b], second[a:b], rows, agree)
                sets = [np.frombuffer(g, np.uint64) for g in grams[a:b]]
                ok = np.fromiter((_similar(sets[p], sets[q], threshold) for p, q in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
                i, j = i[ok], j[ok]
                own, many = ids[a:b], copies[a:b]
                links = np.bincount(i, many[j], b - a) + np.bincount(j, many[i], b - a)
                some = np.flatnonzero(links)
                i, j = forest(i, j, b - a)
                u += [own[some], own[i]]
                v += [own[some], own[j]]
                n += [links[some].astype(np.int64), np.zeros(len(i), np.int64)]
            if u:
                yield out(PROVED, u=np.concatenate(u), v=np.concatenate(v), links=np.concatenate(n))
    return run


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links, and ``stays``: whether the row is its
    group's smallest (by id, then text hash) or in none; of rows that repeat it, all are marked."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    bands = band_count(threshold, rows, recall)
    agree = least_agreement(bands * rows, threshold)
    base = keyed(docs, id_col, text_col)
    signed = scratch.stage(base.select("dk", "rk", "text").mapInArrow(
        _sign(n, bands * rows), "dk long, rk long, c1 long, c2 long, sig binary"), "signed")
    # classes of equal sets, numbered as they are written
    classes = signed.groupBy("c1", "c2").agg(F.min(F.struct("dk", "rk")).alias("least"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    classes = scratch.stage(classes.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "least", "copies", "sig"), "classes")

    # candidates: buckets of two classes or more
    buckets = classes.select("id", "sig").mapInArrow(_bands(rows), "id long, key long")
    met = scratch.stage(buckets, "buckets")
    met = met.join(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").join(classes.select("id", "sig"), "id")
    near = blocked(met, "key", ["id", "sig"]).mapInArrow(_propose(rows, agree), "u long, v long")
    roots = components(near, scratch, "near")
    group = roots.select(F.col("v").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    scratch.free_shuffles()

    # full n-gram sets of the classes in groups
    members = scratch.stage(group.join(classes.selectExpr("id", "least.dk", "least.rk", "copies", "sig"), "id"), "members")
    texts = base.select("dk", "rk", "text").join(members.select("dk", "rk", "id").hint("merge"), ["dk", "rk"]).select("id", "text")
    sets = texts.mapInArrow(_sets(n), "id long, grams binary")
    if_repeated = sets.groupBy("id").agg(F.min("grams").alias("grams"))  # a repeated row's set is the same
    full = members.join(if_repeated, "id").join(members.groupBy("root").agg(F.count("*").alias("n")), "root")
    proved = blocked(full, "root", ["id", "copies", "sig", "grams"]).mapInArrow(_verify(rows, agree, threshold), "u long, v long, links long")
    proved = scratch.stage(proved, "proved")
    scratch.free_shuffles()
    linked = components(proved.where("u <> v").select("u", "v"), scratch, "linked")
    counts = proved.where("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))

    # from classes to rows
    info = classes.select("id", "c1", "c2", "copies", "least").join(counts, "id", "left")
    info = info.join(linked.select(F.col("v").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    info = info.join(info.groupBy("root").agg(F.min("least").alias("first")), "root")
    info = info.selectExpr("c1", "c2", "first", "least.dk as copy_dk", "coalesce(links, 0) + copies - 1 as n_links")
    own = signed.select("dk", "rk", "c1", "c2").join(info, ["c1", "c2"]).groupBy("dk", "rk").agg(
        F.min("first").alias("first"), F.min("copy_dk").alias("copy_dk"), F.min("n_links").alias("n_links"))
    none = F.lit(-(2**63))
    return base.select("doc_id", "dk", "rk").join(own, ["dk", "rk"], "left").select(
        "doc_id", F.nullif(F.coalesce("first.dk", "dk"), none).alias("class_id"), F.nullif(F.coalesce("copy_dk", "dk"), none).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "dk", "rk",
        F.coalesce((F.col("first.dk") == F.col("dk")) & (F.col("first.rk") == F.col("rk")), F.lit(True)).alias("stays"))


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Jaccard similarity of two sorted sets of at least the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < threshold * len(large) * (1 - 1e-12):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _sets(n: int):
    schema = pa.schema([("id", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, offsets = ngram_sets(b.column(1), n)
            yield out(schema, id=b.column(0), grams=[h[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
    return run


def keep_one(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id, with all its columns.

    Rows that take no part stay.  Of rows that repeat both id and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = jaccard_join(docs, n, threshold, id_col=id_col, text_col=text_col).select("dk", "rk", "stays", "n_links")
    found = scratch.stage(found, "found")
    drop = found.where(~F.col("stays")).select(F.col("dk").alias("_dk"), F.col("rk").alias("_rk")).distinct()
    again = found.where("stays and n_links > 0").groupBy("dk", "rk").agg(F.count("*").alias("_n")).where("_n > 1")
    again = scratch.stage(again.select(F.col("dk").alias("_dk"), F.col("rk").alias("_rk")), "again")
    rows = docs.withColumns({"_dk": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "_rk": row_key(F.col(text_col).cast("string"))})
    rows = rows.join(drop.hint("merge"), ["_dk", "_rk"], "left_anti")
    if again.isEmpty():
        return rows.select(*docs.columns)
    # rows that repeat are reduced by partial aggregates, apart from all others
    one = rows.join(again, ["_dk", "_rk"], "left_semi").groupBy("_dk", "_rk").agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return rows.join(again, ["_dk", "_rk"], "left_anti").select(*docs.columns).unionByName(one.select("_row.*"))
