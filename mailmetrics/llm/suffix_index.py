"""Substring dedup with a logarithmic family of suffix arrays.

A byte goes if a string of ``n`` bytes that covers it also starts anywhere
else.  The index is a family of sorted suffix arrays: a batch of documents
gets an array of its own, the array is merge-scanned against the levels that
exist (a sort-merge join of tables stored bucketed and sorted by the suffix
key, so neither side is shuffled again), and levels of equal size are merged
into one of twice the size.  After ``b`` batches there are at most log2(b)+1
levels, and an entry has been rewritten at most log2(b) times.

Suffixes are taken at content-chosen places: the anchor of a window is the
least hashed ``k`` bytes in it, so the same string has the same anchor
wherever it stands, and every string of ``n`` bytes contains one.  The array's
key is the 64-bit hash of the suffix's first ``k`` bytes; only equality of
leading bytes is asked of its order.  The windows around one occurrence of an
anchor form a run of at most ``n - k + 1`` consecutive starts, which carries a
hash of all its bytes:

* the runs of an anchor key are all alike: every window in them repeats;
* they differ: runs with the same hash repeat as a whole; of the others, and
  of one of each kind, all windows are compared one by one: an anchor's kinds
  in one task if they are at most ``KINDS``, else each window as a row.

So a group of copies, however large, is counted by partial sums and never
paired up.  Positions are per row; a repeated row is an occurrence elsewhere.

Null and empty texts keep their zero bytes.  A null doc_id is allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seqhash
from .common import Scratch, distinct_texts, grouped, keyed, out, slices, text_bytes

REPEAT_BYTES = 200
ANCHOR_BYTES = 64
BATCHES = 4
#: Bytes whose windows are hashed at once (longer texts are cut into pieces that overlap).
PIECE = 1 << 22
#: A run is one number: first start * 2^16 + (starts - 1).
LEN_BITS = 16
#: Different runs of an anchor that one task compares.
KINDS = 1024

ENTRY = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("batch", pa.int32()), ("a", pa.int64()),
                   ("w", pa.int64()), ("run", pa.int64())])
SPAN = pa.schema([("a", pa.int64()), ("w", pa.int64()), ("many", pa.bool_()), ("alone", pa.bool_()), ("dk", pa.int64()),
                  ("rk", pa.int64()), ("run", pa.int64()), ("span", pa.binary())])
WINDOW = pa.schema([("v", pa.int64()), ("w", pa.int64()), ("alone", pa.bool_()), ("dk", pa.int64()), ("rk", pa.int64()), ("run", pa.int64())])
FOUND = pa.schema([("dk", pa.int64()), ("rk", pa.int64()), ("run", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("spans", pa.list_(pa.int64()))])


def pieces(data: np.ndarray, n: int, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, symbols): every window of n starts in exactly one piece."""
    for s in range(0, max(1, len(data) - n + 1), size):
        yield s, data[s:s + size + n - 1]


def _entries(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = text_bytes(b.column(3))
            ends = np.repeat(offsets[1:], np.diff(offsets))
            for at, part in pieces(data, n):
                d = seqhash.domains(seqhash.prefix(seqhash.BYTE[part]), ends[at:at + len(part)] - at, n, k)
                first = d["first"] + at
                doc = np.searchsorted(offsets, first, side="right") - 1
                yield out(ENTRY, dk=b.column(0).take(pa.array(doc)), rk=b.column(1).take(pa.array(doc)),
                          batch=b.column(2).take(pa.array(doc)), a=seqhash.i64(d["anchor"]), w=seqhash.i64(d["whole"]),
                          run=((first - offsets[doc]) << LEN_BITS) | (d["last"] - d["first"]))
    return run


class SuffixArrayFamily:
    """Levels of sorted suffix arrays: (a, w, mixed), a row for each distinct key."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch = spark, scratch
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: dict[int, str] = {}
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        name = f"{self.scratch.root.rsplit('/', 1)[-1].replace('-', '_')}_{self.made}"
        (df.write.bucketBy(self.buckets, "a").sortBy("a").format("parquet").option("compression", "zstd")
         .option("path", self.scratch.path(name)).saveAsTable(name))
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        self.scratch.drop(name)

    @staticmethod
    def _joined(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        """One merge-scan: keys of both sides; runs differ if they do on a side or between the sides."""
        x, y = x.alias("x"), y.alias("y")
        return x.join(y.hint("merge"), F.col("x.a") == F.col("y.a"), how).selectExpr(
            "coalesce(x.a, y.a) as a", "coalesce(x.w, y.w) as w",
            "coalesce(x.mixed, false) or coalesce(y.mixed, false) or coalesce(x.w <> y.w, false) as mixed")

    def add(self, entries: DataFrame, last: bool = False) -> list[DataFrame]:
        """A new batch (a, w): its matches in itself and with each level, as (a, w, mixed).

        ``last``: no further batch comes, so the levels needn't be merged.
        """
        new = self._write(entries.groupBy("a").agg(F.min("w").alias("w"), F.max("w").alias("hi"), F.count("*").alias("n"))
                          .selectExpr("a", "w", "w <> hi as mixed", "n > 1 as twice"))
        arr = self.spark.table(new)
        found = [arr.where("twice").select("a", "w", "mixed")]
        found += [self._joined(arr, self.spark.table(t), "inner") for t in self.levels.values()]
        self.made += 1
        name = f"match{self.made}"
        got = found[0]
        for f in found[1:]:
            got = got.unionByName(f)
        got = self.scratch.stage(got, name)
        rank = 0
        while rank in self.levels and not last:  # geometric merging
            old = self.levels.pop(rank)
            both = self._write(self._joined(self.spark.table(new), self.spark.table(old), "full").selectExpr(
                "a", "w", "mixed", "false as twice"))
            self._forget(old)
            self._forget(new)
            new, rank = both, rank + 1
        while rank in self.levels:
            rank += 1
        self.levels[rank] = new
        return [got]

    def close(self) -> None:
        for t in self.levels.values():
            self._forget(t)
        self.levels = {}


def repeated_runs(docs: DataFrame, n: int = REPEAT_BYTES, k: int = ANCHOR_BYTES, batches: int = BATCHES) -> DataFrame:
    """(dk, rk, runs): for each row of ``keyed`` documents, the runs of window starts that repeat."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    docs = distinct_texts(docs, scratch, 2)  # a repeated row is an occurrence elsewhere: two of them say all that more would
    rows = docs.select("dk", "rk", F.pmod(F.xxhash64("dk", "rk"), F.lit(batches)).cast("int").alias("batch"), "text")
    entries = scratch.stage(rows.mapInArrow(_entries(n, k), "dk long, rk long, batch int, a long, w long, run long"),
                            "entries", ["batch"])
    family = SuffixArrayFamily(spark, scratch)
    matches: list[DataFrame] = []
    for i in range(batches):
        matches += family.add(entries.where(F.col("batch") == i).select("a", "w"), last=i == batches - 1)
        scratch.free_shuffles()
    family.close()
    keys = matches[0]
    for m in matches[1:]:
        keys = keys.unionByName(m)
    keys = keys.groupBy("a").agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.max("mixed").alias("mixed"))
    keys = scratch.stage(keys.selectExpr("a", "mixed or lo <> hi as mixed"), "keys")  # else a hot anchor can't be split below
    hits = scratch.stage(entries.select("dk", "rk", "a", "w", "run").join(keys, "a"), "hits")
    scratch.free_shuffles()
    scratch.drop("entries")

    kinds = scratch.stage(hits.where("mixed").groupBy("a", "w").agg(
        F.count("*").alias("n"), F.min(F.struct("dk", "rk", "run")).alias("one")), "kinds")
    open_ = kinds.groupBy("a").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1").selectExpr("a", f"kinds > {KINDS} as many")
    shown = kinds.join(scratch.stage(open_, "open"), "a").selectExpr("one.dk", "one.rk", "one.run", "a", "w", "many", "n = 1 as alone")
    shown = shown.groupBy("dk", "rk").agg(F.collect_list(F.struct("run", "a", "w", "many", "alone")).alias("runs"))
    spans = docs.select("dk", "rk", "text").join(shown.hint("merge"), ["dk", "rk"]).mapInArrow(
        _spans(n), "a long, w long, many boolean, alone boolean, dk long, rk long, run long, span binary")
    spans = scratch.stage(spans, "spans")
    scratch.free_shuffles()
    few = spans.where("not many").repartition("a").sortWithinPartitions("a", "w").mapInArrow(_compare(n), "dk long, rk long, run long")
    windows = spans.where("many").mapInArrow(_windows(n), "v long, w long, alone boolean, dk long, rk long, run long")
    twice = windows.groupBy("v").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo <> hi").select("v")
    many = windows.where("alone").join(scratch.stage(twice, "twice"), "v", "left_semi").select("dk", "rk", "run")
    whole = hits.where("not mixed").select("dk", "rk", "run").unionByName(
        hits.where("mixed").join(kinds.where("n > 1").select("a", "w").hint("merge"), ["a", "w"], "left_semi").select("dk", "rk", "run"))
    return whole.unionByName(few).unionByName(many).groupBy("dk", "rk").agg(F.collect_list("run").alias("runs"))


def _spans(n: int):
    """The bytes of the given runs' windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, lists = b.column(2).cast(pa.binary()).to_pylist(), b.column(3)
            flat = lists.flatten()
            runs = np.asarray(flat.field("run"))
            doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            start, size = runs >> LEN_BITS, (runs & ((1 << LEN_BITS) - 1)) + n
            take = pa.array(doc)
            yield out(SPAN, a=flat.field("a"), w=flat.field("w"), many=flat.field("many"), alone=flat.field("alone"),
                      dk=b.column(0).take(take), rk=b.column(1).take(take), run=runs,
                      span=[texts[d][s:s + m] for d, s, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)])
    return run


def _hashed(runs: np.ndarray, spans: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window as a run of one start, hash) of every window of the runs."""
    data, offsets = text_bytes(spans)
    size = (runs & ((1 << LEN_BITS) - 1)) + 1
    row = np.repeat(np.arange(len(runs)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = offsets[:-1][row] + place
    v = seqhash.runs(seqhash.prefix(seqhash.BYTE[data]), at, at + n)
    return row, ((runs >> LEN_BITS)[row] + place) << LEN_BITS, v


def _one(col: pa.ChunkedArray) -> pa.Array:
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def _compare(n: int):
    """Windows of the runs that are alone, if a run of another kind has them too; whole anchors follow each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in grouped(batches, 1):
            a, w = t.column("a").to_numpy(), t.column("w").to_numpy()
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])  # a repeated row shows its run again
            t = t.filter(pa.array(new))
            runs, alone = t.column("run").to_numpy(), t.column("alone").to_numpy(zero_copy_only=False)
            row, start, v = _hashed(runs, _one(t.column("span")), n)
            _, back, count = np.unique(v, return_inverse=True, return_counts=True)
            hit = (count[back] > 1) & alone[row]
            yield out(FOUND, dk=t.column("dk").to_numpy()[row[hit]], rk=t.column("rk").to_numpy()[row[hit]], run=start[hit])
    return run


def _windows(n: int):
    """Every window of the runs as a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                t = b.slice(i, 2000)
                row, start, v = _hashed(np.asarray(t.column(6)), t.column(7), n)
                take = pa.array(row)
                yield out(WINDOW, v=seqhash.i64(v), w=t.column(1).take(take), alone=t.column(3).take(take),
                          dk=t.column(4).take(take), rk=t.column(5).take(take), run=start)
    return run


def spans_of(runs: list[int] | None, n: int) -> np.ndarray:
    """Maximal covered runs [start, end), flat, of the windows whose starts are given."""
    if not runs:
        return np.zeros(0, np.int64)
    r = np.unique(np.asarray(runs, np.int64))
    start, end = r >> LEN_BITS, (r >> LEN_BITS) + (r & ((1 << LEN_BITS) - 1)) + n
    end = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return np.stack([start[new], end[np.r_[new[1:] - 1, len(end) - 1]]], 1).reshape(-1)


def _kept(n: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            spans = [spans_of(r, n) for r in b.column(2).to_pylist()]
            kept = []
            for t, s in zip(texts, spans, strict=True):
                cuts = [0, *s.tolist(), len(t)]
                kept.append(t if not len(s) else b"".join(t[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)))
            if digests:
                yield out(RESULT, doc_id=b.column(0), n_bytes=[len(t) for t in texts],
                          n_removed=[len(t) - len(x) for t, x in zip(texts, kept, strict=True)],
                          n_spans=[len(s) // 2 for s in spans], kept_sha256=[hashlib.sha256(x).hexdigest() for x in kept])
            else:
                yield out(KEPT, doc_id=b.column(0), text=kept, spans=[s.tolist() for s in spans])
    return run


def remove_repeats(docs: DataFrame, n: int = REPEAT_BYTES, k: int = ANCHOR_BYTES, batches: int = BATCHES,
                   id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """One row per row of ``docs``: counts and the kept bytes' digest, or the kept bytes and removed spans."""
    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows, n, k, batches)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else \
        "doc_id long, text binary, spans array<long>"
    return rows.join(runs.hint("merge"), ["dk", "rk"], "left").select("doc_id", "text", "runs").mapInArrow(_kept(n, digests), kind)
