"""Helpers shared by the operators: shared-folder tables, document keys, slices of text."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text a task works on at once, in bytes (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20
#: Rows of groups a task looks at together (a larger group is looked at whole).
GROUP_ROWS = 2048


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are far longer than the rows Spark's default of 10,000 has in mind.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, and send this package to the executors' Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:  # a smaller bound of the user's stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    if any(f.endswith(f"/{name}.zip") for f in spark.sparkContext.listFiles):
        return
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        # workers of this machine start in this folder, with this PYTHONPATH
        there = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root in there or os.getcwd() == root:
            return
    folder = tempfile.mkdtemp(prefix="llm-package-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) without the setting gets a temporary one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written below the shared folder; they survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write once, read back: later steps read the table instead of recomputing it."""
        w = df.write.option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete staged tables that nothing reads any more."""
        jvm = self.spark._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove the shuffle files of steps that are over."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def row_key(text: Column) -> Column:
    """64-bit hash that tells texts of one doc_id apart (any number of rows may share an id or have none)."""
    return F.xxhash64(text)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, text): rk tells rows apart that repeat a doc_id with another text.

    A null doc_id stays null; ``key`` columns are never null.
    """
    t = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("dk"),
        row_key(t).alias("rk"),
        t.alias("text"),
    )


def distinct_texts(rows: DataFrame, scratch: Scratch, times: int = 1) -> DataFrame:
    """``keyed`` rows, of which those that repeat (dk, rk) come ``times`` times at most.

    Repeats are found by counts of the keys and reduced by partial
    aggregates, so a row repeated any number of times never meets itself.
    """
    many = scratch.stage(rows.groupBy("dk", "rk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > times).select("dk", "rk"), "repeated")
    if many.isEmpty():
        return rows
    once = rows.join(many, ["dk", "rk"], "left_semi").groupBy("dk", "rk").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    some = once.withColumn("_i", F.explode(F.array(*map(F.lit, range(times))))).select(rows.columns)
    return scratch.stage(rows.join(many, ["dk", "rk"], "left_anti").unionByName(some), "distinct")


def crc_mod(id_col: str, n: int):
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], text_col: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``most`` bytes of text (one row at least)."""
    try:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(text_col)), 0)).astype(np.int64)
            ends = np.cumsum(sizes)
            i = 0
            while i < n:
                before = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + most, side="right")))
                yield b.slice(i, j - i)
                i = j
    finally:
        pa.default_memory_pool().release_unused()  # workers are reused


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets with one more entry than rows); null: empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    offsets = np.zeros(len(col) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = b"".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in col) if col.null_count else None
    if data is None:
        wide = col.type in (pa.large_string(), pa.large_binary())
        raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
        buf = col.buffers()[2]
        whole = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
        return whole[int(raw[0]):int(raw[-1])] if len(col) else whole[:0], offsets
    return np.frombuffer(data, np.uint8), offsets


def out(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that follow each other with equal first ``keys`` columns: (rows, bounds of the groups)."""
    left: pa.Table | None = None
    for b in (x.slice(i, GROUP_ROWS) for x in batches for i in range(0, x.num_rows, GROUP_ROWS)):
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        if not t.num_rows:
            continue
        bounds = _bounds(t, keys)
        last = int(bounds[-2])
        left = t.slice(last)
        if last:
            yield t.slice(0, last).combine_chunks(), bounds[:-1]
    if left is not None and left.num_rows:
        yield left.combine_chunks(), np.array([0, left.num_rows])


def _bounds(t: pa.Table, keys: int) -> np.ndarray:
    new = np.ones(t.num_rows + 1, bool)
    new[1:-1] = False
    for i in range(keys):
        c = t.column(i).to_numpy()
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
