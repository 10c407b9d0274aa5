"""Rollups of the facts kept up to date from changed rows, with retraction.

``trace_rollup`` and ``participant_rollup`` read a whole fact.  Here the same
counts are a stored table that a batch of changed rows moves on: what a row
counted before is taken off its old key, what it counts now is added to its
new one (a trace that moves from open to click, a participant that changes its
campaign, a deleted row).

A state is a folder of generations.  Each holds

* ``counts``: per key, the measures and the number of counted rows, and
* ``rows-from-<m>``: the counted rows that changed in generations m to this
  one (id, key, measures), sorted by id; a row that counts no longer stays as a
  tombstone until it reaches the first generation.

Runs of similar size are merged, so a state of n rows has about log2(n) runs,
and a row is rewritten about as often.  A batch reads of them the files and row
groups in its range of ids (recent rows change most), joined to its ids; no
counts of untouched rows are made again.  ``counts`` is written last: a
generation without it isn't there, so a job that died is simply run again, and
applying a batch twice changes nothing.  Older generations stay readable until
``expire``.

Rows are told apart by ``id``; rows without one can't change and are refused.
(The reports read no id of participants, so ``Sources`` leaves it out: take the
participants' own table here.)
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RollupSpec:
    """``counted``: condition of the rows that count; ``measures``: name -> condition."""

    key: str
    counted: str
    measures: dict[str, str]


TRACES = RollupSpec("mass_mailing_id", "trace_status IN ('click', 'cancel')",
                    {"clicked": "trace_status = 'click'", "canceled": "trace_status = 'cancel'"})
PARTICIPANTS = RollupSpec("campaign_id", "true",
                          {"total": "true", "running": "state = 'running'", "completed": "state = 'completed'", "test": "is_test"})

#: An older run at most this many times the size of the newer ones together is merged with them.
MERGE_FACTOR = 2


class IncrementalRollup:
    """State of one rollup below ``root`` (a folder of any file system Spark reaches); one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, spec: RollupSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec

    # -- folders --------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _found(self, pattern: str) -> list[str]:
        p = self._path(pattern)
        fs = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [s.getPath().toString() for s in fs.globStatus(p) or []]

    def _delete(self, generation: int) -> None:
        p = self._path(f"gen-{generation:08d}")
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def _folder(self, generation: int) -> str:
        return f"{self.root}/gen-{generation:08d}"

    def generations(self) -> list[int]:
        """Finished generations, oldest first."""
        return sorted(int(re.search(r"gen-(\d+)/counts", p)[1]) for p in self._found("gen-*/counts/_SUCCESS"))

    def _run(self, generation: int) -> tuple[int, DataFrame]:
        """(first generation, rows) of the run that ends with ``generation``."""
        [path] = self._found(f"gen-{generation:08d}/rows-from-*")
        return int(path[-8:]), self.spark.read.parquet(path)

    # -- contents -------------------------------------------------------------
    def _contributions(self, facts: DataFrame, generation: int) -> DataFrame:
        s = self.spec
        live = F.expr(f"coalesce({s.counted}, false)") & F.col(s.key).isNotNull()
        if "_deleted" in facts.columns:
            live &= ~F.coalesce(F.col("_deleted"), F.lit(False))
        # raise_error and not a filter: a lost row would make the counts wrong silently
        ident = F.coalesce(F.col("id").cast("long"), F.raise_error(F.lit("a changed row has no id")).cast("long"))
        return facts.select(
            ident.alias("id"), live.alias("live"), F.col(s.key).cast("long").alias("key"),
            *[F.expr(f"coalesce({c}, false)").cast("long").alias(m) for m, c in s.measures.items()],
            F.lit(generation).alias("gen"),
        )

    def _sums(self, df: DataFrame) -> DataFrame:
        return df.groupBy("key").agg(*[F.sum(m).alias(m) for m in [*self.spec.measures, "n_rows"]])

    def _newest(self, rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c != "id"]
        return rows.groupBy("id").agg(F.max_by(F.struct(*cols), "gen").alias("r")).select("id", "r.*")

    def _write_rows(self, rows: DataFrame, generation: int, first: int) -> DataFrame:
        path = f"{self._folder(generation)}/rows-from-{first:08d}"
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
        return self.spark.read.parquet(path)

    # -- use ------------------------------------------------------------------
    def build(self, facts: DataFrame) -> None:
        """First generation, from the whole fact (one row per id)."""
        if self.generations():
            raise ValueError(f"{self.root} holds a state already")
        self._delete(0)
        rows = self._write_rows(self._contributions(facts, 0).where("live"), 0, 0)
        self._sums(rows.withColumn("n_rows", F.lit(1).cast("long"))).write.parquet(f"{self._folder(0)}/counts")

    def apply(self, changes: DataFrame, version: str | None = None) -> int:
        """Move the counts on by changed rows; returns the new generation.

        ``changes``: rows of the fact as they are now, with ``_deleted`` true (an
        optional column) for rows that are gone.  Of several rows of one id the
        one with the largest ``version`` (a column) holds; without ``version``
        an id may come once only.
        """
        done = self.generations()
        if not done:
            raise ValueError(f"{self.root} holds no state; build it first")
        n = done[-1] + 1
        self._delete(n)  # what a job that died has left
        if version:
            changes = changes.withColumn("_all", F.struct(*changes.columns)).groupBy("id").agg(
                F.max_by("_all", version).alias("_all")).select("_all.*")
        changed = f"{self._folder(n)}/changed"
        self._contributions(changes, n).write.parquet(changed)
        new = self.spark.read.parquet(changed)
        size, ids, low, high = new.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        if size != ids:
            raise ValueError("an id comes more than once; name the column that orders its versions")

        runs, at = [], n - 1  # newest first
        while at >= 0:
            first, rows = self._run(at)
            runs.append((first, rows))
            at = first - 1
        old = None
        for _, rows in runs:
            part = rows.where(F.col("id").between(low, high)).join(new.select("id"), "id", "left_semi")
            old = part if old is None else old.unionByName(part)
        old = self._newest(old).where("live")
        measures = list(self.spec.measures)
        signed = new.where("live").select("key", *measures, F.lit(1).cast("long").alias("n_rows")).unionByName(
            old.select("key", *[(-F.col(m)).alias(m) for m in measures], F.lit(-1).cast("long").alias("n_rows")))

        first, merged = n, new
        for start, rows in runs:
            had = rows.count()  # from the footers
            if had > MERGE_FACTOR * size:
                break
            first, merged, size = start, merged.unionByName(rows), size + had
        if first < n:
            merged = self._newest(merged)
        self._write_rows(merged.where("live") if first == 0 else merged, n, first)
        counts = self.spark.read.parquet(f"{self._folder(n - 1)}/counts").unionByName(self._sums(signed))
        self._sums(counts).where("n_rows > 0").write.parquet(f"{self._folder(n)}/counts")
        return n

    def read(self, generation: int | None = None) -> DataFrame:
        """The rollup as ``operators.rollups`` returns it, of the newest or the named generation."""
        done = self.generations()
        if not done or (generation is not None and generation not in done):
            raise ValueError(f"{self.root} holds no such generation")
        counts = self.spark.read.parquet(f"{self._folder(done[-1] if generation is None else generation)}/counts")
        return counts.select(F.col("key").alias(self.spec.key), *self.spec.measures)

    def expire(self) -> list[int]:
        """Delete generations that neither hold the newest counts nor one of its runs; returns them."""
        done = self.generations()
        needed, at = set(), done[-1] if done else -1
        while at >= 0:
            needed.add(at)
            at = self._run(at)[0] - 1
        gone = [g for g in done if g not in needed]
        for g in gone:
            self._delete(g)
        return gone
