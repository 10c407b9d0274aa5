"""The eight input tables of the reports, bound to DataFrames.

``Sources`` is a plain holder: the reports take it and build lazy plans on
its DataFrames, so Catalyst sees one query per report from the scans to the
result and prunes columns / pushes filters into the Parquet readers.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .schemas import SCHEMAS


@dataclass(frozen=True)
class Sources:
    mailing_mailing: DataFrame
    mailing_trace: DataFrame
    marketing_campaign: DataFrame
    marketing_participant: DataFrame
    marketing_activity: DataFrame
    mailing_list: DataFrame
    mailing_contact: DataFrame
    mailing_contact_subscription: DataFrame

    # -- constructors ---------------------------------------------------------
    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame]) -> "Sources":
        """Bind already-built DataFrames; each is conformed to its schema."""
        missing = [f.name for f in fields(cls) if f.name not in frames]
        if missing:
            raise ValueError(f"missing source tables: {missing}")
        return cls(**{f.name: conform(frames[f.name], f.name) for f in fields(cls)})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Sources":
        """Read ``<root>/<table>`` (a Parquet file or directory) per table.

        The files' own schema is read, so ``conform`` sees a missing column
        (and raises) and casts other types up; scans still read only the
        columns that a report uses.
        """
        frames = {}
        for name in SCHEMAS:
            path = os.path.join(root, name)
            try:
                frames[name] = spark.read.parquet(path)
            except AnalysisException:  # no such folder: try "<table>.parquet"
                frames[name] = spark.read.parquet(path + ".parquet")
        return cls.from_frames(frames)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> "Sources":
        """Bind catalog tables named like the source tables."""
        prefix = f"{database}." if database else ""
        return cls.from_frames({n: spark.table(prefix + n) for n in SCHEMAS})

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> "Sources":
        """Marketing tables derived from the TPC-H-style test tables."""
        from .fixtures import derive_sources

        return cls.from_frames(derive_sources(spark, sf_dir))

    # -- helpers --------------------------------------------------------------
    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def replace(self, **frames: DataFrame) -> "Sources":
        return replace(self, **{k: conform(v, k) for k, v in frames.items()})

    def write_parquet(self, root: str, mode: str = "overwrite",
                      files: dict[str, int] | None = None) -> None:
        """Persist all tables (used to stage fixtures for benchmarks).

        ``files`` optionally sets the number of files of a table (round-robin
        split), e.g. to store the fact tables as several files so scans run
        as parallel tasks.
        """
        for name, df in self.as_dict().items():
            n = (files or {}).get(name)
            if n:
                df = df.repartition(n)
            df.write.mode(mode).parquet(os.path.join(root, name))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the declared columns and types of ``table`` (and the partition column of ``layout``, if it has it)."""
    schema = SCHEMAS[table]
    have = set(df.columns)
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if df.schema[f.name].dataType != f.dataType:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    if "sent_month" in have and table in ("mailing_mailing", "mailing_trace"):
        cols.append(F.col("sent_month"))
    return df.select(*cols)
