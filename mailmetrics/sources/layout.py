"""Storage layout of the source tables: bucketed, sorted and partitioned by month.

``store_tables`` writes catalog tables whose layout the reports' plans use when
they are bound with ``Sources.from_catalog``:

* the traces are bucketed and sorted by mailing (the click rollup of R1, R6, R7,
  R9-R12 then needs no exchange above the scan) or by address (R13 and R15 then
  aggregate by address and mailing without one); participants by campaign (R3, R5);
* mailings and traces have a partition column ``sent_month``, the first day of
  the month of ``sent_date`` / ``sent_datetime`` (null stays null), which
  ``sent_between`` and ``traces_between`` reach besides the time stamp itself.

A key's rows share a bucket, whose size is that of its largest keys: choose the
address layout only where no address holds a large share of the traces, else
the plain tables, whose exchanges carry partial sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Sources

MONTH = "sent_month"
#: Table -> the time stamp its months come from.
MONTHS_OF = {"mailing_mailing": "sent_date", "mailing_trace": "sent_datetime"}
#: Layout of the traces -> bucket column.
TRACE_LAYOUTS = {"mailing": "mass_mailing_id", "address": "email"}


def month_of(stamp: str) -> Column:
    return F.trunc(F.to_date(stamp), "month")


def store_tables(src: Sources, database: str, *, traces: str = "mailing", buckets: int = 200, months: bool = True,
                 mode: str = "overwrite") -> None:
    """Write all tables into ``database``; facts with ``buckets`` buckets, ``traces`` by "mailing" or by "address".

    Rows are dealt out by (month, bucket key) before the write, so a month's
    bucket is one file, not one per task.
    """
    keys = {"mailing_trace": TRACE_LAYOUTS[traces], "marketing_participant": "campaign_id"}
    for name, df in src.as_dict().items():
        stamp = MONTHS_OF.get(name) if months else None
        df = df.drop(MONTH)
        if stamp:
            df = df.withColumn(MONTH, month_of(stamp))
        key = keys.get(name)
        if key:
            df = df.repartition(buckets, *([MONTH] if stamp else []), key)
        w = df.write.mode(mode).format("parquet")
        if stamp:
            w = w.partitionBy(MONTH)
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"{database}.{name}")


def _within(df: DataFrame, stamp: str, first: dt.date, last: dt.date) -> DataFrame:
    first, last = first.replace(day=1), last.replace(day=1)
    after = (last + dt.timedelta(days=31)).replace(day=1)
    at = F.col(stamp)
    kept = df.where((at >= F.lit(str(first)).cast("timestamp_ntz")) & (at < F.lit(str(after)).cast("timestamp_ntz")))
    return kept.where(F.col(MONTH).between(F.lit(first), F.lit(last))) if MONTH in df.columns else kept


def sent_between(src: Sources, first: dt.date, last: dt.date) -> Sources:
    """The mailings sent in the months from ``first`` to ``last``, with all other tables whole.

    R1, R2, R10 and R11 over it are their rows of those mailings, R6 its rows of
    those months; R7 and R9 rank what was sent then.
    """
    return src.replace(mailing_mailing=_within(src.mailing_mailing, "sent_date", first, last))


def traces_between(src: Sources, first: dt.date, last: dt.date) -> Sources:
    """The traces sent in the months from ``first`` to ``last`` (R2: its rows of those months; R8, R13: over those traces)."""
    return src.replace(mailing_trace=_within(src.mailing_trace, "sent_datetime", first, last))
