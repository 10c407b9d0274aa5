"""Pre-aggregations of the two fact tables, shared by several reports.

Each is a single ``groupBy`` with conditional counts, so the fact table is
scanned once and shrunk by the map-side partial aggregate before the
shuffle; a hot key (one mailing or campaign holding a third of all rows)
costs one partial row per task, not a third of the data in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Per mailing: traces now in status click and cancel.

    Only the two statuses are read (the filter reaches the Parquet scan),
    and traces without a mailing are dropped before the shuffle because no
    report can join them.
    """
    st = F.col("trace_status")
    return (
        traces.where(st.isin("click", "cancel") & F.col("mass_mailing_id").isNotNull())
        .groupBy("mass_mailing_id")
        .agg(
            F.count_if(st == "click").alias("clicked"),
            F.count_if(st == "cancel").alias("canceled"),
        )
    )


def participant_rollup(participants: DataFrame) -> DataFrame:
    """Per campaign: participants total, running, completed and test."""
    st = F.col("state")
    return (
        participants.where(F.col("campaign_id").isNotNull())
        .groupBy("campaign_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(st == "running").alias("running"),
            F.count_if(st == "completed").alias("completed"),
            F.count_if(F.col("is_test") == F.lit(True)).alias("test"),
        )
    )


def email_mailing_ids(mailings: DataFrame) -> DataFrame:
    """Ids of e-mail mailings (the dimension side of the trace joins)."""
    return mailings.where(F.col("mailing_type") == "mail").select(F.col("id").alias("_mailing_id"))
