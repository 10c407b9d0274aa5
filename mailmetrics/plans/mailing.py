"""E-mail marketing reports: campaign statistics (R1), delivery details (R2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import pct, ratio2
from ..operators.rollups import email_mailing_ids, trace_rollup
from ..sources.tables import Sources


def campaign_stats(src: Sources, rollup: DataFrame | None = None) -> DataFrame:
    """One row per e-mail mailing in any state, with counters and five rates.

    Counters are taken from the mailing (null as 0) except clicked and
    canceled, which are counted from the traces' current status.  Four
    rates are the stored ratios; the click rate is clicked / sent.
    """
    m = src.mailing_mailing.where(F.col("mailing_type") == "mail")
    r = rollup if rollup is not None else trace_rollup(src.mailing_trace)
    j = m.join(r, m["id"] == r["mass_mailing_id"], "left")
    sent = F.coalesce(F.col("sent"), F.lit(0))
    bounced = F.coalesce(F.col("bounced"), F.lit(0))
    clicked = F.coalesce(F.col("clicked"), F.lit(0))
    return j.select(
        m["id"].alias("id"),
        m["id"].alias("mailing_id"),
        "subject",
        "email_from",
        "mailing_type",
        "state",
        "sent_date",
        "schedule_date",
        F.coalesce(F.col("expected"), F.lit(0)).alias("total"),
        sent.alias("sent"),
        F.greatest(F.lit(0), sent - bounced).alias("delivered"),
        F.coalesce(F.col("opened"), F.lit(0)).alias("opened"),
        clicked.alias("clicked"),
        F.coalesce(F.col("replied"), F.lit(0)).alias("replied"),
        bounced.alias("bounced"),
        F.coalesce(F.col("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.col("canceled"), F.lit(0)).alias("canceled"),
        ratio2("opened_ratio").alias("open_rate"),
        pct("coalesce(clicked, 0)", "sent").alias("click_rate"),
        ratio2("bounced_ratio").alias("bounce_rate"),
        ratio2("received_ratio").alias("delivery_rate"),
        ratio2("replied_ratio").alias("reply_rate"),
    )


def delivery_details(src: Sources) -> DataFrame:
    """One row per trace of an existing e-mail mailing.

    The mailing id is unique, so the inner join is a semi join: traces are
    never duplicated and no mailing column is carried through the shuffle.
    """
    t = src.mailing_trace.where(F.col("mass_mailing_id").isNotNull())
    ids = email_mailing_ids(src.mailing_mailing)
    j = t.join(ids, t["mass_mailing_id"] == ids["_mailing_id"], "left_semi")
    return j.select(
        F.col("id").alias("id"),
        F.col("id").alias("trace_id"),
        F.col("mass_mailing_id").alias("mailing_id"),
        "email",
        "trace_status",
        "failure_type",
        "sent_datetime",
        "open_datetime",
        F.col("links_click_datetime").alias("clicked_datetime"),
        F.col("reply_datetime").alias("replied_datetime"),
    )
