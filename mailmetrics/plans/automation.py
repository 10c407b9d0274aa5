"""Marketing automation reports: overview (R3), activities (R4), participants (R5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import mean2, ratio_exact_sql
from ..operators.ranking import range_row_number
from ..operators.rollups import participant_rollup
from ..sources.tables import Sources

_RATIOS = (
    ("opened_ratio", "open_rate"),
    ("received_ratio", "delivery_rate"),
    ("bounced_ratio", "bounce_rate"),
    ("replied_ratio", "reply_rate"),
)


def automation_overview(src: Sources, rollup: DataFrame | None = None) -> DataFrame:
    """Per automation campaign: participant counts, e-mail activities, mean rates.

    Participants are scanned once (one conditional aggregate instead of four
    counts).  The e-mail activities are left-joined to their mailing once:
    every activity counts in ``email_activities``, only those whose mailing
    exists count in the four mean ratios (null ratio as 0).  ``rollup``: the
    participant rollup, if there is one already.
    """
    parts = rollup if rollup is not None else participant_rollup(src.marketing_participant)

    acts = src.marketing_activity.where(
        (F.col("activity_type") == "email") & F.col("campaign_id").isNotNull()
    ).select("campaign_id", "mass_mailing_id")
    mm = src.mailing_mailing.select(
        F.col("id").alias("_mid"), *[F.col(r) for r, _ in _RATIOS]
    )
    aj = acts.join(mm, acts["mass_mailing_id"] == mm["_mid"], "left")
    act_stats = aj.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("email_cnt"),
        *[mean2(f"CASE WHEN _mid IS NOT NULL THEN {ratio_exact_sql(r)} END").alias(out)
          for r, out in _RATIOS],
    )

    c = src.marketing_campaign
    j = c.join(parts, c["id"] == parts["campaign_id"], "left").join(
        act_stats, c["id"] == act_stats["campaign_id"], "left"
    )
    zero = F.lit(0)
    return j.select(
        c["id"].alias("id"),
        c["id"].alias("campaign_id"),
        c["name"].alias("campaign_name"),
        c["state"].alias("state"),
        c["create_date"].alias("create_date"),
        c["last_sync_date"].alias("last_sync_date"),
        F.coalesce(F.col("total"), zero).alias("total_participants"),
        F.coalesce(F.col("running"), zero).alias("active_participants"),
        F.coalesce(F.col("completed"), zero).alias("completed_participants"),
        F.coalesce(F.col("test"), zero).alias("test_participants"),
        F.coalesce(F.col("email_cnt"), zero).alias("email_activities"),
        *[F.coalesce(F.col(out), F.lit(0.0)).alias(out) for _, out in _RATIOS],
    )


def activity_stats(src: Sources) -> DataFrame:
    """Per activity of any type: mailing counters plus the activity's own counters."""
    a = src.marketing_activity
    mm = src.mailing_mailing.select(
        F.col("id").alias("_mid"), F.col("sent").alias("_sent"),
        F.col("opened").alias("_opened"), F.col("replied").alias("_replied"),
    )
    j = a.join(mm, a["mass_mailing_id"] == mm["_mid"], "left")
    return j.select(
        a["id"].alias("id"),
        a["id"].alias("activity_id"),
        "campaign_id",
        F.col("name").alias("activity_name"),
        "activity_type",
        "trigger_type",
        "interval_number",
        "interval_type",
        F.coalesce(F.col("_sent"), F.lit(0)).alias("sent"),
        F.coalesce(F.col("_opened"), F.lit(0)).alias("opened"),
        F.coalesce(F.col("total_click"), F.lit(0)).alias("clicked"),
        F.coalesce(F.col("total_bounce"), F.lit(0)).alias("bounced"),
        F.coalesce(F.col("_replied"), F.lit(0)).alias("replied"),
        F.coalesce(F.col("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.col("rejected"), F.lit(0)).alias("rejected"),
    )


def participant_breakdown(src: Sources, numbered: bool = True) -> DataFrame:
    """Participants per (campaign, state, test flag, creation day).

    The day is returned as a midnight timestamp.  Ids follow the group keys
    ascending with nulls last; the result grows with campaigns x days, so
    rows are numbered by ranges of the keys.
    ``numbered=False`` leaves out ``id``.
    """
    day = F.to_date("create_date")
    g = src.marketing_participant.groupBy(
        "campaign_id", "state", "is_test", day.alias("_day")
    ).agg(F.count(F.lit(1)).alias("participant_count"))
    g = g.select(
        "campaign_id", "state", "is_test",
        F.col("_day").cast("timestamp_ntz").alias("create_date"),
        "participant_count",
    )
    if not numbered:
        return g
    order = [F.col(c).asc_nulls_last() for c in ("campaign_id", "state", "is_test", "create_date")]
    return range_row_number(g, order)
