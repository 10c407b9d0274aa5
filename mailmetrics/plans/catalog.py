"""The fifteen reports by name, and their registration as temp views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Sources
from . import audience, automation, insights, mailing

# report name (also its view name) -> builder
REPORTS: dict[str, Callable[..., DataFrame]] = {
    "campaign_stats": mailing.campaign_stats,
    "delivery_details": mailing.delivery_details,
    "automation_overview": automation.automation_overview,
    "activity_stats": automation.activity_stats,
    "participant_breakdown": automation.participant_breakdown,
    "monthly_trend": insights.monthly_trend,
    "campaign_ranking": insights.campaign_ranking,
    "failure_breakdown": insights.failure_breakdown,
    "send_time_analysis": insights.send_time_analysis,
    "subject_lines": insights.subject_lines,
    "ab_test_results": insights.ab_test_results,
    "trigger_effectiveness": insights.trigger_effectiveness,
    "contact_engagement": audience.contact_engagement,
    "list_health": audience.list_health,
    "reengagement": audience.reengagement,
}

# Reports whose plan starts from the shared click/cancel rollup of the traces.
USES_ROLLUP = {
    "campaign_stats", "monthly_trend", "campaign_ranking", "send_time_analysis",
    "subject_lines", "ab_test_results", "trigger_effectiveness",
}


# Reports numbered by buckets; ``numbered=False`` skips ids.
NUMBERED = {"participant_breakdown", "contact_engagement", "reengagement"}


def build_report(name: str, src: Sources, *, rollup: DataFrame | None = None,
                 as_of: dt.datetime | str | None = None, numbered: bool = True) -> DataFrame:
    fn = REPORTS[name]
    if name == "reengagement":
        return fn(src, as_of=as_of, numbered=numbered)
    if name in NUMBERED:
        return fn(src, numbered=numbered)
    if name in USES_ROLLUP:
        return fn(src, rollup=rollup)
    return fn(src)


def register_reports(spark: SparkSession, src: Sources, *, prefix: str = "",
                     as_of: dt.datetime | str | None = None,
                     names: list[str] | None = None) -> dict[str, DataFrame]:
    """(Re)create each report as a temp view ``<prefix><name>``; repeatable.

    Views hold plans, not data: every query on a view reads the source tables
    as they are then (and the clock, unless ``as_of`` is given), and is
    optimised together with the user's own filters and projections.  Nothing
    is cached or checkpointed.  (Spark itself remembers the files of a table
    read by path until ``REFRESH TABLE <view>``; catalog tables need none.)
    """
    out = {}
    for name in names or list(REPORTS):
        df = build_report(name, src, as_of=as_of)
        df.createOrReplaceTempView(prefix + name)
        out[name] = df
    return out
