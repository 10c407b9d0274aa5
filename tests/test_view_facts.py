"""The slice table against facts written down separately (fixed values of the reports' views).

Per report: list columns; pivot rows, column, measures; chart dimension and
measures; filters; search fields; group-bys.  ``slices.VIEWS`` feeds both the
engine and the slice oracle, so an error in it would pass there.
"""

import pytest

from mailmetrics.oracle.slices_sql import REPORT_COLUMNS
from mailmetrics.plans import slices

LISTS = {
    "campaign_stats": "subject email_from mailing_type state sent_date schedule_date total sent delivered opened clicked replied bounced failed canceled open_rate click_rate bounce_rate delivery_rate reply_rate",
    "delivery_details": "mailing_id email trace_status failure_type sent_datetime open_datetime clicked_datetime replied_datetime",
    "automation_overview": "campaign_name state create_date last_sync_date total_participants active_participants completed_participants test_participants email_activities open_rate delivery_rate bounce_rate reply_rate",
    "activity_stats": "campaign_id activity_name activity_type trigger_type interval_number interval_type sent opened clicked bounced replied processed rejected",
    "participant_breakdown": "campaign_id state is_test create_date participant_count",
    "monthly_trend": "month_label campaigns_sent total_sent total_delivered total_opened total_clicked total_bounced open_rate click_rate bounce_rate delivery_rate",
    "campaign_ranking": "rank subject engagement_score performance_tier open_rate click_rate delivery_rate reply_rate bounce_rate sent_date",
    "failure_breakdown": "failure_type month_label failure_count pct_of_total affected_campaigns",
    "send_time_analysis": "slot_type slot_label campaigns_sent avg_open_rate avg_click_rate performance_label",
    "subject_lines": "subject subject_length sent open_rate click_rate bounce_rate sent_date",
    "ab_test_results": "subject ab_testing_pc ab_testing_winner_selection ab_testing_completed sent open_rate click_rate bounce_rate sent_date",
    "trigger_effectiveness": "trigger_type activities_count total_sent avg_open_rate avg_click_rate avg_bounce_rate",
    "contact_engagement": "email total_received total_opened total_clicked total_bounced open_rate click_rate engagement_score engagement_tier",
    "list_health": "list_name total_contacts active_contacts opted_out bounced_ever active_pct health_score health_badge",
    "reengagement": "email last_opened days_since_last_open campaigns_since_last_open reengagement_status",
}
PIVOTS = {  # row, column, measures
    "campaign_stats": ("mailing_type", "state", "total sent opened clicked bounced open_rate click_rate delivery_rate"),
    "delivery_details": ("trace_status", "mailing_id", "trace_id"),
    "automation_overview": ("campaign_name", "state", "total_participants active_participants email_activities open_rate delivery_rate"),
    "activity_stats": ("trigger_type", "activity_type", "sent opened clicked bounced"),
    "participant_breakdown": ("campaign_id", "state", "participant_count"),
    "monthly_trend": ("month_label", "year", "total_sent total_opened total_clicked open_rate delivery_rate"),
    "campaign_ranking": ("performance_tier", None, "engagement_score open_rate delivery_rate"),
    "failure_breakdown": ("failure_type", "year", "failure_count affected_campaigns"),
    "send_time_analysis": ("slot_label", "slot_type", "campaigns_sent avg_open_rate avg_click_rate"),
    "subject_lines": ("subject", None, "sent open_rate click_rate subject_length"),
    "ab_test_results": ("ab_testing_winner_selection", "ab_testing_completed", "sent open_rate click_rate"),
    "trigger_effectiveness": ("trigger_type", None, "activities_count total_sent avg_open_rate avg_click_rate"),
    "contact_engagement": ("engagement_tier", None, "total_received total_opened engagement_score"),
    "list_health": ("health_badge", None, "total_contacts active_contacts bounced_ever health_score"),
    "reengagement": ("reengagement_status", None, "days_since_last_open campaigns_since_last_open"),
}
CHARTS = {
    "campaign_stats": ("subject", "sent opened clicked bounced"),
    "delivery_details": ("trace_status", "trace_id"),
    "automation_overview": ("campaign_name", "total_participants open_rate delivery_rate"),
    "activity_stats": ("trigger_type", "sent opened clicked"),
    "participant_breakdown": ("state", "participant_count"),
    "monthly_trend": ("month_label", "total_sent total_opened open_rate"),
    "failure_breakdown": ("failure_type", "failure_count"),
    "trigger_effectiveness": ("trigger_type", "avg_open_rate avg_click_rate avg_bounce_rate"),
    "list_health": ("list_name", "active_contacts opted_out bounced_ever"),
}
FILTERS = {
    "campaign_stats": {"sent": ("state", "=", "done"), "sending": ("state", "=", "sending"), "draft": ("state", "=", "draft")},
    "delivery_details": {n: ("trace_status", "=", v) for n, v in (("opened", "open"), ("clicked", "click"), ("bounced", "bounce"),
                                                                  ("replied", "reply"), ("failed", "error"), ("canceled", "cancel"))},
    "automation_overview": {n: ("state", "=", n) for n in ("running", "draft", "stopped")},
    "activity_stats": {n: ("activity_type", "=", n) for n in ("email", "action")},
    "participant_breakdown": {**{n: ("state", "=", n) for n in ("running", "completed", "removed")}, "no_test": ("is_test", "=", False)},
    "campaign_ranking": {n: ("performance_tier", "=", v) for n, v in (("top", "Top Performer"), ("avg", "Average"), ("poor", "Needs Attention"))},
    "send_time_analysis": {"by_hour": ("slot_type", "=", "hour"), "by_day": ("slot_type", "=", "day"),
                           "best": ("performance_label", "=", "Best"), "worst": ("performance_label", "=", "Worst")},
    "ab_test_results": {"completed": ("ab_testing_completed", "=", True), "in_progress": ("ab_testing_completed", "=", False)},
    "contact_engagement": {"highly_engaged": ("engagement_tier", "=", "Highly Engaged"), "moderate": ("engagement_tier", "=", "Moderate"),
                           "cold": ("engagement_tier", "=", "Cold"), "bounced": ("total_bounced", ">", 0)},
    "list_health": {n: ("health_badge", "=", v) for n, v in (("healthy", "Healthy"), ("average", "Average"), ("needs_cleaning", "Needs Cleaning"))},
    "reengagement": {n: ("reengagement_status", "=", v) for n, v in (("at_risk", "At Risk"), ("dormant", "Dormant"), ("lost", "Lost"))},
}
SEARCH = {
    "campaign_stats": "subject email_from", "delivery_details": "email mailing_id", "automation_overview": "campaign_name",
    "activity_stats": "activity_name campaign_id", "participant_breakdown": "campaign_id", "monthly_trend": "month_label",
    "campaign_ranking": "subject", "failure_breakdown": "failure_type month_label", "subject_lines": "subject",
    "ab_test_results": "subject", "trigger_effectiveness": "trigger_type", "contact_engagement": "email",
    "list_health": "list_name", "reengagement": "email",
}
GROUPS = {
    "campaign_stats": "state sent_date:month", "delivery_details": "trace_status mailing_id failure_type", "automation_overview": "state",
    "activity_stats": "campaign_id trigger_type activity_type", "participant_breakdown": "campaign_id state", "monthly_trend": "year",
    "campaign_ranking": "performance_tier", "failure_breakdown": "failure_type month_label", "send_time_analysis": "slot_type",
    "ab_test_results": "ab_testing_winner_selection", "contact_engagement": "engagement_tier", "list_health": "health_badge",
    "reengagement": "reengagement_status",
}
# How a measure is put together: rates, scores, lengths and days are averaged, ids counted, the rest summed.
MEANS = set("open_rate click_rate delivery_rate avg_open_rate avg_click_rate avg_bounce_rate engagement_score health_score "
            "subject_length days_since_last_open".split())


@pytest.mark.parametrize("name", list(LISTS))
def test_view(spark, name):
    v = slices.VIEWS[name]
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT_COLUMNS[name]))
    assert slices.list_view(df, name, ordered=False).columns == LISTS[name].split()
    row, column, measures = PIVOTS[name]
    assert (v.pivot.rows, v.pivot.column, list(v.pivot.measures)) == (row, column, measures.split())
    assert (v.chart and (v.chart.dimension, list(v.chart.measures))) == (name in CHARTS and (CHARTS[name][0], CHARTS[name][1].split()) or None)
    assert dict(v.predicates) == FILTERS.get(name, {})
    assert list(v.search) == SEARCH.get(name, "").split()
    assert sorted(v.group_bys.values()) == sorted(GROUPS.get(name, "").split())


def test_measure_kinds():
    for _, _, measures in PIVOTS.values():
        for m in measures.split():
            assert slices.measure_kind(m) == ("count" if m == "trace_id" else "mean" if m in MEANS else "sum"), m
