"""The slice layer: inventory counts, default orders, wide pivots, named filters."""

import pytest

from mailmetrics.plans import insights, mailing as mailing_reports, slices

from helpers import mailing, sources, trace, ts


def test_inventory_counts():
    v = slices.VIEWS
    assert len(v) == 15
    assert sum(1 for x in v.values() if x.chart) == 9
    assert sum(len(x.predicates) for x in v.values()) == 37
    assert sum(len(x.search) for x in v.values()) == 18
    assert sum(len(x.group_bys) for x in v.values()) == 20


def test_default_order_puts_nulls_first_when_descending(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent_date=ts("2024-01-01 00:00:00")),
                                          mailing(2, sent_date=None),
                                          mailing(3, sent_date=ts("2024-02-01 00:00:00"))])
    df = slices.list_view(mailing_reports.campaign_stats(src), "campaign_stats")
    assert "id" not in df.columns and "mailing_id" not in df.columns
    assert [r["subject"] for r in df.collect()] == ["subject 2", "subject 3", "subject 1"]


def test_wide_pivot_columns(spark):
    src = sources(spark, mailing_mailing=[mailing(1, state="done"), mailing(2, state="draft", sent=50)])
    df = slices.pivot_view(mailing_reports.campaign_stats(src), "campaign_stats")
    assert "done_sent" in df.columns and "in_queue_click_rate" in df.columns
    row = df.collect()[0]
    assert (row["done_sent"], row["draft_sent"], row["sending_sent"]) == (100, 50, None)


def test_filters_are_alternatives(spark):
    src = sources(spark, mailing_mailing=[mailing(1, state="done"), mailing(2, state="draft"),
                                          mailing(3, state="sending")])
    df = mailing_reports.campaign_stats(src)
    got = {r["id"] for r in slices.filter_view(df, "campaign_stats", "sent", "draft").collect()}
    assert got == {1, 2}


def test_search_is_case_insensitive_and_keys_exact(spark):
    src = sources(spark, mailing_mailing=[mailing(1, subject="Spring SALE"), mailing(12, subject="other")])
    df = mailing_reports.campaign_stats(src)
    assert slices.search_view(df, "campaign_stats", "subject", "sale").count() == 1
    ab = sources(spark, mailing_mailing=[mailing(1)], mailing_trace=[trace(1, 1), trace(2, 12)])
    dd = mailing_reports.delivery_details(ab)
    assert slices.search_view(dd, "delivery_details", "mailing_id", "1").count() == 1


def test_group_by_month(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent_date=ts("2024-03-04 10:00:00")),
                                          mailing(2, sent_date=ts("2024-03-20 10:00:00"))])
    rows = slices.group_view(mailing_reports.campaign_stats(src), "campaign_stats", "sent_date_month").collect()
    assert len(rows) == 1 and rows[0]["sent_date_month"] == ts("2024-03-01 00:00:00")
    assert rows[0]["record_count"] == 2 and rows[0]["sent"] == 200


def test_chart_missing_raises(spark):
    src = sources(spark, mailing_mailing=[mailing(1)])
    with pytest.raises(KeyError):
        slices.chart_series(insights.campaign_ranking(src), "campaign_ranking")


def test_wide_pivots_lose_no_row(spark):
    """Null and unlisted column values have columns of their own."""
    rows = [(1, "running"), (1, None), (1, "paused"), (2, "removed"), (None, "odd")]
    df = spark.createDataFrame(rows, "campaign_id long, state string").selectExpr("*", "1L as participant_count")
    got = {r["campaign_id"]: r.asDict() for r in slices.pivot_view(df, "participant_breakdown").collect()}
    assert (got[1]["running"], got[1]["other"], got[1]["null"]) == (1, 1, 1)
    total = sum(v or 0 for r in got.values() for k, v in r.items() if k != "campaign_id")
    assert total == len(rows)


# Written from the reference views, not from the engine's table: list columns and default order.
ORDERS = {
    "campaign_stats": [("sent_date", True)],
    "delivery_details": [("sent_datetime", True)],
    "automation_overview": [("create_date", True)],
    "activity_stats": [("campaign_id", False), ("activity_name", False)],
    "participant_breakdown": [("campaign_id", False), ("state", False)],
    "monthly_trend": [("year", True), ("month", True)],
    "campaign_ranking": [("rank", False)],
    "failure_breakdown": [("failure_count", True)],
    "send_time_analysis": [("avg_open_rate", True)],
    "subject_lines": [("open_rate", True)],
    "ab_test_results": [("sent_date", True)],
    "trigger_effectiveness": [("avg_open_rate", True)],
    "contact_engagement": [("engagement_score", True)],
    "list_health": [("health_score", True)],
    "reengagement": [("days_since_last_open", True)],
}


@pytest.mark.parametrize("name", list(ORDERS))
def test_all_default_orders(spark, name):
    """Descending puts nulls first, ascending puts them last."""
    keys = ORDERS[name]
    hidden = slices.VIEWS[name].hidden
    cols = ["c1", *[c for c, _ in keys]]
    data = [(str(i), *[None if (i + j) % 4 == 0 else (i * 7 + j) % 5 for j in range(len(keys))]) for i in range(20)]
    df = spark.createDataFrame(data, ", ".join(["c1 string", *[f"{c} int" for c, _ in keys]])).repartition(4)
    if name == "campaign_ranking":
        df = df.selectExpr(*cols, *[f"0 as {c}" for c in slices.VIEWS[name].columns if c != "rank"])
    got = [tuple(r[c] for c, _ in keys if c not in hidden) for r in slices.list_view(df, name).collect()] if not set(c for c, _ in keys) & set(hidden) \
        else [tuple(r[c] for c, _ in keys) for r in df.orderBy(*[slices._order_col(c, d) for c, d in slices.VIEWS[name].order]).collect()]

    def key(row):
        return [((0, 0) if v is None else (1, -v)) if desc else ((1, 0) if v is None else (0, v)) for v, (_, desc) in zip(row, keys)]

    assert got == sorted(got, key=key)


def test_ranking_list_starts_with_rank_and_ends_with_the_send_date(spark):
    df = slices.list_view(insights.campaign_ranking(sources(spark, mailing_mailing=[mailing(1)])), "campaign_ranking")
    assert df.columns == ["rank", "subject", "engagement_score", "performance_tier", "open_rate", "click_rate",
                          "delivery_rate", "reply_rate", "bounce_rate", "sent_date"]
