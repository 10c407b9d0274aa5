"""Layer 2: edge tables by hand; expected values worked out from the report rules."""

from mailmetrics.plans import audience, automation, insights, mailing as mailing_reports, slices

from helpers import mailing, rows_by, sources, trace, ts

AS_OF = "2024-06-01 00:00:00"


def test_e1_click_rate_null_when_nothing_sent(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent=0), mailing(2, sent=None)],
                  mailing_trace=[trace(1, 1, "click"), trace(2, 2, "click")])
    for report in (mailing_reports.campaign_stats, insights.campaign_ranking,
                   insights.subject_lines):
        got = rows_by(report(src), "id")
        assert got[1]["click_rate"] is None and got[2]["click_rate"] is None
    r1 = rows_by(mailing_reports.campaign_stats(src), "id")
    assert r1[1]["sent"] == 0 and r1[2]["sent"] == 0 and r1[2]["clicked"] == 1
    ab = sources(spark, mailing_mailing=[mailing(3, sent=0, ab_testing_enabled=True)])
    assert insights.ab_test_results(ab).collect()[0]["click_rate"] is None


def test_e2_delivered_floored_at_zero(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent=5, bounced=9)])
    assert mailing_reports.campaign_stats(src).collect()[0]["delivered"] == 0
    assert insights.monthly_trend(src).collect()[0]["total_delivered"] == 0


def test_e3_click_rate_rounds_half_up(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent=160)],
                  mailing_trace=[trace(i, 1, "click") for i in range(23)])
    assert mailing_reports.campaign_stats(src).collect()[0]["click_rate"] == 14.38


def test_e4_null_click_rates_skipped_in_trend_zero_in_send_time(spark):
    src = sources(
        spark,
        mailing_mailing=[mailing(1, sent=None), mailing(2, sent=10, sent_date=ts("2024-03-11 10:00:00"))],
        mailing_trace=[trace(1, 2, "click")],
    )
    assert insights.monthly_trend(src).collect()[0]["click_rate"] == 10.0
    hour = [r for r in insights.send_time_analysis(src).collect() if r["slot_type"] == "hour"]
    assert len(hour) == 1 and hour[0]["avg_click_rate"] == 5.0


def test_e5_negative_score(spark):
    src = sources(spark, mailing_mailing=[mailing(1, opened_ratio=0.0, received_ratio=0.0,
                                                  replied_ratio=0.0, bounced_ratio=100.0)])
    row = insights.campaign_ranking(src).collect()[0]
    assert row["engagement_score"] == -10.0
    assert row["performance_tier"] == "Needs Attention"


def test_e6_rank_with_ties(spark):
    def m(i, o):
        return mailing(i, opened_ratio=o, received_ratio=0.0, replied_ratio=0.0, bounced_ratio=0.0)

    src = sources(spark, mailing_mailing=[m(1, 125.0), m(2, 125.0), m(3, 100.0)])
    got = rows_by(insights.campaign_ranking(src), "id")
    assert [got[i]["engagement_score"] for i in (1, 2, 3)] == [50.0, 50.0, 40.0]
    assert [got[i]["rank"] for i in (1, 2, 3)] == [1, 1, 3]
    assert got[3]["performance_tier"] == "Top Performer"


def test_e7_failure_share_over_all_types(spark):
    src = sources(
        spark,
        mailing_mailing=[mailing(1), mailing(2, mailing_type="sms")],
        mailing_trace=[trace(1, 1, "bounce", failure_type="mail_bounce"),
                       trace(2, 2, "error", failure_type="sms_credit"),
                       trace(3, 99, "error", failure_type="unknown")],
    )
    rows = insights.failure_breakdown(src).collect()
    assert len(rows) == 1
    assert rows[0]["pct_of_total"] == 33.33 and rows[0]["affected_campaigns"] == 1


def test_e8_failure_without_send_time(spark):
    src = sources(
        spark, mailing_mailing=[mailing(1)],
        mailing_trace=[trace(1, 1, "bounce", failure_type="mail_bounce"),
                       trace(2, 1, "bounce", failure_type="mail_bounce", sent_datetime=None)],
    )
    rows = insights.failure_breakdown(src).collect()
    assert len(rows) == 2
    nulls = [r for r in rows if r["month_label"] is None]
    assert len(nulls) == 1 and nulls[0]["year"] is None and nulls[0]["month"] is None


def test_e9_e10_single_slot_is_worst_and_labels(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent_date=ts("2024-03-03 05:00:00"))])
    got = {(r["slot_type"], r["slot_label"], r["slot_value"], r["performance_label"])
           for r in insights.send_time_analysis(src).collect()}
    assert got == {("hour", "05:00", 5, "Worst"), ("day", "Sunday", 7, "Worst")}


def test_e11_month_label_padding(spark):
    src = sources(spark, mailing_mailing=[mailing(1, sent_date=ts("2024-09-10 10:00:00")),
                                          mailing(2, sent_date=ts("2024-05-10 10:00:00"))])
    labels = {r["month_label"] for r in insights.monthly_trend(src).collect()}
    assert labels == {"September 2024", "May       2024"}


def _activity(i, **kw):
    row = dict(id=i, campaign_id=1, name=f"a{i}", activity_type="email", trigger_type="begin",
               interval_number=1, interval_type="days", mass_mailing_id=None)
    row.update(kw)
    return row


def test_e12_null_and_begin_triggers_are_two_rows(spark):
    src = sources(spark, marketing_activity=[_activity(1, trigger_type=None), _activity(2)])
    rows = insights.trigger_effectiveness(src).collect()
    assert [r["trigger_type"] for r in rows] == ["begin", "begin"]
    assert sorted(r["id"] for r in rows) == [1, 2]


def test_e13_activity_without_mailing(spark):
    src = sources(
        spark,
        marketing_campaign=[dict(id=1, name="c", state="running", create_date=ts("2024-01-01 00:00:00"))],
        mailing_mailing=[mailing(7, opened_ratio=40.0)],
        marketing_activity=[_activity(1, mass_mailing_id=None), _activity(2, mass_mailing_id=7)],
    )
    r3 = automation.automation_overview(src).collect()[0]
    assert r3["open_rate"] == 40.0 and r3["email_activities"] == 2
    r12 = insights.trigger_effectiveness(src).collect()[0]
    assert r12["avg_open_rate"] == 20.0


def test_e14_engagement_scores(spark):
    traces = []
    traces += [trace(100 + i, 1, "open", email="a@x") for i in range(10)]
    traces += [trace(200 + i, 1, "open", email="b@x") for i in range(9)] + [trace(300, 1, "bounce", email="b@x")]
    traces += [trace(400, 1, "bounce", email="c@x")]
    src = sources(spark, mailing_mailing=[mailing(1)], mailing_trace=traces)
    got = rows_by(audience.contact_engagement(src), "email")
    assert (got["a@x"]["engagement_score"], got["a@x"]["engagement_tier"]) == (50.0, "Moderate")
    assert (got["b@x"]["engagement_score"], got["b@x"]["engagement_tier"]) == (35.0, "Cold")
    assert (got["c@x"]["engagement_score"], got["c@x"]["engagement_tier"]) == (0.0, "Cold")
    assert [got[e]["id"] for e in ("a@x", "b@x", "c@x")] == [1, 2, 3]


def _list_sources(spark, subs, contacts, traces, lists=((1, "L1"),)):
    return sources(
        spark,
        mailing_list=[dict(id=i, name=n) for i, n in lists],
        mailing_contact=[dict(id=i, email=e) for i, e in contacts],
        mailing_contact_subscription=subs,
        mailing_trace=traces,
    )


def test_e15_list_health(spark):
    contacts = [(i, f"p{i}@x") for i in range(20)]
    subs = [dict(id=i, contact_id=i, list_id=1, opt_out=i >= 17) for i in range(20)]
    traces = [trace(1, 5, "bounce", email="p0@x"), trace(2, 5, "bounce", email="p1@x")]
    row = audience.list_health(_list_sources(spark, subs, contacts, traces)).collect()[0]
    assert (row["active_pct"], row["health_score"], row["health_badge"]) == (85.0, 83.0, "Healthy")
    assert (row["total_contacts"], row["active_contacts"], row["opted_out"], row["bounced_ever"]) == (20, 17, 3, 2)


def test_e16_unknown_opt_out_and_empty_list(spark):
    subs = [dict(id=1, contact_id=1, list_id=1, opt_out=None), dict(id=2, contact_id=2, list_id=1, opt_out=False)]
    src = _list_sources(spark, subs, [(1, "a@x"), (2, "b@x")], [], lists=((1, "L1"), (2, "empty")))
    rows = audience.list_health(src).collect()
    assert len(rows) == 1
    assert (rows[0]["total_contacts"], rows[0]["active_contacts"], rows[0]["opted_out"]) == (2, 1, 0)


def test_e17_shared_bounced_address_counted_once(spark):
    subs = [dict(id=1, contact_id=1, list_id=1, opt_out=False), dict(id=2, contact_id=2, list_id=1, opt_out=False)]
    src = _list_sources(spark, subs, [(1, "same@x"), (2, "same@x")],
                        [trace(1, 5, "bounce", email="same@x"), trace(2, 6, "bounce", email="same@x")])
    assert audience.list_health(src).collect()[0]["bounced_ever"] == 1


def test_e18_recency_boundaries(spark):
    opens = {"d30@x": "2024-05-02 00:00:00", "d30s@x": "2024-05-01 23:59:59",
             "d60s@x": "2024-04-01 23:59:59", "d90s@x": "2024-03-02 23:59:59"}
    traces = [trace(i, 1, "open", email=e, open_datetime=ts(t)) for i, (e, t) in enumerate(opens.items())]
    got = rows_by(audience.reengagement(sources(spark, mailing_trace=traces), as_of=AS_OF), "email")
    assert "d30@x" not in got
    assert (got["d30s@x"]["reengagement_status"], got["d30s@x"]["days_since_last_open"]) == ("At Risk", 30)
    assert (got["d60s@x"]["reengagement_status"], got["d60s@x"]["days_since_last_open"]) == ("Dormant", 60)
    assert (got["d90s@x"]["reengagement_status"], got["d90s@x"]["days_since_last_open"]) == ("Lost", 90)


def test_e19_never_opened(spark):
    traces = [trace(1, 1, "sent", email="n@x"), trace(2, 2, "sent", email="n@x"),
              trace(3, 3, "outgoing", email="n@x", sent_datetime=None)]
    row = audience.reengagement(sources(spark, mailing_trace=traces), as_of=AS_OF).collect()[0]
    assert row["reengagement_status"] == "Lost" and row["days_since_last_open"] is None
    assert row["campaigns_since_last_open"] == 3 and row["last_opened"] is None


def test_e20_unsent_trace_after_open_not_counted(spark):
    traces = [trace(1, 1, "open", email="o@x", open_datetime=ts("2024-01-01 00:00:00")),
              trace(2, 2, "sent", email="o@x", sent_datetime=ts("2024-02-01 00:00:00")),
              trace(3, 3, "outgoing", email="o@x", sent_datetime=None),
              trace(4, 4, "sent", email="o@x", sent_datetime=ts("2023-12-01 00:00:00"))]
    row = audience.reengagement(sources(spark, mailing_trace=traces), as_of=AS_OF).collect()[0]
    assert row["campaigns_since_last_open"] == 1


def test_e21_campaign_without_participants_and_orphan_participant(spark):
    src = sources(
        spark,
        marketing_campaign=[dict(id=1, name="c1", state="draft", create_date=ts("2024-01-01 00:00:00"))],
        marketing_participant=[
            dict(campaign_id=None, state="running", is_test=False, create_date=ts("2024-01-02 05:00:00")),
            dict(campaign_id=2, state="running", is_test=False, create_date=ts("2024-01-02 06:00:00")),
        ],
    )
    r3 = automation.automation_overview(src).collect()[0]
    assert (r3["total_participants"], r3["active_participants"], r3["email_activities"], r3["open_rate"]) == (0, 0, 0, 0.0)
    r5 = sorted(automation.participant_breakdown(src).collect(), key=lambda r: r["id"])
    assert [r["campaign_id"] for r in r5] == [2, None]
    assert r5[1]["create_date"] == ts("2024-01-02 00:00:00")


def test_e22_sms_and_unlinked_traces(spark):
    src = sources(
        spark,
        mailing_mailing=[mailing(1, mailing_type="sms")],
        mailing_trace=[trace(1, 1, "sent", email="s@x"), trace(2, None, "sent", email="s@x")],
    )
    assert mailing_reports.delivery_details(src).count() == 0
    assert audience.contact_engagement(src).count() == 0
    row = audience.reengagement(src, as_of=AS_OF).collect()[0]
    assert row["email"] == "s@x" and row["campaigns_since_last_open"] == 1


def test_parameters_change_tiers_and_thresholds(spark):
    src = sources(spark, mailing_mailing=[mailing(1, opened_ratio=50.0, received_ratio=0.0,
                                                  replied_ratio=0.0, bounced_ratio=0.0)])
    row = insights.campaign_ranking(src, tiers=((10, "High"),), default_tier="Low").collect()[0]
    assert (row["engagement_score"], row["performance_tier"]) == (20.0, "High")
    traces = [trace(1, 1, "open", email="a@x", open_datetime=ts("2024-05-20 00:00:00"))]
    got = audience.reengagement(sources(spark, mailing_trace=traces), as_of=AS_OF,
                                thresholds=((20, "Late"), (7, "Quiet"))).collect()
    assert [(r["reengagement_status"], r["days_since_last_open"]) for r in got] == [("Quiet", 12)]


def test_missed_mailings_edges(spark):
    traces = [trace(1, 1, "open", email="o@x", open_datetime=ts("2024-01-01 00:00:00")),
              trace(2, 2, "sent", email="o@x", sent_datetime=ts("2024-02-01 00:00:00")),
              trace(3, 3, "outgoing", email="o@x", sent_datetime=None),
              trace(4, 1, "sent", email="n@x"), trace(5, 2, "sent", email="n@x"),
              trace(6, 3, "outgoing", email="n@x", sent_datetime=None),
              trace(7, None, "sent", email="n@x")]
    src = sources(spark, mailing_trace=traces)
    got = {r["email"]: r["campaigns_since_last_open"] for r in audience.reengagement(src, as_of=AS_OF).collect()}
    assert got == {"o@x": 1, "n@x": 3}  # an unsent trace is missed only by an address that never opened


def test_highly_engaged_predicate_with_other_tiers(spark):
    traces = [trace(1, 1, "open", email="o@x"), trace(2, 1, "sent", email="n@x")]
    src = sources(spark, mailing_mailing=[mailing(1)], mailing_trace=traces)
    df = audience.contact_engagement(src, tiers=((50, "Highly Engaged"), (20, "Moderate")))
    got = slices.filter_view(slices.list_view(df, "contact_engagement"), "contact_engagement", "highly_engaged")
    assert [r["email"] for r in got.collect()] == ["o@x"]


def test_as_of_with_a_time_zone(spark):
    import datetime as dt

    traces = [trace(1, 1, "open", email="a@x", open_datetime=ts("2024-05-01 00:00:00"))]
    src = sources(spark, mailing_trace=traces)
    zone = dt.timezone(dt.timedelta(hours=5))
    early = dt.datetime(2024, 5, 31, 4, 0, tzinfo=zone)   # 2024-05-30 23:00 UTC: 29 days
    late = dt.datetime(2024, 5, 31, 6, 0, tzinfo=zone)    # 2024-05-31 01:00 UTC: 30 days and an hour
    assert audience.reengagement(src, as_of=early).count() == 0
    assert audience.reengagement(src, as_of=late).count() == 1


def test_stored_ratio_is_rounded_once(spark):
    from mailmetrics.plans import mailing as mailing_reports

    src = sources(spark, mailing_mailing=[mailing(1, opened_ratio=100.0 / 20001)])
    assert mailing_reports.campaign_stats(src).first()["open_rate"] == 0.0
