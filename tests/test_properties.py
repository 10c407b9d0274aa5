"""Layer 3: properties of the reports on the sf0.01 fixture, and invariance
under repartitioning of the inputs."""

import pytest
from pyspark.sql import functions as F

from mailmetrics.plans.catalog import build_report
from mailmetrics.sources.tables import Sources

from helpers import sf_dir

AS_OF = "2001-08-01 00:00:00"


@pytest.fixture(scope="module")
def src(spark):
    return Sources.from_driver_tables(spark, sf_dir("0.01"))


def rep(src, name, **kw):
    return build_report(name, src, as_of=AS_OF, **kw)


def test_delivery_details_counts_email_traces(src):
    mail_ids = src.mailing_mailing.where("mailing_type = 'mail'").select("id")
    want = src.mailing_trace.join(mail_ids, src.mailing_trace.mass_mailing_id == mail_ids.id, "left_semi").count()
    assert rep(src, "delivery_details").count() == want


def test_participant_counts_sum_to_participants(src):
    got = rep(src, "participant_breakdown", numbered=False).agg(F.sum("participant_count")).first()[0]
    assert got == src.marketing_participant.count()


def test_rank_one_has_maximal_score(src):
    df = rep(src, "campaign_ranking")
    top = df.agg(F.max("engagement_score")).first()[0]
    assert {r["engagement_score"] for r in df.where("rank = 1").collect()} == {top}


def test_send_time_slices_cover_the_base(src):
    df = rep(src, "send_time_analysis")
    per_type = {r["slot_type"]: r["n"] for r in df.groupBy("slot_type").agg(F.sum("campaigns_sent").alias("n")).collect()}
    assert per_type["hour"] == per_type["day"] > 0
    assert df.where("slot_type = 'day'").count() <= 7 and df.where("slot_type = 'hour'").count() <= 24


def test_engagement_bounds(src):
    df = rep(src, "contact_engagement", numbered=False)
    assert df.where("total_opened + total_clicked + total_bounced > total_received").count() == 0
    lo, hi = df.agg(F.min("engagement_score"), F.max("engagement_score")).first()
    assert 0 <= lo and hi <= 50


def test_list_health_bounds(src):
    df = rep(src, "list_health")
    assert df.where("active_contacts + opted_out > total_contacts").count() == 0
    assert df.where("health_score < 0 OR health_score > 100").count() == 0


def test_reengagement_ages(src):
    df = rep(src, "reengagement", numbered=False)
    assert df.where("days_since_last_open IS NOT NULL AND days_since_last_open <= 29").count() == 0
    assert df.where("last_opened IS NULL AND reengagement_status <> 'Lost'").count() == 0


@pytest.mark.parametrize("name", ["campaign_stats", "failure_breakdown", "contact_engagement",
                                  "list_health", "reengagement", "participant_breakdown"])
def test_invariant_under_repartitioning(spark, src, name):
    shuffled = Sources.from_frames({k: v.repartition(7) for k, v in src.as_dict().items()})
    a = sorted(tuple(r) for r in rep(src, name).collect())
    b = sorted(tuple(r) for r in rep(shuffled, name).collect())
    assert a == b
