"""Results do not depend on the session time zone (timestamps are wall-clock NTZ)."""

import pytest

import __spark_entry__ as entry
from mailmetrics.oracle.compare import compare

from helpers import sf_dir


@pytest.mark.parametrize("key", ["reengagement", "monthly_trend", "send_time_analysis",
                                 "participant_breakdown", "campaign_stats__by_sent_date_month"])
def test_other_session_time_zone(spark, duck_small, key):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = entry.queries()[key](spark, sf_dir("0.001"))
        assert compare(df, duck_small, entry.oracle_sql()[key]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
