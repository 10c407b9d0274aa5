"""Bucketed and month-partitioned tables: same rows, fewer exchanges, pruned months."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from mailmetrics.plans.catalog import REPORTS, build_report
from mailmetrics.sources import layout
from mailmetrics.sources.tables import Sources

from helpers import sf_dir, sources
from test_random_tables import random_tables

AS_OF = "2001-08-01 00:00:00"
BY_MAILING = ("campaign_stats", "monthly_trend", "campaign_ranking", "send_time_analysis", "subject_lines", "ab_test_results", "trigger_effectiveness")


@pytest.fixture(scope="module", params=["mailing", "address"])
def stored(request, spark, tmp_path_factory):
    db = f"laid_{request.param}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_path_factory.mktemp(db)}'")
    plain = sources(spark, **random_tables(5))
    layout.store_tables(plain, db, traces=request.param, buckets=6)
    yield request.param, plain, Sources.from_catalog(spark, db)
    spark.sql(f"DROP DATABASE {db} CASCADE")


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def above_scan(df, table: str) -> list[str]:
    """Operators from the scan of ``table`` up to the first join or exchange."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = []
    for i, line in enumerate(lines):
        if re.search(rf"FileScan parquet [^ ]*\.{table}\[", line):
            depth = len(line) - len(line.lstrip(" :"))
            for x in reversed(lines[:i]):
                at = len(x) - len(x.lstrip(" :"))
                if at < depth:
                    depth = at
                    found.append(re.sub(r"^[\s:+*\-()0-9]*", "", x).split(" ")[0])
                    if found[-1] in ("Exchange", "SortMergeJoin"):
                        break
    return found


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(REPORTS))
def test_same_rows(stored, name):
    _, plain, src = stored
    assert rows(build_report(name, src, as_of=AS_OF)) == rows(build_report(name, plain, as_of=AS_OF))


def test_no_exchange_above_the_facts(shuffled, stored):
    kind, _, src = stored
    names = BY_MAILING if kind == "mailing" else ()
    for name in names:
        ops = above_scan(build_report(name, src), "mailing_trace")
        assert "SortMergeJoin" in ops and "Exchange" not in ops[:ops.index("SortMergeJoin")], (name, ops)
    ops = above_scan(build_report("automation_overview", src), "marketing_participant")
    assert "Exchange" not in ops[:ops.index("SortMergeJoin")], ops
    if kind == "address":
        for name in ("contact_engagement", "reengagement"):
            ops = above_scan(build_report(name, src, as_of=AS_OF, numbered=False), "mailing_trace")
            first = ops.index("Exchange") if "Exchange" in ops else len(ops)
            assert sum("Aggregate" in x for x in ops[:first]) == 2, (name, ops)  # partial and final


def test_months_reach_the_partitions(stored):
    _, plain, src = stored
    first, last = dt.date(2001, 2, 1), dt.date(2001, 3, 15)
    part, want = layout.sent_between(src, first, last), F.col("sent_date").between("2001-02-01", "2001-03-31 23:59:59.999999")
    for name in ("campaign_stats", "subject_lines", "ab_test_results"):
        df = build_report(name, part)
        assert re.search(r"PartitionFilters: \[[^\]]*sent_month", df._jdf.queryExecution().executedPlan().toString())
        assert rows(df) == rows(build_report(name, plain).where(want)) != []
    months = build_report("monthly_trend", plain).where("year = 2001 AND month IN (2, 3)").drop("id")
    assert rows(build_report("monthly_trend", part).drop("id")) == rows(months)
    details = build_report("delivery_details", layout.traces_between(src, first, last))
    text = details._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"mailing_trace\[[^\n]*PartitionFilters: \[[^\]]*sent_month", text)
    assert rows(details) == rows(build_report("delivery_details", plain).where(F.col("sent_datetime").between("2001-02-01", "2001-03-31 23:59:59.999999")))
    # without the layout the same restriction is a plain filter
    assert rows(build_report("campaign_stats", layout.sent_between(plain, first, last))) == rows(build_report("campaign_stats", part))
