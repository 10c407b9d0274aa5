"""Layer 4: plan checks on reports over staged Parquet tables.

No Python UDF anywhere, no cartesian product, each fact table scanned once
where the report needs it once, filters pushed into the Parquet scan, and no
single-partition exchange in the reports whose size grows with the data.
"""

import re
import tempfile

import pytest

from mailmetrics.plans.catalog import REPORTS, build_report
from mailmetrics.sources.tables import Sources

from helpers import sf_dir

AS_OF = "2001-08-01 00:00:00"


@pytest.fixture(scope="module")
def staged(spark):
    root = tempfile.mkdtemp(prefix="mailmetrics-plans-")
    Sources.from_driver_tables(spark, sf_dir("0.001")).write_parquet(root)
    return Sources.from_parquet(spark, root)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\]", text))


@pytest.mark.parametrize("name", list(REPORTS))
def test_no_python_and_no_cartesian(staged, name):
    text = plan(build_report(name, staged, as_of=AS_OF, numbered=False))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in text, f"{name}: {bad}"


def test_fact_tables_scanned_once(staged):
    assert scans(plan(build_report("automation_overview", staged)), "marketing_participant") == 1
    for name in ("failure_breakdown", "contact_engagement", "delivery_details"):
        text = plan(build_report(name, staged, as_of=AS_OF, numbered=False))
        assert scans(text, "mailing_trace") == 1, name
    assert scans(plan(build_report("reengagement", staged, as_of=AS_OF, numbered=False)), "mailing_trace") <= 2


@pytest.mark.parametrize("threshold", ["-1", "10m"])
@pytest.mark.parametrize("name,fact", [("reengagement", "mailing_trace"), ("contact_engagement", "mailing_trace"),
                                       ("participant_breakdown", "marketing_participant")])
def test_numbered_reports_read_their_fact_once(spark, staged, name, fact, threshold):
    """Rows and counts of the numbering come from one exchange: what ran holds one scan."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = build_report(name, staged, as_of=AS_OF)
        df.collect()
        text = plan(df).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert scans(text, fact) == 1 and "ReusedExchange" in text
    assert "SortMergeJoin" not in text and ("BroadcastHashJoin" in text) and "CartesianProduct" not in text or name == "contact_engagement"
    # the only steps in one task are running sums over the counts of ranges
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = next(x for x in lines[i + 1:] if "HashAggregate" in x)
            assert "keys=[_nondeterministic" in below, below


@pytest.mark.parametrize("name", ["failure_breakdown", "contact_engagement", "reengagement", "participant_breakdown"])
def test_facts_are_shuffled_as_partial_aggregates(spark, staged, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(build_report(name, staged, as_of=AS_OF, numbered=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [re.sub(r"^[\s:+*\-()0-9]*", "", x) for x in text.splitlines()]
    for i, line in enumerate(lines):
        if "FileScan" in line and ("mailing_trace" in line or "marketing_participant" in line):
            above = [x for x in lines[:i][::-1] if re.match(r"(Exchange|HashAggregate)", x)][0]
            assert above.startswith("HashAggregate") and "partial_" in above, (name, above)


def test_trace_filters_reach_the_scan(staged):
    text = plan(build_report("campaign_stats", staged))
    assert re.search(r"PushedFilters: \[[^\]]*In\(trace_status, \[cancel,click\]\)", text)
    text = plan(build_report("reengagement", staged, as_of=AS_OF, numbered=False))
    assert len(re.findall(r"PushedFilters: \[[^\]]*IsNotNull\(email\), Not\(EqualTo\(email,\)\)", text)) == scans(text, "mailing_trace")


def test_columns_pruned_at_scan(staged):
    text = plan(build_report("contact_engagement", staged, numbered=False))
    m = re.search(r"FileScan parquet [^\n]*mailing_trace\][^\n]*ReadSchema: (struct<[^>]*>)", text)
    assert m and m.group(1) == "struct<mass_mailing_id:bigint,email:string,trace_status:string>"


@pytest.mark.parametrize("name", ["contact_engagement", "participant_breakdown", "delivery_details", "list_health"])
def test_growing_reports_avoid_single_partition(staged, name):
    text = plan(build_report(name, staged, as_of=AS_OF, numbered=False))
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", ["campaign_stats", "delivery_details", "contact_engagement"])
def test_bloom_filter_of_mailing_ids_reaches_the_fact_scan(spark, staged, name):
    """With more ids than a broadcast takes, and the fact as large as ten gigabytes would be."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    small = sorted(map(str, build_report(name, staged, numbered=False).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(key, "0")
    try:
        df = build_report(name, staged, numbered=False)
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, df.collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset(key)
    assert "bloom_filter_agg" in text
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "might_contain" in line)
    assert "Filter" in lines[at] and "xxhash64(mass_mailing_id" in lines[at]
    fact = next(i for i, line in enumerate(lines) if i > at and "Relation" in line and "mass_mailing_id" in line)
    assert not any("Join" in line for line in lines[at:fact])  # nothing between the filter and the scan but the filter's own ids
