"""Hot keys: one address and one mailing hold a third of all traces, one list
a third of all subscriptions.  All fifteen reports must still equal the SQL
oracle (run by DuckDB over the same staged tables)."""

import re
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from mailmetrics.oracle.compare import compare
from mailmetrics.oracle.reports_sql import report_sql
from mailmetrics.plans.catalog import REPORTS, build_report
from mailmetrics.sources.schemas import SCHEMAS
from mailmetrics.sources.tables import Sources

from helpers import sf_dir

AS_OF = "2001-08-01 00:00:00"


@pytest.fixture(scope="module")
def skewed(spark):
    base = Sources.from_driver_tables(spark, sf_dir("0.01"))
    hot = F.col("id") % 3 == 0
    traces = base.mailing_trace.withColumn(
        "email", F.when(hot, F.lit("shared@example.com")).otherwise(F.col("email"))
    ).withColumn(
        "mass_mailing_id", F.when(F.col("id") % 3 == 1, F.lit(100).cast("bigint")).otherwise(F.col("mass_mailing_id"))
    )
    subs = base.mailing_contact_subscription.withColumn(
        "list_id", F.when(F.col("contact_id") % 3 == 0, F.lit(7)).otherwise(F.col("list_id"))
    )
    contacts = base.mailing_contact.withColumn(
        "email", F.when(F.col("id") % 5 == 0, F.lit("shared@example.com")).otherwise(F.col("email"))
    )
    src = base.replace(mailing_trace=traces, mailing_contact_subscription=subs, mailing_contact=contacts)
    root = tempfile.mkdtemp(prefix="mailmetrics-skew-")
    src.write_parquet(root)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}/*.parquet')")
    return Sources.from_parquet(spark, root), con


def test_hot_keys_present(skewed):
    src, _ = skewed
    n = src.mailing_trace.count()
    assert src.mailing_trace.where("email = 'shared@example.com'").count() * 3 >= n - 3
    assert src.mailing_trace.where("mass_mailing_id = 100").count() * 3 >= n - 3


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_under_skew(skewed, name):
    src, con = skewed
    df = build_report(name, src, as_of=AS_OF)
    assert compare(df, con, report_sql(name, over_fixtures=False)) == []


def test_hot_address_is_split(skewed):
    """The events of an address are dealt out by ranges that also follow their time, and only partial sums meet by address."""
    from mailmetrics.plans.audience import reengagement

    src, _ = skewed
    text = reengagement(src, as_of=AS_OF, numbered=False)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"rangepartitioning\(email#\d+ ASC NULLS FIRST, at#\d+ DESC NULLS LAST", text)
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(email#\d+, \d+\)", line):
            assert "partial_" in lines[i + 1], lines[i + 1]
