"""Persistent views: their SQL gives the reports' rows, in every session."""

import random

import pytest
from pyspark.sql import functions as F

from mailmetrics.plans import views
from mailmetrics.plans.catalog import REPORTS, build_report
from mailmetrics.sources.tables import Sources

from helpers import sf_dir, sources
from test_random_tables import random_tables

AS_OF = "2001-08-01 00:00:00"


def fill(spark, database, location, src):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, df in src.as_dict().items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


@pytest.fixture(scope="module", params=["fixture", "random"])
def catalog(request, spark, tmp_path_factory):
    name = f"mkt_{request.param}"
    src = Sources.from_driver_tables(spark, sf_dir("0.001")) if request.param == "fixture" else sources(spark, **random_tables(11))
    fill(spark, name, tmp_path_factory.mktemp(name), src)
    for _ in range(2):  # repeatable
        views.create_views(spark, name, name, prefix="v_", ranges=5, as_of=AS_OF)
    yield name, Sources.from_catalog(spark, name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_every_report_has_a_view():
    assert set(views.VIEWS) == set(REPORTS)


@pytest.mark.parametrize("name", list(REPORTS))
def test_view_equals_report_in_another_session(spark, catalog, name):
    database, src = catalog
    view, report = spark.newSession().table(f"{database}.v_{name}"), build_report(name, src, as_of=AS_OF)
    assert view.dtypes == report.dtypes
    assert sorted(map(str, view.collect())) == sorted(map(str, report.collect()))


def test_views_follow_the_tables_and_the_clock(spark, catalog):
    database, _ = catalog
    views.create_views(spark, database, database, prefix="now_", ranges=3, names=["reengagement", "contact_engagement"])
    other = spark.newSession()
    before = other.table(f"{database}.now_contact_engagement").count()
    mailing = other.table(f"{database}.mailing_mailing").where("mailing_type = 'mail'").first()["id"]
    r = random.Random(1)
    more = spark.createDataFrame([(10**9 + i, mailing, f"new{r.random()}@x", "sent") for i in range(50)], "id long, mass_mailing_id long, email string, trace_status string")
    nothing = spark.table(f"{database}.mailing_trace").schema
    more.select(*[F.col(f.name) if f.name in more.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in nothing]).write.insertInto(f"{database}.mailing_trace")
    after = spark.newSession().table(f"{database}.now_contact_engagement")  # a session lists a table's files once
    assert after.count() == before + 50 and after.agg(F.max("id")).first()[0] == before + 50
    text = other.table(f"{database}.now_reengagement")._jdf.queryExecution().analyzed().toString()
    assert "current_timestamp" in text


def test_clock_as_datetime():
    import datetime as dt

    sql = views.view_sql("reengagement", "d", as_of=dt.datetime(2024, 6, 1, 12, tzinfo=dt.timezone(dt.timedelta(hours=2))))
    assert "TIMESTAMP_NTZ '2024-06-01 10:00:00.000000'" in sql and "current_timestamp" not in sql
