"""Report registration (named temp views), safely repeatable."""

from mailmetrics import register_reports
from mailmetrics.plans.catalog import REPORTS
from mailmetrics.sources.tables import Sources

from helpers import sf_dir


def test_register_reports_twice_and_query_with_sql(spark):
    src = Sources.from_driver_tables(spark, sf_dir("0.001"))
    names = ["campaign_stats", "list_health", "failure_breakdown"]
    for _ in range(2):
        register_reports(spark, src, prefix="mm_", as_of="2001-08-01 00:00:00", names=names)
    n = spark.sql("SELECT count(*) FROM mm_campaign_stats WHERE state = 'done'").first()[0]
    assert n == src.mailing_mailing.where("mailing_type = 'mail' AND state = 'done'").count()
    assert spark.sql("SELECT sum(failure_count) FROM mm_failure_breakdown").first()[0] > 0


def test_all_reports_registered(spark):
    src = Sources.from_driver_tables(spark, sf_dir("0.001"))
    views = register_reports(spark, src, prefix="all_", as_of="2001-08-01 00:00:00")
    assert set(views) == set(REPORTS)
    listed = {t.name for t in spark.catalog.listTables() if t.name.startswith("all_")}
    assert listed == {"all_" + n for n in REPORTS}


def test_views_follow_the_tables(spark, tmp_path):
    root = str(tmp_path / "src")
    Sources.from_driver_tables(spark, sf_dir("0.001")).write_parquet(root)
    register_reports(spark, Sources.from_parquet(spark, root), prefix="live_", as_of="2001-08-01 00:00:00")
    counts = {n: "sum(total_received)" if n == "contact_engagement" else "count(*)" for n in REPORTS}
    before = {n: spark.sql(f"SELECT {c} FROM live_{n}").first()[0] for n, c in counts.items()}
    more = spark.read.parquet(root + "/mailing_trace").where("email <> '' AND mass_mailing_id < 999999").limit(500)
    more = more.selectExpr("id + 10000000 AS id", "mass_mailing_id", "concat('new', id, '@x') AS email", "'bounce' AS trace_status",
                           "'mail_new' AS failure_type", "sent_datetime", "cast(null as timestamp_ntz) AS open_datetime",
                           "cast(null as timestamp_ntz) AS links_click_datetime", "cast(null as timestamp_ntz) AS reply_datetime")
    more.write.mode("append").parquet(root + "/mailing_trace")
    for n in REPORTS:  # Spark lists a folder's files once, until told to look again
        spark.catalog.refreshTable(f"live_{n}")
    after = {n: spark.sql(f"SELECT {c} FROM live_{n}").first()[0] for n, c in counts.items()}
    for n in ("delivery_details", "contact_engagement", "failure_breakdown", "reengagement"):
        assert after[n] > before[n], n
    assert spark.sql("SELECT count(*) = max(id) FROM live_reengagement").first()[0]
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_default_clock_is_read_with_the_query(spark):
    src = Sources.from_driver_tables(spark, sf_dir("0.001"))
    register_reports(spark, src, prefix="now_", names=["reengagement"])
    text = spark.table("now_reengagement")._jdf.queryExecution().analyzed().toString()
    assert "current_timestamp" in text
