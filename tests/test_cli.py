"""The batch entry point writes each requested report."""

import tempfile

import pytest

from mailmetrics.__main__ import main
from mailmetrics.sources.tables import Sources

from helpers import sf_dir


def test_cli_writes_reports(spark):
    root = tempfile.mkdtemp(prefix="mailmetrics-cli-src-")
    Sources.from_driver_tables(spark, sf_dir("0.001")).write_parquet(root)
    out = tempfile.mkdtemp(prefix="mailmetrics-cli-out-")
    written = main(["--sources", root, "--out", out, "--reports", "campaign_stats,reengagement",
                    "--as-of", "2001-08-01 00:00:00"], spark=spark)
    assert len(written) == 2
    stats = spark.read.parquet(written[0])
    assert stats.count() == Sources.from_parquet(spark, root).mailing_mailing.where("mailing_type = 'mail'").count()
    assert spark.read.parquet(written[1]).where("reengagement_status IS NULL").count() == 0


def test_cli_without_ids(spark):
    root = tempfile.mkdtemp(prefix="mailmetrics-cli-src-")
    Sources.from_driver_tables(spark, sf_dir("0.001")).write_parquet(root)
    out = tempfile.mkdtemp(prefix="mailmetrics-cli-out-")
    written = main(["--sources", root, "--out", out, "--reports", "contact_engagement", "--no-ids"], spark=spark)
    assert "id" not in spark.read.parquet(written[0]).columns


def test_cli_creates_views(spark, tmp_path):
    spark.sql(f"CREATE DATABASE cli_views LOCATION '{tmp_path}'")
    try:
        for name, df in Sources.from_driver_tables(spark, sf_dir("0.001")).as_dict().items():
            df.write.saveAsTable(f"cli_views.{name}")
        made = main(["--catalog", "cli_views", "--views", "cli_views", "--reports", "list_health,campaign_stats"], spark=spark)
        assert made == ["cli_views.list_health", "cli_views.campaign_stats"]
        assert spark.newSession().table(made[1]).count() > 0
        for bad in (["--views", "x"], ["--catalog", "c", "--views", "x", "--out", "o"], ["--catalog", "c"]):
            with pytest.raises(SystemExit):
                main(bad, spark=spark)
    finally:
        spark.sql("DROP DATABASE cli_views CASCADE")
