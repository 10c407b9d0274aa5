"""Binding sources: explicit schemas, missing columns, staged Parquet round trip."""

import tempfile

import pytest

from mailmetrics.plans import audience
from mailmetrics.sources.schemas import SCHEMAS
from mailmetrics.sources.tables import Sources, conform

from helpers import sf_dir
from helpers import sources, trace


def test_conform_rejects_missing_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    with pytest.raises(ValueError, match="missing columns"):
        conform(df, "marketing_campaign")


def test_conform_casts_to_declared_types(spark):
    df = spark.createDataFrame([(1, "a@x")], "id int, email string")
    out = conform(df, "mailing_contact")
    assert out.schema == SCHEMAS["mailing_contact"]


def test_parquet_round_trip(spark):
    src = Sources.from_driver_tables(spark, sf_dir("0.001"))
    root = tempfile.mkdtemp(prefix="mailmetrics-src-")
    src.write_parquet(root, files={"mailing_trace": 3})
    back = Sources.from_parquet(spark, root)
    for name, df in src.as_dict().items():
        got = getattr(back, name)
        assert got.schema == SCHEMAS[name]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


def test_reengagement_default_clock(spark):
    src = sources(spark, mailing_trace=[trace(1, 1, "sent", email="x@y")])
    rows = audience.reengagement(src).collect()
    assert len(rows) == 1 and rows[0]["reengagement_status"] == "Lost"


def test_parquet_with_a_missing_column_raises(spark, tmp_path):
    root = str(tmp_path / "src")
    Sources.from_driver_tables(spark, sf_dir("0.001")).write_parquet(root)
    spark.read.parquet(root + "/mailing_mailing").drop("opened_ratio").write.parquet(str(tmp_path / "m"))
    spark.read.parquet(str(tmp_path / "m")).write.mode("overwrite").parquet(root + "/mailing_mailing")
    with pytest.raises(ValueError, match="missing columns.*opened_ratio"):
        Sources.from_parquet(spark, root)


@pytest.mark.parametrize("kind", ["int", "long"])
def test_list_ids_of_either_width(spark, tmp_path, kind):
    root = str(tmp_path / "src")
    Sources.from_driver_tables(spark, sf_dir("0.001")).write_parquet(root)
    big = 0 if kind == "int" else 2**40
    spark.range(3).selectExpr(f"cast(id + {big} as {kind}) as id", "'l' as name").write.mode("overwrite").parquet(root + "/mailing_list")
    spark.range(6).selectExpr("id", "id as contact_id", f"cast(id % 3 + {big} as {kind}) as list_id", "false as opt_out").write.mode(
        "overwrite").parquet(root + "/mailing_contact_subscription")
    rows = audience.list_health(Sources.from_parquet(spark, root)).collect()
    assert sorted(r["list_id"] for r in rows) == [big, big + 1, big + 2]


def test_reports_over_staged_parquet_equal_the_derived_tables(spark, tmp_path):
    from mailmetrics.plans.catalog import REPORTS, build_report

    root = str(tmp_path / "src")
    src = Sources.from_driver_tables(spark, sf_dir("0.001"))
    src.write_parquet(root)
    back = Sources.from_parquet(spark, root)
    for name in REPORTS:
        a, b = (build_report(name, s, as_of="2001-08-01 00:00:00") for s in (src, back))
        assert a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
