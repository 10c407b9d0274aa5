"""Layer 1: every registered query against its DuckDB SQL on the driver tables.

Reports run through ``queries()`` at sf0.01 (the correctness gate's scale).
Slices run their registered shape over each report built once per session
at sf0.001 (and cached), against the same oracle SQL.
"""

import re

import pytest

import __spark_entry__ as entry
from mailmetrics.oracle.compare import compare
from mailmetrics.oracle.fixtures_sql import TABLES, fixture_query
from mailmetrics.plans.catalog import REPORTS, build_report
from mailmetrics.sources.fixtures import derive_sources
from mailmetrics.sources.tables import Sources

from helpers import sf_dir

QUERIES = entry.queries()
SQL = entry.oracle_sql()
SPECS = entry.slice_specs()


@pytest.fixture(scope="module")
def small_reports(spark):
    src = Sources.from_driver_tables(spark, sf_dir("0.001"))
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = build_report(name, src, as_of=entry.FIXTURE_AS_OF, numbered=False).cache()
        return cache[name]

    yield get
    for df in cache.values():
        df.unpersist()


def test_every_query_has_an_oracle():
    """Every report and slice; training-data operators have SQL where SQL can express them."""
    corpus = {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}
    assert set(QUERIES) - corpus == set(SQL) - corpus == set(SPECS) | set(REPORTS)
    assert len(REPORTS) == 15 and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("table", TABLES)
def test_fixture_tables_equal(spark, duck_small, table):
    df = derive_sources(spark, sf_dir("0.001"))[table]
    assert compare(df, duck_small, fixture_query(table)) == []


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_matches_oracle(spark, duck_mid, name):
    df = QUERIES[name](spark, sf_dir("0.01"))
    assert compare(df, duck_mid, SQL[name]) == []


@pytest.mark.parametrize("key", sorted(SPECS))
def test_slice_matches_oracle(small_reports, duck_small, key):
    report, shape, sql = SPECS[key]
    assert compare(shape(small_reports(report)), duck_small, sql) == []


@pytest.mark.parametrize("key", ["campaign_stats__pivot", "reengagement__is_lost", "list_health__chart"])
def test_registered_slice_callable(spark, duck_small, key):
    df = QUERIES[key](spark, sf_dir("0.001"))
    assert compare(df, duck_small, SQL[key]) == []


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["id", "mailing_id"]
