"""Trigram index: the same rows as a search over all files, from fewer files."""

import pytest

from mailmetrics.plans.audience import contact_engagement, reengagement
from mailmetrics.plans.mailing import delivery_details
from mailmetrics.plans.slices import search_view
from mailmetrics.sources.search_index import build_index, candidate_files, searched
from mailmetrics.sources.tables import Sources

from helpers import mailing, sources, table, trace

AS_OF = "2024-08-01 00:00:00"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("searched"))
    hosts = ["alpha.example", "BETA.example", "gamma.test", "\u00c4rger.test"]
    traces = [trace(i, 1 + i % 2, "open" if i % 3 else "click", email=f"user{i % 17}@{hosts[i % 4]}") for i in range(400)]
    traces += [trace(900, 1, email=None), trace(901, 1, email=""), trace(902, 1, email="ab")]
    src = sources(spark, mailing_mailing=[mailing(1), mailing(2)], mailing_trace=traces)
    src.write_parquet(root)
    path = f"{root}/mailing_trace"
    # one file per host, one for the rest
    src.mailing_trace.repartition(1).createOrReplaceTempView("_all_traces")
    for n, h in enumerate(["alpha", "BETA", "gamma", "rger", None]):
        cond = f"email LIKE '%{h}%'" if h else "email IS NULL OR NOT email RLIKE 'alpha|BETA|gamma|rger'"
        spark.sql(f"SELECT * FROM _all_traces WHERE {cond}").coalesce(1).write.mode("overwrite" if n == 0 else "append").parquet(path)
    build_index(spark, path, ["email", "trace_status"], f"{root}/index")
    return Sources.from_parquet(spark, root), path, f"{root}/index"


@pytest.mark.parametrize("term,files", [("alpha", 1), ("Beta.ex", 1), (".test", 2), ("\u00e4RGER", 1), ("user1", 4), ("nowhere", 0), ("ab", 5), ("", 5), ("user3@gamma", 1)])
def test_same_rows_from_fewer_files(spark, stored, term, files):
    src, path, index = stored
    assert len(candidate_files(spark, path, index, "email", term)) == files
    few = searched(src, "mailing_trace", path, index, "email", term)
    assert len(few.mailing_trace.inputFiles()) == files
    for name, report in (("delivery_details", delivery_details), ("contact_engagement", lambda s: contact_engagement(s, numbered=False)),
                         ("reengagement", lambda s: reengagement(s, AS_OF, numbered=False))):
        whole, pruned = (sorted(map(str, search_view(report(s), name, "email", term).collect())) for s in (src, few))
        assert whole == pruned
        assert whole or term == "nowhere" or name == "reengagement"


def test_other_fields_and_later_files(spark, stored):
    src, path, index = stored
    assert len(candidate_files(spark, path, index, "trace_status", "click")) == 4
    with pytest.raises(KeyError):
        candidate_files(spark, path, index, "subject", "click")
    table(spark, "mailing_trace", [trace(5000, 1, email="late@delta.example")]).coalesce(1).write.mode("append").parquet(path)
    later = searched(src, "mailing_trace", path, index, "email", "DELTA")
    assert [r.id for r in search_view(delivery_details(later), "delivery_details", "email", "DELTA").collect()] == [5000]
