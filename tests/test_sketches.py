"""Sketches of distinct bounced addresses: error bound, merging, months, the list report over them."""

import datetime as dt

import pytest

from mailmetrics.operators.sketches import bounced_estimates, bounced_sketches, merge_sketches, standard_error
from mailmetrics.plans.audience import list_health

from helpers import rows_by, sources, trace, ts


@pytest.fixture(scope="module")
def src(spark):
    n = 6000
    contacts = [{"id": i, "email": f"u{i}@example.com"} for i in range(n)]
    subs = [{"id": i, "contact_id": i, "list_id": 1, "opt_out": False} for i in range(n)]
    subs += [{"id": n + i, "contact_id": i, "list_id": 2, "opt_out": i % 2 == 0} for i in range(40)]
    # every address bounces in two months, a hot one over and over; list 3 has no bounce
    traces = [trace(i, 1, "bounce", sent_datetime=ts(f"2024-0{1 + i // n}-10 10:00:00"), email=f"u{i % n}@example.com") for i in range(2 * n)]
    traces += [trace(10**6 + i, 1, "bounce", email="u7@example.com", sent_datetime=None) for i in range(500)]
    traces += [trace(2 * 10**6, 1, "bounce", email=None), trace(2 * 10**6 + 1, 1, "open", email="u9@example.com")]
    contacts.append({"id": n, "email": "calm@example.com"})
    subs.append({"id": 3 * n, "contact_id": n, "list_id": 3, "opt_out": False})
    return sources(spark, mailing_trace=traces, mailing_contact=contacts, mailing_contact_subscription=subs,
                   mailing_list=[{"id": i, "name": f"list {i}"} for i in (1, 2, 3)])


@pytest.mark.parametrize("lg_k", [10, 14])
def test_estimates_within_their_bound(src, lg_k):
    got = rows_by(bounced_estimates(bounced_sketches(src, lg_k)), "list_id")
    assert set(got) == {1, 2}
    assert abs(got[1].bounced_ever - 6000) <= 4 * standard_error(lg_k) * 6000
    assert got[2].bounced_ever == 40


def test_months_and_merging(src):
    state = bounced_sketches(src)
    january = rows_by(bounced_estimates(state, dt.date(2024, 1, 31), dt.date(2024, 1, 1)), "list_id")
    assert january[2].bounced_ever == 40
    assert rows_by(bounced_estimates(state, dt.date(2024, 3, 1)), "list_id") == {}
    halves = [bounced_sketches(src.replace(mailing_trace=src.mailing_trace.where(f"id % 3 {op} 0"))) for op in ("=", "<>")]
    merged = merge_sketches(*halves, halves[0])  # a batch that is added twice changes nothing
    assert merged.count() == state.count()
    both = [rows_by(bounced_estimates(s), "list_id") for s in (state, merged)]
    for i in both[0]:
        assert both[1][i].bounced_ever == pytest.approx(both[0][i].bounced_ever, rel=2 * standard_error())


def test_list_report_over_estimates(src):
    exact = rows_by(list_health(src), "list_id")
    near = rows_by(list_health(src, bounced=bounced_estimates(bounced_sketches(src))), "list_id")
    assert set(near) == set(exact) == {1, 2, 3}
    assert near[2] == exact[2] and near[3] == exact[3] and exact[3].bounced_ever == 0
    assert abs(near[1].bounced_ever - exact[1].bounced_ever) <= 4 * standard_error() * exact[1].bounced_ever


def test_no_traces(spark):
    empty = sources(spark)
    assert bounced_estimates(merge_sketches(bounced_sketches(empty), bounced_sketches(empty))).count() == 0
