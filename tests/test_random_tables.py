"""Differential test on random source tables (nulls, empty strings, shared
addresses, orphan keys, ties): every report against the SQL oracle run by
DuckDB over the same staged Parquet."""

import datetime as dt
import random
import tempfile

import duckdb
import pytest

from mailmetrics.oracle.compare import compare
from mailmetrics.oracle.reports_sql import report_sql
from mailmetrics.plans.catalog import REPORTS, build_report
from mailmetrics.sources.schemas import SCHEMAS, TRACE_STATUSES

from helpers import sources

AS_OF = "2001-08-01 00:00:00"
T0 = dt.datetime(2001, 1, 1)


def _maybe(rnd, value, p=0.15):
    return None if rnd.random() < p else value


def _ts(rnd, p=0.15):
    return _maybe(rnd, T0 + dt.timedelta(hours=rnd.randint(0, 24 * 200)), p)


def random_tables(seed: int) -> dict:
    rnd = random.Random(seed)
    mailings = []
    for i in range(40):
        ratios = {k: _maybe(rnd, round(rnd.uniform(0, 100), rnd.choice([0, 1, 3, 6])), 0.2)
                  for k in ("opened_ratio", "received_ratio", "replied_ratio", "bounced_ratio")}
        mailings.append(dict(
            id=i, subject=_maybe(rnd, "s" * rnd.randint(0, 5)), email_from="f@x",
            mailing_type=rnd.choice(["mail", "mail", "sms"]),
            state=rnd.choice(["draft", "in_queue", "sending", "done", "done"]),
            sent_date=_ts(rnd), schedule_date=_ts(rnd),
            expected=_maybe(rnd, rnd.randint(0, 50)), sent=_maybe(rnd, rnd.choice([0, rnd.randint(1, 40)])),
            opened=_maybe(rnd, rnd.randint(0, 30)), replied=_maybe(rnd, rnd.randint(0, 5)),
            bounced=_maybe(rnd, rnd.randint(0, 50)), failed=_maybe(rnd, rnd.randint(0, 5)),
            ab_testing_enabled=rnd.choice([True, False, None]), ab_testing_pc=_maybe(rnd, rnd.randint(0, 50)),
            ab_testing_winner_selection=rnd.choice(["manual", "clicks", "open", "reply"]),
            ab_testing_completed=rnd.choice([True, False, None]),
            ab_testing_is_winner_mailing=rnd.choice([True, False, None]), **ratios))
    # a done e-mail mailing that no trace belongs to
    mailings.append(dict(id=40, subject="no traces", mailing_type="mail", state="done", sent=10, sent_date=T0))
    emails = [None, ""] + [f"a{i}@x" for i in range(25)] + ["A1@x"]
    traces = []
    for i in range(600):
        status = rnd.choice(TRACE_STATUSES)
        sent = _ts(rnd, 0.2)
        opened = _maybe(rnd, (sent or T0) + dt.timedelta(hours=rnd.randint(0, 48)), 0.5)
        traces.append(dict(
            id=i, mass_mailing_id=rnd.choice([None, 999] + list(range(40))),
            email=rnd.choice(emails), trace_status=status,
            failure_type=rnd.choice([None, "", "mail_bounce", "unknown", "sms_credit"]),
            sent_datetime=sent, open_datetime=opened,
            links_click_datetime=_ts(rnd, 0.7), reply_datetime=_ts(rnd, 0.7)))
    campaigns = [dict(id=i, name=f"c{i}", state=rnd.choice(["draft", "running", "stopped"]),
                      create_date=_ts(rnd, 0), last_sync_date=_ts(rnd)) for i in range(6)]
    participants = [dict(campaign_id=rnd.choice([None, 7] + list(range(6))),
                         state=rnd.choice(["running", "completed", "removed"]),
                         is_test=rnd.choice([True, False, None]), create_date=_ts(rnd, 0)) for _ in range(300)]
    activities = [dict(id=i, campaign_id=rnd.choice([None] + list(range(6))), name=f"a{i}",
                       activity_type=rnd.choice(["email", "email", "action"]),
                       trigger_type=rnd.choice([None, "begin", "mail_open", "mail_click"]),
                       interval_number=rnd.randint(0, 9), interval_type="days",
                       mass_mailing_id=rnd.choice([None, 555] + list(range(40))),
                       total_click=_maybe(rnd, rnd.randint(0, 9)), total_bounce=_maybe(rnd, rnd.randint(0, 9)),
                       processed=_maybe(rnd, rnd.randint(0, 9)), rejected=_maybe(rnd, rnd.randint(0, 9)))
                  for i in range(60)]
    lists = [dict(id=i, name=f"L{i}") for i in range(5)]
    contacts = [dict(id=i, email=rnd.choice(emails[2:])) for i in range(40)]
    subs = [dict(id=i, contact_id=rnd.randint(0, 45), list_id=rnd.choice([0, 1, 2, 3, 9]),
                 opt_out=rnd.choice([True, False, None])) for i in range(120)]
    # a list whose opt_out is unknown for every contact
    subs += [dict(id=120 + i, contact_id=i, list_id=4, opt_out=None) for i in range(3)]
    return dict(mailing_mailing=mailings, mailing_trace=traces, marketing_campaign=campaigns,
                marketing_participant=participants, marketing_activity=activities, mailing_list=lists,
                mailing_contact=contacts, mailing_contact_subscription=subs)


@pytest.fixture(scope="module", params=[1, 2, 3])
def staged(request, spark):
    src = sources(spark, **random_tables(request.param))
    root = tempfile.mkdtemp(prefix="mailmetrics-rand-")
    src.write_parquet(root)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}/*.parquet')")
    from mailmetrics.sources.tables import Sources

    return Sources.from_parquet(spark, root), con


@pytest.mark.parametrize("name", list(REPORTS))
def test_random_tables_match_oracle(staged, name):
    src, con = staged
    df = build_report(name, src, as_of=AS_OF)
    assert compare(df, con, report_sql(name, over_fixtures=False)) == []
