"""Paths of the test tables, and small source tables built by hand for edge-case tests."""

from __future__ import annotations

import datetime as dt
import os

from mailmetrics.sources.schemas import SCHEMAS
from mailmetrics.sources.tables import Sources

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TESTDATA = "/root/testdata"


def sf_dir(sf: str) -> str:
    return os.path.join(TESTDATA, f"sf{sf}")


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def table(spark, name, rows):
    schema = SCHEMAS[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def sources(spark, **tables) -> Sources:
    return Sources.from_frames({n: table(spark, n, tables.get(n, [])) for n in SCHEMAS})


def mailing(id, **kw):
    row = dict(id=id, subject=f"subject {id}", email_from="team@example.com", mailing_type="mail",
               state="done", sent_date=ts("2024-03-04 10:00:00"), expected=100, sent=100,
               opened=10, replied=1, bounced=2, failed=0, opened_ratio=10.0, received_ratio=98.0,
               replied_ratio=1.0, bounced_ratio=2.0, ab_testing_enabled=False)
    row.update(kw)
    return row


def trace(id, mailing_id, status="sent", **kw):
    row = dict(id=id, mass_mailing_id=mailing_id, email=f"u{id}@example.com", trace_status=status,
               sent_datetime=ts("2024-03-04 10:00:00"))
    row.update(kw)
    return row


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}
