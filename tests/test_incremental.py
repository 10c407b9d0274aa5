"""Rollups moved on by changed rows equal a full recomputation."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mailmetrics.operators.incremental import PARTICIPANTS, TRACES, IncrementalRollup
from mailmetrics.operators.rollups import participant_rollup, trace_rollup
from mailmetrics.plans import automation, mailing

from helpers import mailing as mailing_row
from helpers import sources

STATUS = ["sent", "open", "click", "cancel", None]
T = "id long, mass_mailing_id long, trace_status string"
P = "id long, campaign_id long, state string, is_test boolean"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def trace_rows(r, ids):
    # half of all rows in one mailing
    return {i: (i, r.choice([1, 1, 1, None, 2, 3]), r.choice(STATUS)) for i in ids}


def part_rows(r, ids):
    return {i: (i, r.choice([7, 7, None, 8]), r.choice(["running", "completed", None]), r.choice([True, False, None])) for i in ids}


@pytest.mark.parametrize("spec,schema,make,full", [(TRACES, T, trace_rows, trace_rollup), (PARTICIPANTS, P, part_rows, participant_rollup)])
def test_equals_recomputation_after_random_updates(spark, tmp_path, spec, schema, make, full):
    r = random.Random(3)
    now = make(r, range(200))
    state = IncrementalRollup(spark, str(tmp_path / "s"), spec)
    state.build(spark.createDataFrame(list(now.values()), schema))
    was = []
    for batch in (60, 3, 40, 1, 120):
        ids = r.sample(range(300), batch)  # new ones too
        gone = [i for i in ids if i in now and r.random() < 0.2]
        changed = make(r, [i for i in ids if i not in gone])
        sent = [(*now[i], True) for i in gone] + [(*x, r.choice([False, None])) for x in changed.values()]
        state.apply(spark.createDataFrame(sent, schema + ", _deleted boolean"))
        now = {i: x for i, x in {**now, **changed}.items() if i not in gone}
        want = rows(full(spark.createDataFrame(list(now.values()), schema)))
        assert rows(state.read()) == want
        was.append(want)
    assert [rows(state.read(g)) for g in range(1, 6)] == was
    state.apply(spark.createDataFrame(sent, schema + ", _deleted boolean"))  # the same batch again
    assert rows(state.read()) == was[-1]
    expired = state.expire()
    assert expired and rows(state.read()) == was[-1]
    state.apply(spark.createDataFrame([], schema))
    assert rows(state.read()) == was[-1]


def test_runs_merge_geometrically(spark, tmp_path):
    state = IncrementalRollup(spark, str(tmp_path / "s"), TRACES)
    state.build(spark.range(1000).select("id", F.lit(1).alias("mass_mailing_id"), F.lit("click").alias("trace_status")))
    for i in range(6):
        state.apply(spark.createDataFrame([(i, 1, "sent")], T))
    runs, at = [], state.generations()[-1]
    while at >= 0:
        first, run = state._run(at)
        runs.append(run.count())
        at = first - 1
    assert sum(runs) == 1006 and len(runs) <= 4
    assert rows(state.read()) == [(1, 994, 0)]


def test_versions_and_refusals(spark, tmp_path):
    state = IncrementalRollup(spark, str(tmp_path / "s"), TRACES)
    with pytest.raises(ValueError, match="build it first"):
        state.apply(spark.createDataFrame([], T))
    state.build(spark.createDataFrame([(1, 5, "open")], T))
    assert rows(state.read()) == []
    twice = spark.createDataFrame([(1, 5, "click", 2), (1, 5, "cancel", 9), (1, 6, "click", 4)], T + ", seq int")
    with pytest.raises(ValueError, match="more than once"):
        state.apply(twice)
    assert state.generations() == [0]  # the batch that failed left no generation
    assert state.apply(twice, version="seq") == 1
    assert rows(state.read()) == [(5, 0, 1)]
    with pytest.raises(PySparkException, match="no id"):
        state.apply(spark.createDataFrame([(None, 5, "click")], T))
    with pytest.raises(ValueError, match="already"):
        state.build(spark.createDataFrame([], T))


def test_unfinished_generation_is_not_there(spark, tmp_path):
    state = IncrementalRollup(spark, str(tmp_path / "s"), TRACES)
    state.build(spark.createDataFrame([(1, 5, "click")], T))
    spark.range(3).write.parquet(f"{tmp_path}/s/gen-00000001/rows-from-00000001")  # a job that died before the counts
    assert rows(state.read()) == [(5, 1, 0)]
    state.apply(spark.createDataFrame([(1, 5, "cancel")], T))
    assert rows(state.read()) == [(5, 0, 1)]


def test_reports_read_the_state(spark, tmp_path):
    traces = [dict(id=i, mass_mailing_id=1 + i % 3, email=f"u{i}", trace_status=STATUS[i % 4]) for i in range(30)]
    people = [dict(id=i, campaign_id=1 + i % 2, state="running", is_test=i % 3 == 0) for i in range(9)]
    src = sources(spark, mailing_mailing=[mailing_row(1), mailing_row(2), mailing_row(3)], mailing_trace=traces,
                  marketing_participant=people, marketing_campaign=[dict(id=1, name="a", state="running"), dict(id=2, name="b", state="draft")])
    clicks = IncrementalRollup(spark, str(tmp_path / "t"), TRACES)
    clicks.build(src.mailing_trace)
    assert rows(mailing.campaign_stats(src, rollup=clicks.read())) == rows(mailing.campaign_stats(src))
    parts = IncrementalRollup(spark, str(tmp_path / "p"), PARTICIPANTS)
    parts.build(spark.createDataFrame([(p["id"], p["campaign_id"], p["state"], p["is_test"]) for p in people], P))
    assert rows(automation.automation_overview(src, rollup=parts.read())) == rows(automation.automation_overview(src))


def test_a_batch_reads_its_range_of_ids(spark, tmp_path):
    state = IncrementalRollup(spark, str(tmp_path / "s"), TRACES)
    state.build(spark.range(1000).select("id", F.lit(1).alias("mass_mailing_id"), F.lit("click").alias("trace_status")))
    text = state._run(0)[1].where(F.col("id").between(5, 9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,5)" in text and "LessThanOrEqual(id,9)" in text
