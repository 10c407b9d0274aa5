"""One row repeated many times: the same results as a few copies, and nothing that grows with the copies meets in one place."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from mailmetrics.llm import near_duplicates, phrases, suffix_index
from mailmetrics.llm.common import Scratch, distinct_texts, keyed

COPIES = 20_000


def texts():
    r = random.Random(4)
    words = [f"w{r.randrange(400)}" for _ in range(300)]
    variant = words[:120] + ["other"] + words[121:]
    return " ".join(words), " ".join(variant)


@pytest.fixture(scope="module")
def tables(spark):
    hot, variant = texts()
    rest = [(1, variant), (9, hot + " tail"), (None, hot), (None, hot), (5, None), (5, None), (6, "")]

    def table(n):
        rows = spark.createDataFrame(rest, "doc_id long, text string")
        return rows.unionByName(spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(hot).alias("text"))).repartition(6)

    return table(COPIES), [*rest, *[(7, hot)] * 3]


def counted(rows):
    found = Counter(tuple(r) for r in rows)
    return {k: min(n, 3) for k, n in found.items()}, max(found.values())


def test_passages(spark, tables):
    df, few = tables
    got, most = counted(phrases.remove_repeated_passages(df).collect())
    assert got == counted(brute.passages(few, 50))[0] and most == COPIES
    runs = phrases.recurring_runs(keyed(df)).select(F.size("runs")).collect()
    assert max(r[0] for r in runs) < 1000


def test_bytes(spark, tables):
    df, few = tables
    got, most = counted(suffix_index.remove_repeats(df).collect())
    assert got == counted(brute.repeats(few, 200))[0] and most == COPIES
    runs = suffix_index.repeated_runs(keyed(df)).select(F.size("runs")).collect()
    assert max(r[0] for r in runs) < 5000


def test_one_stays(spark, tables):
    df, _ = tables
    hot, variant = texts()
    kept = Counter((r.doc_id, r.text) for r in near_duplicates.keep_one(df).collect())
    assert kept[(5, None)] == 2 and kept[(6, "")] == 1  # rows that take no part stay
    assert sum(n for (_, t), n in kept.items() if t) == 1


def test_distinct_texts(spark, tables):
    df, few = tables
    for times in (1, 2):
        got = Counter((r.doc_id, r.text) for r in distinct_texts(keyed(df), Scratch(spark, "test"), times).collect())
        assert got == {k: min(n, times) for k, n in Counter(few).items()}
    none = spark.createDataFrame(few[:1], "doc_id long, text string")
    assert distinct_texts(keyed(none), Scratch(spark, "test")).count() == 1
