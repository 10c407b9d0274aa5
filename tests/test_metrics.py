"""The exact-rounding column functions against Python decimal arithmetic."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from mailmetrics.functions.metrics import mean2, pct, pct_exact, pct_exact_sql, ratio2, ratio_exact_sql, round_div


def half_up(x: Decimal, places: str = "1") -> Decimal:
    return x.quantize(Decimal(places), rounding=ROUND_HALF_UP)


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(11)
    rows = [(rnd.randint(-10**6, 10**6), rnd.choice([0, None] + [rnd.randint(1, 10**5) for _ in range(8)]))
            for _ in range(2000)]
    rows += [(5, 10), (-5, 10), (15, 10), (-15, 10), (1, 3), (2, 3), (23, 160)]
    return rows


def test_round_div_and_pct(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", round_div("n", "d").alias("q"), pct(F.col("n"), F.col("d")).alias("p"),
                    pct_exact("n", "d").alias("m")).collect()
    for r in got:
        if not r["d"]:
            assert r["q"] is None and r["p"] is None and r["m"] is None
            continue
        exact = Decimal(r["n"]) / Decimal(r["d"])
        assert r["q"] == int(half_up(exact))
        assert r["p"] == float(half_up(exact * 100, "0.01"))
        assert abs(r["m"] - exact * 100) <= Decimal("1e-13")


def decimal(v) -> Decimal:
    return Decimal(repr(v if v is not None else 0.0))


def test_ratio_is_rounded_once(spark):
    rnd = random.Random(3)
    vals = [None, 0.0, 1.005, 2.675, 14.375, 99.999, 33.333333333, 12.3449999, 100.0 / 20001, 0.0049999999, 12.34499999999]
    vals += [100.0 * rnd.randint(0, n) / n for n in (rnd.randint(1, 10**7) for _ in range(3000))]
    df = spark.createDataFrame([(v,) for v in vals], "r double")
    for v, row in zip(vals, df.select(ratio2("r").alias("a"), ratio2(F.col("r")).alias("b")).collect()):
        assert row["a"] == row["b"] == float(half_up(decimal(v), "0.01"))
    assert df.where("r is not null").select(ratio2("r")).collect()[7][0] == 0.0  # 1 of 20,001 is not 0.01


def test_mean2_is_exact_and_null_skipping(spark):
    rnd = random.Random(5)
    groups = {g: [rnd.choice([None, *[100.0 * rnd.randint(0, n) / n for n in (rnd.randint(1, 10**7),) * 5]])
                  for _ in range(rnd.randint(1, 40))] for g in range(80)}
    groups[100] = [0.005, 0.005]      # a tie goes away from zero
    groups[101] = [0.0049999, 0.0050001 - 2e-13]
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {r["g"]: r for r in df.groupBy("g").agg(
        mean2(f"CASE WHEN v IS NOT NULL THEN {ratio_exact_sql('v')} END").alias("skip"),
        mean2(ratio_exact_sql("v")).alias("zero")).collect()}
    for g, vs in groups.items():
        present = [half_up(decimal(v), "0.0000000000001") for v in vs if v is not None]
        assert got[g]["skip"] == (float(half_up(sum(present, Decimal(0)) / len(present), "0.01")) if present else None)
        assert got[g]["zero"] == float(half_up(sum(present, Decimal(0)) / len(vs), "0.01"))


def test_mean_of_quotients(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.randint(0, 10**7), rnd.choice([0, None] + [rnd.randint(1, 10**7) for _ in range(5)])) for g in range(40) for _ in range(30)]
    df = spark.createDataFrame(rows, "g int, n long, d long").repartition(5)
    for r in df.groupBy("g").agg(mean2(pct_exact_sql("n", "d")).alias("m")).collect():
        q = [Decimal(100 * n) / Decimal(d) for g, n, d in rows if g == r["g"] and d]
        assert abs(Decimal(repr(r["m"])) - half_up(sum(q) / len(q), "0.01")) == 0
