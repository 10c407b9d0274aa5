"""The two ranking operators against brute force (Window over one partition)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailmetrics.operators.ranking import histogram_rank, range_row_number, small_row_number


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        score = rnd.choice([None] + [rnd.randint(-500, 5000) for _ in range(20)])
        data.append((f"e{rnd.randint(0, 10**6):07d}-{i}", score, rnd.choice([None, "a", "b"])))
    return data


@pytest.mark.parametrize("ranges", [None, 1, 2, 8, 5000])
def test_range_row_number_equals_row_number(spark, rows, ranges):
    df = spark.createDataFrame(rows, "email string, score long, tag string").repartition(5)
    order = [F.col("score").desc_nulls_first(), F.col("email").asc_nulls_last()]
    got = range_row_number(df, order, ranges=ranges)
    assert got.columns[0] == "id" and dict(got.dtypes)["id"] == "bigint"
    got = {r["email"]: r["id"] for r in got.collect()}
    want = {r["email"]: r["rn"] for r in
            df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).collect()}
    assert got == want
    assert sorted(got.values()) == list(range(1, len(rows) + 1))


def test_range_row_number_empty(spark):
    df = spark.createDataFrame([], "email string, score long")
    assert range_row_number(df, [F.col("email")]).count() == 0


def test_ranges_are_even_whatever_the_rows_share(spark):
    # one score and one prefix for every row: only the end of the address tells them apart
    df = spark.range(200_000).select(F.concat(F.lit("same-long-prefix"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("email"),
                                     F.lit(1.0).alias("score")).repartition(7)
    numbered = range_row_number(df, [F.col("score").desc(), F.col("email").asc()], ranges=16)
    parts = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 16 and max(parts) <= 4 * sorted(parts)[8]
    wrong = numbered.where(F.concat(F.lit("same-long-prefix"), F.lpad((F.col("id") - 1).cast("string"), 9, "0")) != F.col("email"))
    assert numbered.count() == 200_000 and wrong.isEmpty()


def test_numbers_survive_filters_and_limits_above(spark, rows):
    df = spark.createDataFrame(rows, "email string, score long, tag string").repartition(5)
    numbered = range_row_number(df, [F.col("email").asc()])
    want = {e: i for i, e in enumerate(sorted(r[0] for r in rows), 1)}
    for part in (numbered.where("tag = 'a'"), numbered.select("email", "id"), numbered.orderBy(F.col("id").desc()).limit(9)):
        got = part.collect()
        assert got and all(want[r["email"]] == r["id"] for r in got)
    assert numbered.select("email").count() == numbered.where("id > 0").count() == len(rows)


def test_numbers_are_never_wrong_without_exchange_reuse(spark):
    df = spark.range(50_000).select(F.xxhash64("id").alias("k")).repartition(6)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        with pytest.raises(Exception, match="range_row_number"):
            range_row_number(df, [F.col("k").asc()], ranges=16).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_histogram_rank_equals_rank(spark, rows):
    df = spark.createDataFrame(rows, "email string, score long, tag string").repartition(4)
    got = {r["email"]: r["rank"] for r in histogram_rank(df, "score").collect()}
    want = {r["email"]: r["rk"] for r in df.withColumn(
        "rk", F.rank().over(Window.orderBy(F.col("score").desc_nulls_first()))).collect()}
    assert got == want


def test_small_row_number_is_bigint(spark):
    df = small_row_number(spark.range(3), [F.col("id").desc()], "n")
    assert dict(df.dtypes)["n"] == "bigint"
    assert [r["n"] for r in df.orderBy("n").collect()] == [1, 2, 3]
