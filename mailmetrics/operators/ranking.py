"""Global numbering and ranking without funnelling rows through one task.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into a single
partition.  That is fine for results bounded by a small domain (months, hours,
trigger types) and is what ``small_row_number`` does.  Reports with one row
per e-mail address or per day-and-campaign grow with the data, so they get:

* ``range_row_number``: deal rows out by ranges of the order, sort inside the
  ranges, and add what earlier ranges hold to a row's place in its own.  Lazy.
* ``histogram_rank``: SQL ``RANK()`` on a column with few distinct values
  (a 2-decimal score): count rows per value, running sum over that small
  table, join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small_row_number(df: DataFrame, order: Sequence[Column], name: str = "id") -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` for results of bounded size."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def range_row_number(df: DataFrame, order: Sequence[Column], name: str = "id", ranges: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` without sorting all rows in one task.

    One range exchange: Spark samples the order's values and cuts them into
    ``ranges`` (default: the shuffle partitions) of about equal size, whatever
    prefix or leading column the values share.  Rows are sorted inside their
    range; a row's number is its place there plus the rows of earlier ranges.
    Only rows equal in the whole order can't be parted.  The counts of the
    ranges (one row each, broadcast) come from the same exchange: both sides
    ask it for all columns, so Spark runs it, and what stands below, once.
    Were it run twice (``spark.sql.exchange.reuse`` off), the samples could
    cut differently: then some range holds a row more than was counted, and
    the query fails instead of giving that row a wrong number.
    The new bigint column starts at 1 and comes first.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count a partition's rows
    rows = dealt.sortWithinPartitions(*order).select(F.spark_partition_id().alias("_range"), place.alias("_place"), *df.columns)
    whole = F.xxhash64(*df.columns)
    counts = dealt.groupBy(F.spark_partition_id().alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.max(whole).alias("_most"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_r", "_n", "_most", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    j = rows.join(F.broadcast(offsets), F.col("_range") == F.col("_r"), "left")
    counted = (F.col("_place") < F.col("_n")) & (whole <= F.col("_most"))
    number = F.when(counted, F.col("_offset") + F.col("_place") + 1).otherwise(
        F.raise_error(F.lit("range_row_number: rows and counts were dealt out differently; it needs spark.sql.exchange.reuse")))
    return j.select(number.cast("bigint").alias(name), *df.columns)


def histogram_rank(df: DataFrame, value: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """SQL ``RANK() OVER (ORDER BY value [DESC])`` as an int column.

    The rank of a row is 1 + the number of rows strictly before its value.
    Work outside the small per-value table is one aggregate and one join.
    """
    hist = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    key = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_last()
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.select(
        F.col(value).alias("_rank_value"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int").alias(name),
    )
    return df.join(ranks, df[value].eqNullSafe(ranks["_rank_value"]), "inner").drop("_rank_value")
