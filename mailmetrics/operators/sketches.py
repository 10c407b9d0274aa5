"""Distinct bounced addresses as mergeable sketches: an opt-in beside the exact count.

The exact ``bounced_ever`` of the list report shuffles every (address, list)
pair of all time on each read.  Here a state of one HyperLogLog sketch per list
and month answers instead: batches of traces are added to it, months are merged
at will, and a trace that is added twice changes nothing.

    state = bounced_sketches(src)                                    # first, or whole
    state = merge_sketches(state, bounced_sketches(src_of_a_batch))  # then per batch
    list_health(src, bounced=bounced_estimates(state))

A sketch has 2^lg_k registers (some 8 KB at 14); the relative standard error of
a merged estimate is ``standard_error(lg_k)`` (0.8 % at 14), small counts are
nearly exact.  A batch counts for the lists that its addresses are subscribed to
when it is added; who subscribes or leaves later isn't moved.  Store the
state as any table.  Null addresses take no part; a null send time is a month
of its own, which only estimates without bounds of months hold.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.audience import bounced_subscribers
from ..sources.layout import month_of
from ..sources.tables import Sources

LG_K = 14


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate from merged sketches."""
    return 1.04 / 2 ** (lg_k / 2)


def bounced_sketches(src: Sources, lg_k: int = LG_K) -> DataFrame:
    """(list_id, month, sketch): distinct bounced addresses per list and month of sending."""
    hit = bounced_subscribers(src, month_of("sent_datetime").alias("month"))
    return hit.groupBy(F.col("_blid").alias("list_id"), "month").agg(F.hll_sketch_agg("_email", lg_k).alias("sketch"))


def merge_sketches(*states: DataFrame) -> DataFrame:
    """One state of several, of equal ``lg_k``; the same trace in two of them counts once."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("list_id", "month").agg(F.hll_union_agg("sketch").alias("sketch"))


def bounced_estimates(state: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(list_id, bounced_ever): estimates over the months from ``first`` to ``last`` (any day of them), or over all."""
    month = F.col("month")
    if first is not None:
        state = state.where(month >= F.lit(first.replace(day=1)))
    if last is not None:
        state = state.where(month <= F.lit(last.replace(day=1)))
    return state.groupBy("list_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("bounced_ever"))
