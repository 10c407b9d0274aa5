"""The ad-hoc slice layer over the reports: lists, pivots, charts, filters, group-bys.

Every report has a ``ReportView`` entry (data, not code): its list columns
and default order, its pivot, chart series, named predicates, search fields
and named group-bys.  The functions below turn an entry into a DataFrame
plan on top of the report's own plan, so Catalyst optimises report + slice
as one query (a filter on a report column is pushed below the report's
joins where it can be).

Measure policy for pivots, charts and group-bys (the reference names the
measures but not their aggregate): counts are summed, rates / scores /
lengths / days are averaged (exact mean, 2 decimals), ``trace_id`` is
counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import mean2_of_hundredths
from ..sources import schemas

ASC, DESC = "asc", "desc"


@dataclass(frozen=True)
class Pivot:
    rows: str
    measures: tuple[str, ...]
    column: str | None = None
    # Known domain of ``column``: the wide form is built with these values
    # (no extra job to discover them).  None: long form unless given.
    values: tuple | None = None
    # Whether the report itself makes the values.  Else the data may hold
    # others: they are gathered in the column ``other``, nulls in ``null``.
    closed: bool = False


@dataclass(frozen=True)
class Chart:
    dimension: str
    measures: tuple[str, ...]
    kind: str  # bar, line, pie (drawing is not built; this is the series)


@dataclass(frozen=True)
class ReportView:
    report: str
    hidden: tuple[str, ...]                       # report columns not in the list
    order: tuple[tuple[str, str], ...]            # default order
    pivot: Pivot
    chart: Chart | None = None
    predicates: dict[str, tuple[str, str, object]] = field(default_factory=dict)
    search: tuple[str, ...] = ()
    group_bys: dict[str, str] = field(default_factory=dict)  # name -> column / 'col:month'
    columns: tuple[str, ...] = ()                 # the list's own column order, if not the report's


def _eq(col: str, value) -> tuple[str, str, object]:
    return (col, "=", value)


def _status_filters(col: str, pairs: Sequence[tuple[str, str]]) -> dict:
    return {name: _eq(col, value) for name, value in pairs}


# The view definitions of the fifteen reports.
VIEWS: dict[str, ReportView] = {
    "campaign_stats": ReportView(
        "campaign_stats", ("id", "mailing_id"), (("sent_date", DESC),),
        Pivot("mailing_type", ("total", "sent", "opened", "clicked", "bounced", "open_rate",
                               "click_rate", "delivery_rate"), "state", schemas.MAILING_STATES),
        Chart("subject", ("sent", "opened", "clicked", "bounced"), "bar"),
        _status_filters("state", [("sent", "done"), ("sending", "sending"), ("draft", "draft")]),
        ("subject", "email_from"),
        {"state": "state", "sent_date_month": "sent_date:month"},
    ),
    "delivery_details": ReportView(
        "delivery_details", ("id", "trace_id"), (("sent_datetime", DESC),),
        Pivot("trace_status", ("trace_id",), "mailing_id"),
        Chart("trace_status", ("trace_id",), "pie"),
        _status_filters("trace_status", [("opened", "open"), ("clicked", "click"), ("bounced", "bounce"),
                                         ("replied", "reply"), ("failed", "error"), ("canceled", "cancel")]),
        ("email", "mailing_id"),
        {"trace_status": "trace_status", "mailing_id": "mailing_id", "failure_type": "failure_type"},
    ),
    "automation_overview": ReportView(
        "automation_overview", ("id", "campaign_id"), (("create_date", DESC),),
        Pivot("campaign_name", ("total_participants", "active_participants", "email_activities",
                                "open_rate", "delivery_rate"), "state", schemas.CAMPAIGN_STATES),
        Chart("campaign_name", ("total_participants", "open_rate", "delivery_rate"), "bar"),
        _status_filters("state", [("running", "running"), ("draft", "draft"), ("stopped", "stopped")]),
        ("campaign_name",),
        {"state": "state"},
    ),
    "activity_stats": ReportView(
        "activity_stats", ("id", "activity_id"), (("campaign_id", ASC), ("activity_name", ASC)),
        Pivot("trigger_type", ("sent", "opened", "clicked", "bounced"), "activity_type",
              schemas.ACTIVITY_TYPES),
        Chart("trigger_type", ("sent", "opened", "clicked"), "bar"),
        _status_filters("activity_type", [("email", "email"), ("action", "action")]),
        ("activity_name", "campaign_id"),
        {"campaign_id": "campaign_id", "trigger_type": "trigger_type", "activity_type": "activity_type"},
    ),
    "participant_breakdown": ReportView(
        "participant_breakdown", ("id",), (("campaign_id", ASC), ("state", ASC)),
        Pivot("campaign_id", ("participant_count",), "state", schemas.PARTICIPANT_STATES),
        Chart("state", ("participant_count",), "pie"),
        {**_status_filters("state", [("running", "running"), ("completed", "completed"),
                                     ("removed", "removed")]),
         "no_test": _eq("is_test", False)},
        ("campaign_id",),
        {"campaign_id": "campaign_id", "state": "state"},
    ),
    "monthly_trend": ReportView(
        "monthly_trend", ("id", "year", "month"), (("year", DESC), ("month", DESC)),
        Pivot("month_label", ("total_sent", "total_opened", "total_clicked", "open_rate",
                              "delivery_rate"), "year"),
        Chart("month_label", ("total_sent", "total_opened", "open_rate"), "line"),
        {},
        ("month_label",),
        {"year": "year"},
    ),
    "campaign_ranking": ReportView(
        "campaign_ranking", ("id", "mailing_id"), (("rank", ASC),),
        Pivot("performance_tier", ("engagement_score", "open_rate", "delivery_rate")),
        None,
        _status_filters("performance_tier", [("top", "Top Performer"), ("avg", "Average"),
                                             ("poor", "Needs Attention")]),
        ("subject",),
        {"performance_tier": "performance_tier"},
        ("rank", "subject", "engagement_score", "performance_tier", "open_rate", "click_rate",
         "delivery_rate", "reply_rate", "bounce_rate", "sent_date"),
    ),
    "failure_breakdown": ReportView(
        "failure_breakdown", ("id", "year", "month"), (("failure_count", DESC),),
        Pivot("failure_type", ("failure_count", "affected_campaigns"), "year"),
        Chart("failure_type", ("failure_count",), "pie"),
        {},
        ("failure_type", "month_label"),
        {"failure_type": "failure_type", "month_label": "month_label"},
    ),
    "send_time_analysis": ReportView(
        "send_time_analysis", ("id", "slot_value"), (("avg_open_rate", DESC),),
        Pivot("slot_label", ("campaigns_sent", "avg_open_rate", "avg_click_rate"), "slot_type",
              ("hour", "day"), closed=True),
        None,
        {**_status_filters("slot_type", [("by_hour", "hour"), ("by_day", "day")]),
         **_status_filters("performance_label", [("best", "Best"), ("worst", "Worst")])},
        (),
        {"slot_type": "slot_type"},
    ),
    "subject_lines": ReportView(
        "subject_lines", ("id", "mailing_id"), (("open_rate", DESC),),
        Pivot("subject", ("sent", "open_rate", "click_rate", "subject_length")),
        None,
        {},
        ("subject",),
        {},
    ),
    "ab_test_results": ReportView(
        "ab_test_results", ("id", "mailing_id", "ab_testing_enabled", "is_winner"), (("sent_date", DESC),),
        Pivot("ab_testing_winner_selection", ("sent", "open_rate", "click_rate"),
              "ab_testing_completed", (True, False), closed=True),
        None,
        {"completed": _eq("ab_testing_completed", True), "in_progress": _eq("ab_testing_completed", False)},
        ("subject",),
        {"ab_testing_winner_selection": "ab_testing_winner_selection"},
    ),
    "trigger_effectiveness": ReportView(
        "trigger_effectiveness", ("id",), (("avg_open_rate", DESC),),
        Pivot("trigger_type", ("activities_count", "total_sent", "avg_open_rate", "avg_click_rate")),
        Chart("trigger_type", ("avg_open_rate", "avg_click_rate", "avg_bounce_rate"), "bar"),
        {},
        ("trigger_type",),
        {},
    ),
    "contact_engagement": ReportView(
        "contact_engagement", ("id",), (("engagement_score", DESC),),
        Pivot("engagement_tier", ("total_received", "total_opened", "engagement_score")),
        None,
        {**_status_filters("engagement_tier", [("highly_engaged", "Highly Engaged"),
                                               ("moderate", "Moderate"), ("cold", "Cold")]),
         "bounced": ("total_bounced", ">", 0)},
        ("email",),
        {"engagement_tier": "engagement_tier"},
    ),
    "list_health": ReportView(
        "list_health", ("id", "list_id"), (("health_score", DESC),),
        Pivot("health_badge", ("total_contacts", "active_contacts", "bounced_ever", "health_score")),
        Chart("list_name", ("active_contacts", "opted_out", "bounced_ever"), "bar"),
        _status_filters("health_badge", [("healthy", "Healthy"), ("average", "Average"),
                                         ("needs_cleaning", "Needs Cleaning")]),
        ("list_name",),
        {"health_badge": "health_badge"},
    ),
    "reengagement": ReportView(
        "reengagement", ("id",), (("days_since_last_open", DESC),),
        Pivot("reengagement_status", ("days_since_last_open", "campaigns_since_last_open")),
        None,
        _status_filters("reengagement_status", [("at_risk", "At Risk"), ("dormant", "Dormant"),
                                                ("lost", "Lost")]),
        ("email",),
        {"reengagement_status": "reengagement_status"},
    ),
}

# Integer keys are searched by equality, text by case-insensitive substring.
INTEGER_SEARCH_FIELDS = {"mailing_id", "campaign_id"}


def measure_kind(name: str) -> str:
    """sum for counts, mean for rates / scores / lengths / days, count for trace ids."""
    if name == "trace_id":
        return "count"
    if name.endswith(("_rate", "_pct", "_score")) or name in ("subject_length", "days_since_last_open"):
        return "mean"
    return "sum"


def measure(name: str) -> Column:
    kind = measure_kind(name)
    if kind == "count":
        return F.count(F.col(name)).alias(name)
    if kind == "mean":
        return mean2_of_hundredths(name).alias(name)
    return F.sum(F.col(name)).alias(name)


def _order_col(col: str, direction: str) -> Column:
    # SQL default null placement: ascending nulls last, descending nulls first.
    return F.col(col).asc_nulls_last() if direction == ASC else F.col(col).desc_nulls_first()


def list_view(df: DataFrame, report: str, ordered: bool = True) -> DataFrame:
    """The report's list: visible columns, optionally in the default order."""
    v = VIEWS[report]
    out = df.select(*(v.columns or [c for c in df.columns if c not in v.hidden]))
    if ordered:
        out = out.orderBy(*[_order_col(c, d) for c, d in v.order])
    return out


def pivot_view(df: DataFrame, report: str, values: Sequence | None = None) -> DataFrame:
    """The report's pivot.

    With a column dimension of known domain (or ``values`` given) the result
    is wide, columns ``<value>_<measure>`` (``<value>`` for one measure);
    otherwise long: one row per (row value, column value).  A wide pivot over
    stored values has the columns ``other`` (any other value) and ``null``
    beside them, so no row is lost.
    """
    p = VIEWS[report].pivot
    aggs = [measure(m) for m in p.measures]
    if p.column is None:
        return df.groupBy(p.rows).agg(*aggs)
    vals = values if values is not None else p.values
    if vals is None:
        return df.groupBy(p.rows, p.column).agg(*aggs)
    vals = list(vals)
    if p.closed and values is None:
        return df.groupBy(p.rows).pivot(p.column, vals).agg(*aggs)
    c = F.col(p.column)
    key = F.when(c.isNull(), "null").when(c.isin(vals), c.cast("string")).otherwise("other")
    names = [str(v).lower() if isinstance(v, bool) else str(v) for v in vals]
    keyed = df.withColumn("_column", key)
    return keyed.groupBy(p.rows).pivot("_column", [*names, "other", "null"]).agg(*aggs)


def chart_series(df: DataFrame, report: str) -> DataFrame:
    c = VIEWS[report].chart
    if c is None:
        raise KeyError(f"{report} has no chart")
    return df.groupBy(c.dimension).agg(*[measure(m) for m in c.measures])


def predicate(report: str, name: str) -> Column:
    col, op, value = VIEWS[report].predicates[name]
    c = F.col(col)
    if op == "=":
        return c == F.lit(value)
    if op == ">":
        return c > F.lit(value)
    raise ValueError(op)


def filter_view(df: DataFrame, report: str, *names: str) -> DataFrame:
    """Apply named predicates; several names are alternatives (OR), as in a
    search panel where filters of one group widen the selection."""
    cond = None
    for n in names:
        p = predicate(report, n)
        cond = p if cond is None else (cond | p)
    return df if cond is None else df.where(cond)


def search_view(df: DataFrame, report: str, field_name: str, text) -> DataFrame:
    if field_name not in VIEWS[report].search:
        raise KeyError(f"{report} has no search field {field_name}")
    c = F.col(field_name)
    if field_name in INTEGER_SEARCH_FIELDS:
        return df.where(c == F.lit(int(text)))
    return df.where(F.lower(c).contains(str(text).lower()))


def group_key(spec: str) -> Column:
    if spec.endswith(":month"):
        col = spec.split(":")[0]
        return F.date_trunc("month", F.col(col)).cast("timestamp_ntz").alias(f"{col}_month")
    return F.col(spec)


def group_view(df: DataFrame, report: str, name: str) -> DataFrame:
    """A named group-by: row count plus the pivot's measures per key."""
    v = VIEWS[report]
    key = group_key(v.group_bys[name])
    aggs = [F.count(F.lit(1)).alias("record_count")]
    aggs += [measure(m) for m in v.pivot.measures if m != "trace_id"]
    return df.groupBy(key).agg(*aggs)
