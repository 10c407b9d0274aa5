"""DuckDB SQL for the slice layer: each slice is a query over the report's SQL.

Built from the same view table as the Spark side (which columns, which
measures), with the aggregates written out in SQL.
"""

from __future__ import annotations

from ..plans.slices import INTEGER_SEARCH_FIELDS, VIEWS, measure_kind
from .reports_sql import REPORT_SQL, h2d, round_div

# Report columns in output order (needed for list projections).
REPORT_COLUMNS = {
    "campaign_stats": "id mailing_id subject email_from mailing_type state sent_date schedule_date total sent delivered opened clicked replied bounced failed canceled open_rate click_rate bounce_rate delivery_rate reply_rate",
    "delivery_details": "id trace_id mailing_id email trace_status failure_type sent_datetime open_datetime clicked_datetime replied_datetime",
    "automation_overview": "id campaign_id campaign_name state create_date last_sync_date total_participants active_participants completed_participants test_participants email_activities open_rate delivery_rate bounce_rate reply_rate",
    "activity_stats": "id activity_id campaign_id activity_name activity_type trigger_type interval_number interval_type sent opened clicked bounced replied processed rejected",
    "participant_breakdown": "id campaign_id state is_test create_date participant_count",
    "monthly_trend": "id month_label year month campaigns_sent total_sent total_delivered total_opened total_clicked total_bounced open_rate click_rate bounce_rate delivery_rate",
    "campaign_ranking": "id mailing_id subject sent_date rank engagement_score performance_tier open_rate click_rate delivery_rate reply_rate bounce_rate",
    "failure_breakdown": "id failure_type month_label year month failure_count pct_of_total affected_campaigns",
    "send_time_analysis": "id slot_type slot_label slot_value campaigns_sent avg_open_rate avg_click_rate performance_label",
    "subject_lines": "id mailing_id subject subject_length sent open_rate click_rate bounce_rate sent_date",
    "ab_test_results": "id mailing_id subject ab_testing_enabled ab_testing_pc ab_testing_winner_selection ab_testing_completed is_winner sent open_rate click_rate bounce_rate sent_date",
    "trigger_effectiveness": "id trigger_type activities_count total_sent avg_open_rate avg_click_rate avg_bounce_rate",
    "contact_engagement": "id email total_received total_opened total_clicked total_bounced open_rate click_rate engagement_score engagement_tier",
    "list_health": "id list_id list_name total_contacts active_contacts opted_out bounced_ever active_pct health_score health_badge",
    "reengagement": "id email last_opened days_since_last_open campaigns_since_last_open reengagement_status",
}
REPORT_COLUMNS = {k: v.split() for k, v in REPORT_COLUMNS.items()}


def _lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _agg(name: str, only: str | None = None) -> str:
    """Aggregate of measure ``name``, optionally restricted by condition ``only``."""
    x = name if only is None else f"CASE WHEN {only} THEN {name} END"
    kind = measure_kind(name)
    if kind == "count":
        return f"count({x})"
    if kind == "mean":
        h = f"CAST(CAST({x} AS DECIMAL(18,2)) * 100 AS BIGINT)"
        return h2d(round_div(f"sum({h})", f"count({h})"))
    return f"CAST(sum({x}) AS BIGINT)"


def _from(report: str) -> str:
    # The report SQL is a full WITH ... SELECT; wrap it as a derived table.
    return f"({REPORT_SQL[report]()}) r"


def _visible(report: str) -> str:
    v = VIEWS[report]
    return ", ".join(v.columns or [c for c in REPORT_COLUMNS[report] if c not in v.hidden])


def list_sql(report: str) -> str:
    return f"SELECT {_visible(report)} FROM {_from(report)}"


def pivot_sql(report: str) -> str:
    p = VIEWS[report].pivot
    if p.column is None:
        aggs = ", ".join(f"{_agg(m)} AS {m}" for m in p.measures)
        return f"SELECT {p.rows}, {aggs} FROM {_from(report)} GROUP BY {p.rows}"
    if p.values is None:
        aggs = ", ".join(f"{_agg(m)} AS {m}" for m in p.measures)
        return (f"SELECT {p.rows}, {p.column}, {aggs} FROM {_from(report)} "
                f"GROUP BY {p.rows}, {p.column}")
    parts = []
    for value in p.values:
        label = str(value).lower() if isinstance(value, bool) else str(value)
        cond = f"{p.column} = {_lit(value)}"
        for m in p.measures:
            name = label if len(p.measures) == 1 else f"{label}_{m}"
            parts.append(f'{_agg(m, cond)} AS "{name}"')
    if not p.closed:  # values outside the list, and no value
        listed = ", ".join(_lit(v) for v in p.values)
        for label, cond in (("other", f"{p.column} NOT IN ({listed})"), ("null", f"{p.column} IS NULL")):
            for m in p.measures:
                name = label if len(p.measures) == 1 else f"{label}_{m}"
                parts.append(f'{_agg(m, cond)} AS "{name}"')
    return f"SELECT {p.rows}, {', '.join(parts)} FROM {_from(report)} GROUP BY {p.rows}"


def chart_sql(report: str) -> str:
    c = VIEWS[report].chart
    aggs = ", ".join(f"{_agg(m)} AS {m}" for m in c.measures)
    return f"SELECT {c.dimension}, {aggs} FROM {_from(report)} GROUP BY {c.dimension}"


def group_sql(report: str, name: str) -> str:
    v = VIEWS[report]
    spec = v.group_bys[name]
    if spec.endswith(":month"):
        col = spec.split(":")[0]
        key = f"CAST(date_trunc('month', {col}) AS TIMESTAMP) AS {col}_month"
    else:
        key = spec
    aggs = ["count(*) AS record_count"] + [f"{_agg(m)} AS {m}" for m in v.pivot.measures if m != "trace_id"]
    return f"SELECT {key}, {', '.join(aggs)} FROM {_from(report)} GROUP BY 1"


def filter_sql(report: str, name: str) -> str:
    col, op, value = VIEWS[report].predicates[name]
    return f"SELECT {_visible(report)} FROM {_from(report)} WHERE {col} {op} {_lit(value)}"


def search_sql(report: str, field: str, text) -> str:
    if field in INTEGER_SEARCH_FIELDS:
        cond = f"{field} = {int(text)}"
    else:
        cond = f"contains(lower({field}), {_lit(str(text).lower())})"
    return f"SELECT {_visible(report)} FROM {_from(report)} WHERE {cond}"
