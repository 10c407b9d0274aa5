"""The fifteen reports as persistent views: Spark SQL over catalog tables.

A temp view ends with its session; ``create_views`` stores each report's SQL in
the catalog, where every session (and every SQL client of it) reads it, always
over the tables as they are then.  Formulas and fixed values are those of the
DataFrame reports; tests compare both, columns and types included.

Reports with one row per address or group are numbered as
``operators.ranking.range_row_number`` does it: rows are dealt out by ranges of
the order (``REPARTITION_BY_RANGE``), sorted and counted inside them.  The common
table expression that holds a row's range and place is not deterministic, so
Spark plans it once for both of its uses.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from ..functions.metrics import (
    exact_mean_sql,
    hundredths_to_double_sql,
    mean2_sql,
    pct_exact_sql,
    pct_sql,
    ratio2_sql,
    ratio_exact_sql,
    round_div_sql,
)
from .audience import (
    ENGAGEMENT_BOUNCE_PENALTY,
    ENGAGEMENT_CLICK_WEIGHT,
    ENGAGEMENT_DEFAULT_TIER,
    ENGAGEMENT_OPEN_WEIGHT,
    ENGAGEMENT_TIERS,
    HEALTH_BADGES,
    HEALTH_BOUNCE_WEIGHT,
    HEALTH_DEFAULT_BADGE,
    REENGAGEMENT_DAYS,
)
from .insights import RANKING_DEFAULT_TIER, RANKING_TIERS, RANKING_WEIGHT_SCALE, RANKING_WEIGHTS, SLOT_BEST, SLOT_WORST

#: The clock of the re-engagement view, read with every query (UTC wall clock).
CLOCK = "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)"


def _bands(value: str, bands, otherwise: str, scale: int = 1) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {b * scale} THEN '{label}'" for b, label in bands) + f" ELSE '{otherwise}' END"


def _month_label(year: str, month: str) -> str:
    first = f"make_date({year}, {month}, 1)"
    return f"concat(rpad(date_format({first}, 'MMMM'), 9, ' '), ' ', date_format({first}, 'yyyy'))"


#: E-mail mailings with the number of their traces now clicked and canceled.
_MAILINGS = """mailings AS (
  SELECT m.*, coalesce(r.n_click, 0) AS n_click, coalesce(r.n_cancel, 0) AS n_cancel
  FROM {s}mailing_mailing m LEFT JOIN (
    SELECT mass_mailing_id AS key, count_if(trace_status = 'click') AS n_click, count_if(trace_status = 'cancel') AS n_cancel
    FROM {s}mailing_trace WHERE trace_status IN ('click', 'cancel') AND mass_mailing_id IS NOT NULL GROUP BY mass_mailing_id
  ) r ON r.key = m.id
  WHERE m.mailing_type = 'mail')"""


def _numbered(base: str, keys: str, columns: str, ranges: int, name: str = "id") -> str:
    """Common table expressions from ``base`` to ``numbered``: ``columns`` behind their row number by ``keys`` (ascending, nulls first)."""
    return f"""placed AS (
  SELECT spark_partition_id() AS _range, monotonically_increasing_id() & {(1 << 33) - 1} AS _place, *
  FROM (SELECT * FROM (SELECT /*+ REPARTITION_BY_RANGE({ranges}, {keys}) */ * FROM {base}) SORT BY {keys})),
offsets AS (
  SELECT _range AS _r, coalesce(sum(count(*)) OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset
  FROM placed GROUP BY _range),
numbered AS (SELECT /*+ BROADCAST(offsets) */ _offset + _place + 1 AS {name}, {columns} FROM placed JOIN offsets ON _range = _r)"""


def campaign_stats() -> str:
    return f"""WITH {_MAILINGS}
SELECT id, id AS mailing_id, subject, email_from, mailing_type, state, sent_date, schedule_date,
  coalesce(expected, 0) AS total, coalesce(sent, 0) AS sent, greatest(0, coalesce(sent, 0) - coalesce(bounced, 0)) AS delivered,
  coalesce(opened, 0) AS opened, n_click AS clicked, coalesce(replied, 0) AS replied, coalesce(bounced, 0) AS bounced,
  coalesce(failed, 0) AS failed, n_cancel AS canceled,
  {ratio2_sql('opened_ratio')} AS open_rate, {pct_sql('n_click', 'sent')} AS click_rate, {ratio2_sql('bounced_ratio')} AS bounce_rate,
  {ratio2_sql('received_ratio')} AS delivery_rate, {ratio2_sql('replied_ratio')} AS reply_rate
FROM mailings"""


def delivery_details() -> str:
    return """SELECT t.id, t.id AS trace_id, t.mass_mailing_id AS mailing_id, t.email, t.trace_status, t.failure_type, t.sent_datetime,
  t.open_datetime, t.links_click_datetime AS clicked_datetime, t.reply_datetime AS replied_datetime
FROM {s}mailing_trace t LEFT SEMI JOIN {s}mailing_mailing m ON t.mass_mailing_id = m.id AND m.mailing_type = 'mail'"""


def automation_overview() -> str:
    rates = (("opened_ratio", "open_rate"), ("received_ratio", "delivery_rate"), ("bounced_ratio", "bounce_rate"), ("replied_ratio", "reply_rate"))
    def mean(ratio: str) -> str:
        return mean2_sql(f"CASE WHEN m.id IS NOT NULL THEN {ratio_exact_sql('m.' + ratio)} END")

    means = ", ".join(f"{mean(r)} AS {o}" for r, o in rates)
    return f"""WITH joined AS (
  SELECT campaign_id, count(*) AS everyone, count_if(state = 'running') AS running, count_if(state = 'completed') AS completed, count_if(is_test) AS test
  FROM {{s}}marketing_participant GROUP BY campaign_id),
mails AS (
  SELECT a.campaign_id, count(*) AS email_activities, {means}
  FROM {{s}}marketing_activity a LEFT JOIN {{s}}mailing_mailing m ON m.id = a.mass_mailing_id
  WHERE a.activity_type = 'email' GROUP BY a.campaign_id)
SELECT c.id, c.id AS campaign_id, c.name AS campaign_name, c.state, c.create_date, c.last_sync_date,
  coalesce(everyone, 0) AS total_participants, coalesce(running, 0) AS active_participants, coalesce(completed, 0) AS completed_participants,
  coalesce(test, 0) AS test_participants, coalesce(email_activities, 0) AS email_activities,
  {', '.join(f'coalesce({o}, 0D) AS {o}' for _, o in rates)}
FROM {{s}}marketing_campaign c LEFT JOIN joined ON joined.campaign_id = c.id LEFT JOIN mails ON mails.campaign_id = c.id"""


def activity_stats() -> str:
    return """SELECT a.id, a.id AS activity_id, a.campaign_id, a.name AS activity_name, a.activity_type, a.trigger_type, a.interval_number, a.interval_type,
  coalesce(m.sent, 0) AS sent, coalesce(m.opened, 0) AS opened, coalesce(a.total_click, 0) AS clicked, coalesce(a.total_bounce, 0) AS bounced,
  coalesce(m.replied, 0) AS replied, coalesce(a.processed, 0) AS processed, coalesce(a.rejected, 0) AS rejected
FROM {s}marketing_activity a LEFT JOIN {s}mailing_mailing m ON m.id = a.mass_mailing_id"""


def participant_breakdown(ranges: int) -> str:
    columns = "campaign_id, state, is_test, create_date, participant_count"
    nulls_last = ", ".join(f"_{i}, {c}" for i, c in enumerate(("campaign_id", "state", "is_test", "create_date")))
    return f"""WITH days AS (
  SELECT campaign_id, state, is_test, CAST(to_date(create_date) AS TIMESTAMP_NTZ) AS create_date, count(*) AS participant_count
  FROM {{s}}marketing_participant GROUP BY campaign_id, state, is_test, to_date(create_date)),
keyed AS (SELECT campaign_id IS NULL AS _0, state IS NULL AS _1, is_test IS NULL AS _2, create_date IS NULL AS _3, * FROM days),
{_numbered('keyed', nulls_last, columns, ranges)}
SELECT id, {columns} FROM numbered"""


def monthly_trend() -> str:
    return f"""WITH {_MAILINGS},
months AS (
  SELECT year(sent_date) AS year, month(sent_date) AS month, count(id) AS campaigns_sent, coalesce(sum(sent), 0) AS total_sent,
    coalesce(sum(greatest(0, coalesce(sent, 0) - coalesce(bounced, 0))), 0) AS total_delivered, coalesce(sum(opened), 0) AS total_opened,
    coalesce(sum(n_click), 0) AS total_clicked, coalesce(sum(bounced), 0) AS total_bounced,
    {mean2_sql(ratio_exact_sql('opened_ratio'))} AS open_rate, {mean2_sql(pct_exact_sql('n_click', 'sent'))} AS click_rate,
    {mean2_sql(ratio_exact_sql('bounced_ratio'))} AS bounce_rate, {mean2_sql(ratio_exact_sql('received_ratio'))} AS delivery_rate
  FROM mailings WHERE state = 'done' AND sent_date IS NOT NULL GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY year DESC, month DESC) AS BIGINT) AS id, {_month_label('year', 'month')} AS month_label, year, month, campaigns_sent,
  total_sent, total_delivered, total_opened, total_clicked, total_bounced, open_rate, click_rate, bounce_rate, delivery_rate
FROM months"""


def campaign_ranking() -> str:
    weighted = " + ".join(f"{ratio_exact_sql(c)} * ({w})" for c, w in RANKING_WEIGHTS.items())
    return f"""WITH {_MAILINGS},
scored AS (
  SELECT *, {round_div_sql(f'(({weighted}) * 100)', str(RANKING_WEIGHT_SCALE))} AS score FROM mailings WHERE state = 'done'),
ranks AS (
  SELECT score AS key, CAST(1 + coalesce(sum(count(*)) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS rank
  FROM scored GROUP BY score)
SELECT id, id AS mailing_id, subject, sent_date, rank, {hundredths_to_double_sql('score')} AS engagement_score,
  {_bands('score', RANKING_TIERS, RANKING_DEFAULT_TIER, 100)} AS performance_tier, {ratio2_sql('opened_ratio')} AS open_rate,
  {pct_sql('n_click', 'sent')} AS click_rate, {ratio2_sql('received_ratio')} AS delivery_rate, {ratio2_sql('replied_ratio')} AS reply_rate,
  {ratio2_sql('bounced_ratio')} AS bounce_rate
FROM scored JOIN ranks ON score = key"""


def failure_breakdown() -> str:
    return f"""WITH per_mailing AS (
  SELECT failure_type, year(sent_datetime) AS year, month(sent_datetime) AS month, mass_mailing_id, count(*) AS n
  FROM {{s}}mailing_trace WHERE failure_type <> '' GROUP BY ALL),
tagged AS (
  SELECT p.*, m.id AS mail FROM per_mailing p LEFT JOIN {{s}}mailing_mailing m ON m.id = p.mass_mailing_id AND m.mailing_type = 'mail'),
groups AS (
  SELECT failure_type, year, month, sum(n) FILTER (WHERE mail IS NOT NULL) AS failure_count, sum(sum(n)) OVER () AS total, count(mail) AS affected_campaigns
  FROM tagged GROUP BY failure_type, year, month)
SELECT CAST(row_number() OVER (ORDER BY failure_count DESC, failure_type, year NULLS LAST, month NULLS LAST) AS BIGINT) AS id, failure_type,
  {_month_label('year', 'month')} AS month_label, year, month, failure_count, {pct_sql('failure_count', 'total')} AS pct_of_total, affected_campaigns
FROM groups WHERE affected_campaigns > 0"""


def send_time_analysis() -> str:
    click = f"coalesce({pct_exact_sql('n_click', 'sent')}, 0)"
    return f"""WITH {_MAILINGS},
sliced AS (
  SELECT inline(array(
      named_struct('slot_type', 'hour', 'slot_label', concat(lpad(CAST(hour(sent_date) AS STRING), 2, '0'), ':00'), 'slot_value', hour(sent_date)),
      named_struct('slot_type', 'day', 'slot_label', date_format(sent_date, 'EEEE'), 'slot_value', weekday(sent_date) + 1))),
    {ratio_exact_sql('opened_ratio')} AS opens, {click} AS clicks
  FROM mailings WHERE state = 'done' AND sent_date IS NOT NULL),
slots AS (
  SELECT slot_type, slot_label, slot_value, count(*) AS campaigns_sent, {mean2_sql('opens')} AS avg_open_rate, {mean2_sql('clicks')} AS avg_click_rate
  FROM sliced GROUP BY slot_type, slot_label, slot_value),
placed AS (SELECT *, percent_rank() OVER (PARTITION BY slot_type ORDER BY avg_open_rate) AS place FROM slots)
SELECT CAST(row_number() OVER (ORDER BY slot_type, slot_value) AS BIGINT) AS id, slot_type, slot_label, slot_value, campaigns_sent, avg_open_rate, avg_click_rate,
  CASE WHEN place >= {SLOT_BEST}D THEN 'Best' WHEN place <= {SLOT_WORST}D THEN 'Worst' ELSE 'Average' END AS performance_label
FROM placed"""


def subject_lines() -> str:
    return f"""WITH {_MAILINGS}
SELECT id, id AS mailing_id, subject, length(subject) AS subject_length, coalesce(sent, 0) AS sent, {ratio2_sql('opened_ratio')} AS open_rate,
  {pct_sql('n_click', 'sent')} AS click_rate, {ratio2_sql('bounced_ratio')} AS bounce_rate, sent_date
FROM mailings WHERE state = 'done' AND subject IS NOT NULL"""


def ab_test_results() -> str:
    return f"""WITH {_MAILINGS}
SELECT id, id AS mailing_id, subject, ab_testing_enabled, coalesce(ab_testing_pc, 0) AS ab_testing_pc, ab_testing_winner_selection,
  coalesce(ab_testing_completed, false) AS ab_testing_completed, coalesce(ab_testing_is_winner_mailing, false) AS is_winner, coalesce(sent, 0) AS sent,
  {ratio2_sql('opened_ratio')} AS open_rate, {pct_sql('n_click', 'sent')} AS click_rate, {ratio2_sql('bounced_ratio')} AS bounce_rate, sent_date
FROM mailings WHERE ab_testing_enabled"""


def trigger_effectiveness() -> str:
    return f"""WITH clicks AS (
  SELECT mass_mailing_id AS key, count(*) AS n_click FROM {{s}}mailing_trace WHERE trace_status = 'click' GROUP BY mass_mailing_id),
triggers AS (
  SELECT a.trigger_type AS raw, count(a.id) AS activities_count, coalesce(sum(m.sent), 0) AS total_sent,
    {mean2_sql(ratio_exact_sql('m.opened_ratio'))} AS avg_open_rate, {mean2_sql(pct_exact_sql('coalesce(c.n_click, 0)', 'm.sent'))} AS avg_click_rate,
    {mean2_sql(ratio_exact_sql('m.bounced_ratio'))} AS avg_bounce_rate, {exact_mean_sql(ratio_exact_sql('m.opened_ratio'))} AS exact
  FROM {{s}}marketing_activity a LEFT JOIN {{s}}mailing_mailing m ON m.id = a.mass_mailing_id LEFT JOIN clicks c ON c.key = m.id
  WHERE a.activity_type = 'email' GROUP BY a.trigger_type)
SELECT CAST(row_number() OVER (ORDER BY exact DESC, raw NULLS LAST) AS BIGINT) AS id, coalesce(raw, 'begin') AS trigger_type, activities_count, total_sent,
  avg_open_rate, avg_click_rate, avg_bounce_rate
FROM triggers"""


def contact_engagement(ranges: int) -> str:
    counts = "total_received, total_opened, total_clicked, total_bounced"
    columns = f"email, {counts}, open_rate, click_rate, engagement_score, engagement_tier"
    raw = (f"total_opened * ({ENGAGEMENT_OPEN_WEIGHT}) + total_clicked * ({ENGAGEMENT_CLICK_WEIGHT})"
           f" - if(total_bounced > 0, total_received * ({ENGAGEMENT_BOUNCE_PENALTY}), 0)")
    score = round_div_sql(f"greatest(0, least(total_received * 100, {raw})) * 100", "total_received")
    return f"""WITH pairs AS (
  SELECT email, mass_mailing_id, count(*) AS r, count_if(trace_status = 'open') AS o, count_if(trace_status = 'click') AS c, count_if(trace_status = 'bounce') AS b
  FROM {{s}}mailing_trace WHERE email <> '' AND mass_mailing_id IS NOT NULL GROUP BY email, mass_mailing_id),
addresses AS (
  SELECT email, sum(r) AS total_received, sum(o) AS total_opened, sum(c) AS total_clicked, sum(b) AS total_bounced
  FROM pairs LEFT SEMI JOIN {{s}}mailing_mailing m ON m.id = mass_mailing_id AND m.mailing_type = 'mail' GROUP BY email),
points AS (SELECT *, {score} AS score FROM addresses),
scored AS (
  SELECT email, {counts}, {pct_sql('total_opened', 'total_received')} AS open_rate, {pct_sql('total_clicked', 'total_received')} AS click_rate,
    {hundredths_to_double_sql('score')} AS engagement_score, {_bands('score', ENGAGEMENT_TIERS, ENGAGEMENT_DEFAULT_TIER, 100)} AS engagement_tier, -score AS _down
  FROM points),
{_numbered('scored', '_down, email', columns, ranges)}
SELECT id, {columns} FROM numbered"""


def list_health() -> str:
    badge = "CASE " + " ".join(f"WHEN active_contacts * 100 >= total_contacts * {b} THEN '{label}'" for b, label in HEALTH_BADGES)
    health = round_div_sql(f"greatest(0, active_contacts * 100 - bounced_ever * ({HEALTH_BOUNCE_WEIGHT})) * 100", "total_contacts")
    return f"""WITH bounces AS (SELECT DISTINCT email FROM {{s}}mailing_trace WHERE trace_status = 'bounce' AND email IS NOT NULL),
hits AS (
  SELECT s.list_id, count(DISTINCT b.email) AS bounced_ever
  FROM bounces b JOIN {{s}}mailing_contact c ON c.email = b.email JOIN {{s}}mailing_contact_subscription s ON s.contact_id = c.id GROUP BY s.list_id),
members AS (
  SELECT list_id, count(id) AS total_contacts, count_if(NOT opt_out) AS active_contacts, count_if(opt_out) AS opted_out
  FROM {{s}}mailing_contact_subscription GROUP BY list_id),
lists AS (
  SELECT CAST(l.id AS BIGINT) AS list_id, l.name AS list_name, total_contacts, active_contacts, opted_out, coalesce(h.bounced_ever, 0) AS bounced_ever
  FROM {{s}}mailing_list l JOIN members m ON m.list_id = l.id LEFT JOIN hits h ON h.list_id = l.id WHERE total_contacts > 0)
SELECT list_id AS id, *, {pct_sql('active_contacts', 'total_contacts')} AS active_pct, {hundredths_to_double_sql(health)} AS health_score,
  {badge} ELSE '{HEALTH_DEFAULT_BADGE}' END AS health_badge
FROM lists"""


def reengagement(ranges: int, as_of: str = CLOCK) -> str:
    columns = "email, last_opened, days_since_last_open, campaigns_since_last_open, reengagement_status"
    never, shortest = REENGAGEMENT_DAYS[0][1], REENGAGEMENT_DAYS[-1][0]
    status = " ".join(f"WHEN last_opened < {as_of} - INTERVAL '{d}' DAY THEN '{label}'" for d, label in REENGAGEMENT_DAYS)
    # oldest first: behind an address's last open there are only the sends it missed since
    events = _numbered("events", "email, at, kind", "email, at, kind", ranges, "number")
    inner = events.replace("placed", "placed_events").replace("offsets", "offsets_of_events").replace("numbered AS", "numbered_events AS")
    return f"""WITH pairs AS (
  SELECT email, mass_mailing_id, max(open_datetime) AS opened, max(sent_datetime) FILTER (WHERE open_datetime IS NULL) AS sent,
    count_if(open_datetime IS NULL) > 0 AND mass_mailing_id IS NOT NULL AS missed
  FROM {{s}}mailing_trace WHERE email <> '' GROUP BY email, mass_mailing_id),
events AS (
  SELECT email, inline(filter(array(
      named_struct('at', opened, 'kind', if(opened IS NULL, -1, 1)), if(missed, named_struct('at', sent, 'kind', 0), NULL)), e -> e IS NOT NULL))
  FROM pairs),
{inner},
addresses AS (
  SELECT email, max(at) FILTER (WHERE kind = 1) AS last_opened,
    coalesce(max(number) - max(number) FILTER (WHERE kind = 1), count_if(kind = 0)) AS campaigns_since_last_open
  FROM numbered_events GROUP BY email),
dormant AS (
  SELECT email, last_opened, CAST(extract(DAY FROM {as_of} - last_opened) AS INT) AS days_since_last_open, campaigns_since_last_open,
    CASE WHEN last_opened IS NULL THEN '{never}' {status} END AS reengagement_status
  FROM addresses WHERE last_opened IS NULL OR last_opened < {as_of} - INTERVAL '{shortest}' DAY),
{_numbered('dormant', 'last_opened, email', columns, ranges)}
SELECT id, {columns} FROM numbered"""


_PLAIN = {f.__name__: f for f in (campaign_stats, delivery_details, automation_overview, activity_stats, monthly_trend, campaign_ranking,
                                  failure_breakdown, send_time_analysis, subject_lines, ab_test_results, trigger_effectiveness, list_health)}
VIEWS = (*_PLAIN, "participant_breakdown", "contact_engagement", "reengagement")


def view_sql(name: str, source: str = "", *, ranges: int = 200, as_of: dt.datetime | str | None = None) -> str:
    """Spark SQL of one report; ``source``: database of the eight tables."""
    if name in _PLAIN:
        text = _PLAIN[name]()
    elif name == "reengagement":
        if isinstance(as_of, dt.datetime):
            as_of = (as_of.astimezone(dt.timezone.utc) if as_of.tzinfo else as_of).strftime("%Y-%m-%d %H:%M:%S.%f")
        text = reengagement(ranges) if as_of is None else reengagement(ranges, f"TIMESTAMP_NTZ '{as_of}'")
    else:
        text = {"participant_breakdown": participant_breakdown, "contact_engagement": contact_engagement}[name](ranges)
    return text.replace("{s}", f"{source}." if source else "")


def create_views(spark: SparkSession, database: str, source: str, *, prefix: str = "", ranges: int | None = None,
                 as_of: dt.datetime | str | None = None, names: list[str] | None = None) -> list[str]:
    """(Re)create each report as a view ``<database>.<prefix><name>`` of the catalog; repeatable.

    ``source``: database with the eight tables.  ``ranges``: parts that the
    numbered reports are sorted in (default: the shuffle partitions now).
    """
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = []
    for name in names or VIEWS:
        made.append(f"{database}.{prefix}{name}")
        spark.sql(f"CREATE OR REPLACE VIEW {made[-1]} AS {view_sql(name, source, ranges=n, as_of=as_of)}")
    return made
