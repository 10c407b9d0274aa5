"""DuckDB versions of the fixture derivations (see ``sources.fixtures``).

Each table is a CTE over the pre-registered driver views (orders, customer,
part, lineitem, nation).  ``fixture_ctes(names)`` returns the ``WITH`` body
for the requested tables plus whatever they depend on.
"""

from __future__ import annotations

T0 = "TIMESTAMP '1995-01-01 00:00:00'"


def _plus_hours(ts: str, n: str) -> str:
    return f"({ts} + to_hours(({n})::INTEGER))"


def _email(key: str) -> str:
    return (
        f"('c' || CAST(CASE WHEN {key} % 40 = 1 THEN {key} - 1 ELSE {key} END AS VARCHAR)"
        " || '@example.com')"
    )


_CTES: dict[str, tuple[tuple[str, ...], str]] = {}

_CTES["fx_orders"] = ((), f"""
SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, w,
       CASE WHEN o_custkey % 10 = 9 AND u < 90 THEN 'open'
            WHEN u < 6 * (w % 8) THEN 'open'
            WHEN u < 6 * (w % 8) + 8 THEN 'click'
            WHEN u < 6 * (w % 8) + 12 THEN 'reply'
            WHEN u < 6 * (w % 8) + 18 THEN 'bounce'
            WHEN u < 6 * (w % 8) + 22 THEN 'error'
            WHEN u < 6 * (w % 8) + 26 THEN 'cancel'
            WHEN u < 6 * (w % 8) + 28 THEN 'outgoing'
            ELSE 'sent' END AS trace_status
FROM (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
         (datediff('day', DATE '1995-01-01', o_orderdate::DATE) // 7)::BIGINT AS w,
         (o_orderkey * 37 + o_custkey * 11) % 100 AS u
  FROM orders
) o""")

_CTES["mailing_trace"] = (("fx_orders",), f"""
SELECT id, mass_mailing_id, email, trace_status, failure_type, sent_datetime, open_datetime,
       CASE WHEN trace_status = 'click' THEN {_plus_hours('open_datetime', '1')} END
         AS links_click_datetime,
       CASE WHEN trace_status = 'reply' THEN {_plus_hours('open_datetime', '2')} END
         AS reply_datetime
FROM (
  SELECT id, mass_mailing_id, email, trace_status, failure_type, sent_datetime,
         CASE WHEN trace_status IN ('open', 'click', 'reply')
              THEN {_plus_hours('sent_datetime', 'id % 72')} END AS open_datetime
  FROM (
    SELECT o_orderkey AS id,
           CAST(CASE WHEN o_orderkey % 101 = 0 THEN NULL
                     WHEN o_orderkey % 103 = 0 THEN 999999
                     ELSE w END AS BIGINT) AS mass_mailing_id,
           CASE WHEN o_orderkey % 97 = 0 THEN NULL
                WHEN o_orderkey % 89 = 0 THEN ''
                ELSE {_email('o_custkey')} END AS email,
           trace_status,
           CASE WHEN trace_status = 'bounce' THEN 'mail_bounce'
                WHEN trace_status = 'error' THEN
                  CASE substr(o_orderpriority, 1, 1)
                    WHEN '1' THEN 'mail_email_invalid'
                    WHEN '2' THEN 'mail_email_missing'
                    WHEN '3' THEN 'mail_from_invalid'
                    WHEN '4' THEN 'unknown'
                    ELSE '' END
                WHEN trace_status = 'cancel' THEN
                  CASE WHEN o_custkey % 2 = 0 THEN 'mail_optout' ELSE 'mail_dup' END
           END AS failure_type,
           CASE WHEN trace_status IN ('outgoing', 'cancel') THEN CAST(NULL AS TIMESTAMP)
                ELSE {_plus_hours('o_orderdate', 'o_orderkey % 24')} END AS sent_datetime
    FROM fx_orders
  ) a
) b""")


def _ratio(x: str) -> str:
    return (
        f"CASE WHEN w % 9 = 4 OR snt = 0 THEN CAST(NULL AS DOUBLE) "
        f"ELSE CAST(100 * ({x}) AS DOUBLE) / CAST(snt AS DOUBLE) END"
    )


_CTES["mailing_mailing"] = (("fx_orders",), f"""
SELECT w AS id,
       CASE WHEN w % 29 = 3 THEN NULL ELSE 'Offer ' || repeat('x', CAST(w % 20 AS INTEGER)) END
         AS subject,
       'team' || CAST(w % 3 AS VARCHAR) || '@example.com' AS email_from,
       CASE WHEN w % 10 = 9 THEN 'sms' ELSE 'mail' END AS mailing_type,
       CASE w % 12 WHEN 11 THEN 'draft' WHEN 10 THEN 'in_queue' WHEN 9 THEN 'sending'
            ELSE 'done' END AS state,
       CASE WHEN w % 12 IN (10, 11) OR w % 37 = 5 THEN CAST(NULL AS TIMESTAMP)
            ELSE {_plus_hours(T0, 'w * 168 + (w % 7) * 24 + (w * 5) % 24')} END AS sent_date,
       CASE WHEN w % 4 = 0 THEN CAST(NULL AS TIMESTAMP)
            ELSE {_plus_hours(T0, 'w * 168')} END AS schedule_date,
       n AS expected,
       CAST(CASE WHEN w % 43 = 8 THEN NULL WHEN w % 41 = 7 THEN 0 ELSE snt END AS BIGINT) AS sent,
       op AS opened,
       rp AS replied,
       CAST(CASE WHEN w % 31 = 6 THEN NULL ELSE bo END AS BIGINT) AS bounced,
       er AS failed,
       {_ratio('op')} AS opened_ratio,
       {_ratio('snt - bo')} AS received_ratio,
       {_ratio('rp')} AS replied_ratio,
       {_ratio('bo')} AS bounced_ratio,
       CASE w % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS ab_testing_enabled,
       CAST(CASE WHEN w % 4 = 3 THEN NULL ELSE (w % 4) * 10 END AS BIGINT) AS ab_testing_pc,
       CASE w % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'clicks' WHEN 2 THEN 'open' ELSE 'reply' END
         AS ab_testing_winner_selection,
       CASE WHEN w % 15 = 0 THEN NULL ELSE w % 2 = 0 END AS ab_testing_completed,
       CASE WHEN w % 25 = 0 THEN NULL ELSE w % 10 = 0 END AS ab_testing_is_winner_mailing
FROM (
  SELECT w,
         count(*) AS n,
         count(*) FILTER (WHERE trace_status NOT IN ('outgoing', 'cancel', 'error')) AS snt,
         count(*) FILTER (WHERE trace_status IN ('open', 'click', 'reply')) AS op,
         count(*) FILTER (WHERE trace_status = 'reply') AS rp,
         count(*) FILTER (WHERE trace_status = 'bounce') AS bo,
         count(*) FILTER (WHERE trace_status = 'error') AS er
  FROM fx_orders
  GROUP BY w
) g""")

_CTES["mailing_list"] = ((), """
SELECT n_nationkey AS id, n_name AS name FROM nation""")

_CTES["mailing_contact"] = ((), f"""
SELECT c_custkey AS id, {_email('c_custkey')} AS email FROM customer""")

_CTES["mailing_contact_subscription"] = ((), """
SELECT id, contact_id, list_id,
       CASE WHEN contact_id % 17 = 0 THEN NULL ELSE contact_id % 10 < list_id % 6 END AS opt_out
FROM (
  SELECT c_custkey AS id, c_custkey AS contact_id, c_nationkey AS list_id
  FROM customer WHERE c_nationkey <> 24
  UNION ALL
  SELECT c_custkey + 10000000 AS id, c_custkey AS contact_id, c_nationkey + 1 AS list_id
  FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 23
) s""")

_CTES["marketing_campaign"] = ((), f"""
SELECT k AS id, p_brand AS name,
       CASE k % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'running' ELSE 'stopped' END AS state,
       {_plus_hours(T0, 'k * 24')} AS create_date,
       CASE WHEN k % 4 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE {_plus_hours(T0, 'k * 48')} END
         AS last_sync_date
FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS k FROM part) b""")

_CTES["marketing_participant"] = ((), f"""
SELECT CAST(CASE WHEN l_suppkey % 31 = 30 THEN NULL ELSE l_suppkey % 24 + 1 END AS BIGINT)
         AS campaign_id,
       CASE l_returnflag WHEN 'N' THEN 'running' WHEN 'A' THEN 'completed'
            WHEN 'R' THEN 'removed' END AS state,
       CASE l_linenumber WHEN 7 THEN TRUE WHEN 6 THEN NULL ELSE FALSE END AS is_test,
       {_plus_hours('l_shipdate', 'l_linenumber')} AS create_date
FROM lineitem""")

_CTES["marketing_activity"] = ((), """
SELECT p_partkey AS id,
       CAST(substr(p_brand, 7) AS BIGINT) AS campaign_id,
       p_name AS name,
       CASE WHEN p_size % 5 = 0 THEN 'action' ELSE 'email' END AS activity_type,
       CASE p_partkey % 10 WHEN 0 THEN 'begin' WHEN 1 THEN 'mail_open'
            WHEN 2 THEN 'mail_not_open' WHEN 3 THEN 'mail_reply' WHEN 4 THEN 'mail_not_reply'
            WHEN 5 THEN 'mail_click' WHEN 6 THEN 'mail_not_click' WHEN 7 THEN 'mail_bounce'
            WHEN 8 THEN 'activity' END AS trigger_type,
       CAST(p_size AS INTEGER) AS interval_number,
       CASE p_size % 4 WHEN 0 THEN 'hours' WHEN 1 THEN 'days' WHEN 2 THEN 'weeks'
            ELSE 'months' END AS interval_type,
       CAST(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey % 350 END AS BIGINT)
         AS mass_mailing_id,
       CAST(p_size AS INTEGER) AS total_click,
       CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 3 END AS INTEGER) AS total_bounce,
       CAST(p_size * 2 AS INTEGER) AS processed,
       CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size % 4 END AS INTEGER) AS rejected
FROM part""")

TABLES = (
    "mailing_mailing", "mailing_trace", "marketing_campaign", "marketing_participant",
    "marketing_activity", "mailing_list", "mailing_contact", "mailing_contact_subscription",
)


def fixture_ctes(names) -> list[str]:
    """``name AS (...)`` snippets for ``names`` and their dependencies, in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in _CTES[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    return [f"{n} AS ({_CTES[n][1]}\n)" for n in ordered]


def fixture_query(table: str) -> str:
    return "WITH " + ",\n".join(fixture_ctes([table])) + f"\nSELECT * FROM {table}"
