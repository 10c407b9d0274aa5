"""Derive the eight marketing tables from the TPC-H-style test tables.

The test data holds no marketing tables, so each one is a fixed expression
over a driver table (orders -> traces and mailings, customer -> contacts and
subscriptions, nation -> lists, part -> campaigns and activities, lineitem ->
participants).  The same expressions exist in DuckDB SQL in
``mailmetrics.oracle.fixtures_sql``; both sides give identical rows.

All derivations are narrow projections of one scan except
``mailing_mailing``, which is an aggregate of the derived orders by week.
The expressions are Spark SQL strings (``selectExpr``): one call per column
keeps plan construction cheap.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the fixture definition.
EPOCH = "timestamp_ntz'1995-01-01 00:00:00'"
NULL_TS = "cast(null as timestamp_ntz)"


def plus_hours(ts: str, n: str) -> str:
    return f"timestampadd(HOUR, cast({n} as int), {ts})"


def contact_email(key: str) -> str:
    return f"concat('c', cast(CASE WHEN {key} % 40 = 1 THEN {key} - 1 ELSE {key} END AS string), '@example.com')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def orders_with_status(orders: DataFrame) -> DataFrame:
    """Orders plus the week ``w`` and the derived trace status."""
    o = orders.selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
        "cast(floor(datediff(cast(o_orderdate as date), date'1995-01-01') / 7) as bigint) AS w",
        "(o_orderkey * 37 + o_custkey * 11) % 100 AS u",
    )
    return o.selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "w",
        """CASE WHEN o_custkey % 10 = 9 AND u < 90 THEN 'open'
                WHEN u < 6 * (w % 8) THEN 'open'
                WHEN u < 6 * (w % 8) + 8 THEN 'click'
                WHEN u < 6 * (w % 8) + 12 THEN 'reply'
                WHEN u < 6 * (w % 8) + 18 THEN 'bounce'
                WHEN u < 6 * (w % 8) + 22 THEN 'error'
                WHEN u < 6 * (w % 8) + 26 THEN 'cancel'
                WHEN u < 6 * (w % 8) + 28 THEN 'outgoing'
                ELSE 'sent' END AS trace_status""",
    )


def mailing_trace(orders: DataFrame) -> DataFrame:
    o = orders_with_status(orders).selectExpr(
        "o_orderkey AS id",
        """CASE WHEN o_orderkey % 101 = 0 THEN cast(null as bigint)
                WHEN o_orderkey % 103 = 0 THEN cast(999999 as bigint)
                ELSE w END AS mass_mailing_id""",
        f"""CASE WHEN o_orderkey % 97 = 0 THEN cast(null as string)
                 WHEN o_orderkey % 89 = 0 THEN ''
                 ELSE {contact_email('o_custkey')} END AS email""",
        "trace_status",
        """CASE WHEN trace_status = 'bounce' THEN 'mail_bounce'
                WHEN trace_status = 'error' THEN
                  CASE substr(o_orderpriority, 1, 1)
                    WHEN '1' THEN 'mail_email_invalid' WHEN '2' THEN 'mail_email_missing'
                    WHEN '3' THEN 'mail_from_invalid' WHEN '4' THEN 'unknown' ELSE '' END
                WHEN trace_status = 'cancel' THEN
                  CASE WHEN o_custkey % 2 = 0 THEN 'mail_optout' ELSE 'mail_dup' END
           END AS failure_type""",
        f"""CASE WHEN trace_status IN ('outgoing', 'cancel') THEN {NULL_TS}
                 ELSE {plus_hours('o_orderdate', 'o_orderkey % 24')} END AS sent_datetime""",
    )
    o = o.selectExpr(
        "*",
        f"""CASE WHEN trace_status IN ('open', 'click', 'reply')
                 THEN {plus_hours('sent_datetime', 'id % 72')} END AS open_datetime""",
    )
    return o.selectExpr(
        "*",
        f"CASE WHEN trace_status = 'click' THEN {plus_hours('open_datetime', '1')} END AS links_click_datetime",
        f"CASE WHEN trace_status = 'reply' THEN {plus_hours('open_datetime', '2')} END AS reply_datetime",
    )


def _ratio(x: str) -> str:
    return f"CASE WHEN w % 9 = 4 OR snt = 0 THEN cast(null as double) ELSE cast(100 * ({x}) as double) / cast(snt as double) END"


def mailing_mailing(orders: DataFrame) -> DataFrame:
    """One mailing per week ``w``, its counters counted from that week's orders."""
    agg = orders_with_status(orders).groupBy("w").agg(*_week_counts())
    return agg.selectExpr(
        "w AS id",
        "CASE WHEN w % 29 = 3 THEN cast(null as string) ELSE concat('Offer ', repeat('x', cast(w % 20 as int))) END AS subject",
        "concat('team', cast(w % 3 as string), '@example.com') AS email_from",
        "CASE WHEN w % 10 = 9 THEN 'sms' ELSE 'mail' END AS mailing_type",
        "CASE w % 12 WHEN 11 THEN 'draft' WHEN 10 THEN 'in_queue' WHEN 9 THEN 'sending' ELSE 'done' END AS state",
        f"""CASE WHEN w % 12 IN (10, 11) OR w % 37 = 5 THEN {NULL_TS}
                 ELSE {plus_hours(EPOCH, 'w * 168 + (w % 7) * 24 + (w * 5) % 24')} END AS sent_date""",
        f"CASE WHEN w % 4 = 0 THEN {NULL_TS} ELSE {plus_hours(EPOCH, 'w * 168')} END AS schedule_date",
        "n AS expected",
        "CASE WHEN w % 43 = 8 THEN cast(null as bigint) WHEN w % 41 = 7 THEN cast(0 as bigint) ELSE snt END AS sent",
        "op AS opened",
        "rp AS replied",
        "CASE WHEN w % 31 = 6 THEN cast(null as bigint) ELSE bo END AS bounced",
        "er AS failed",
        f"{_ratio('op')} AS opened_ratio",
        f"{_ratio('snt - bo')} AS received_ratio",
        f"{_ratio('rp')} AS replied_ratio",
        f"{_ratio('bo')} AS bounced_ratio",
        "CASE w % 5 WHEN 0 THEN true WHEN 1 THEN cast(null as boolean) ELSE false END AS ab_testing_enabled",
        "CASE WHEN w % 4 = 3 THEN cast(null as bigint) ELSE (w % 4) * 10 END AS ab_testing_pc",
        "CASE w % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'clicks' WHEN 2 THEN 'open' ELSE 'reply' END AS ab_testing_winner_selection",
        "CASE WHEN w % 15 = 0 THEN cast(null as boolean) ELSE w % 2 = 0 END AS ab_testing_completed",
        "CASE WHEN w % 25 = 0 THEN cast(null as boolean) ELSE w % 10 = 0 END AS ab_testing_is_winner_mailing",
    )


def _week_counts():
    from pyspark.sql import functions as F

    return [
        F.expr("count(1)").alias("n"),
        F.expr("count_if(trace_status NOT IN ('outgoing', 'cancel', 'error'))").alias("snt"),
        F.expr("count_if(trace_status IN ('open', 'click', 'reply'))").alias("op"),
        F.expr("count_if(trace_status = 'reply')").alias("rp"),
        F.expr("count_if(trace_status = 'bounce')").alias("bo"),
        F.expr("count_if(trace_status = 'error')").alias("er"),
    ]


def mailing_list(nation: DataFrame) -> DataFrame:
    return nation.selectExpr("n_nationkey AS id", "n_name AS name")


def mailing_contact(customer: DataFrame) -> DataFrame:
    return customer.selectExpr("c_custkey AS id", f"{contact_email('c_custkey')} AS email")


def mailing_contact_subscription(customer: DataFrame) -> DataFrame:
    first = customer.where("c_nationkey <> 24").selectExpr(
        "c_custkey AS id", "c_custkey AS contact_id", "c_nationkey AS list_id"
    )
    second = customer.where("c_custkey % 3 = 0 AND c_nationkey < 23").selectExpr(
        "c_custkey + 10000000 AS id", "c_custkey AS contact_id", "c_nationkey + 1 AS list_id"
    )
    return first.unionByName(second).selectExpr(
        "id", "contact_id", "list_id",
        "CASE WHEN contact_id % 17 = 0 THEN cast(null as boolean) ELSE contact_id % 10 < list_id % 6 END AS opt_out",
    )


def marketing_campaign(part: DataFrame) -> DataFrame:
    brands = part.select("p_brand").distinct().selectExpr(
        "p_brand", "cast(substr(p_brand, 7) as bigint) AS k"
    )
    return brands.selectExpr(
        "k AS id",
        "p_brand AS name",
        "CASE k % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'running' ELSE 'stopped' END AS state",
        f"{plus_hours(EPOCH, 'k * 24')} AS create_date",
        f"CASE WHEN k % 4 = 0 THEN {NULL_TS} ELSE {plus_hours(EPOCH, 'k * 48')} END AS last_sync_date",
    )


def marketing_participant(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "CASE WHEN l_suppkey % 31 = 30 THEN cast(null as bigint) ELSE l_suppkey % 24 + 1 END AS campaign_id",
        "CASE l_returnflag WHEN 'N' THEN 'running' WHEN 'A' THEN 'completed' WHEN 'R' THEN 'removed' END AS state",
        "CASE l_linenumber WHEN 7 THEN true WHEN 6 THEN cast(null as boolean) ELSE false END AS is_test",
        f"{plus_hours('l_shipdate', 'l_linenumber')} AS create_date",
    )


def marketing_activity(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS id",
        "cast(substr(p_brand, 7) as bigint) AS campaign_id",
        "p_name AS name",
        "CASE WHEN p_size % 5 = 0 THEN 'action' ELSE 'email' END AS activity_type",
        """CASE p_partkey % 10 WHEN 0 THEN 'begin' WHEN 1 THEN 'mail_open' WHEN 2 THEN 'mail_not_open'
                WHEN 3 THEN 'mail_reply' WHEN 4 THEN 'mail_not_reply' WHEN 5 THEN 'mail_click'
                WHEN 6 THEN 'mail_not_click' WHEN 7 THEN 'mail_bounce' WHEN 8 THEN 'activity'
           END AS trigger_type""",
        "cast(p_size as int) AS interval_number",
        "CASE p_size % 4 WHEN 0 THEN 'hours' WHEN 1 THEN 'days' WHEN 2 THEN 'weeks' ELSE 'months' END AS interval_type",
        "CASE WHEN p_size % 5 = 0 THEN cast(null as bigint) ELSE p_partkey % 350 END AS mass_mailing_id",
        "cast(p_size as int) AS total_click",
        "cast(CASE WHEN p_partkey % 7 = 0 THEN null ELSE p_size % 3 END as int) AS total_bounce",
        "cast(p_size * 2 as int) AS processed",
        "cast(CASE WHEN p_partkey % 11 = 0 THEN null ELSE p_size % 4 END as int) AS rejected",
    )


def derive_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    part = _read(spark, sf_dir, "part")
    return {
        "mailing_mailing": mailing_mailing(orders),
        "mailing_trace": mailing_trace(orders),
        "marketing_campaign": marketing_campaign(part),
        "marketing_participant": marketing_participant(_read(spark, sf_dir, "lineitem")),
        "marketing_activity": marketing_activity(part),
        "mailing_list": mailing_list(_read(spark, sf_dir, "nation")),
        "mailing_contact": mailing_contact(customer),
        "mailing_contact_subscription": mailing_contact_subscription(customer),
    }
