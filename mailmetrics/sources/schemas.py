"""Explicit schemas of the eight marketing tables the reports read.

Only the columns the reports use are listed.  Reading with an explicit
schema keeps the Parquet scan pruned to these columns and makes a missing
column fail at analysis time instead of producing silent nulls.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


MAILING_MAILING = _schema(
    ("id", LongType()),
    ("subject", StringType()),
    ("email_from", StringType()),
    ("mailing_type", StringType()),
    ("state", StringType()),
    ("sent_date", TimestampNTZType()),
    ("schedule_date", TimestampNTZType()),
    ("expected", LongType()),
    ("sent", LongType()),
    ("opened", LongType()),
    ("replied", LongType()),
    ("bounced", LongType()),
    ("failed", LongType()),
    ("opened_ratio", DoubleType()),
    ("received_ratio", DoubleType()),
    ("replied_ratio", DoubleType()),
    ("bounced_ratio", DoubleType()),
    ("ab_testing_enabled", BooleanType()),
    ("ab_testing_pc", LongType()),
    ("ab_testing_winner_selection", StringType()),
    ("ab_testing_completed", BooleanType()),
    ("ab_testing_is_winner_mailing", BooleanType()),
)

MAILING_TRACE = _schema(
    ("id", LongType()),
    ("mass_mailing_id", LongType()),
    ("email", StringType()),
    ("trace_status", StringType()),
    ("failure_type", StringType()),
    ("sent_datetime", TimestampNTZType()),
    ("open_datetime", TimestampNTZType()),
    ("links_click_datetime", TimestampNTZType()),
    ("reply_datetime", TimestampNTZType()),
)

MARKETING_CAMPAIGN = _schema(
    ("id", LongType()),
    ("name", StringType()),
    ("state", StringType()),
    ("create_date", TimestampNTZType()),
    ("last_sync_date", TimestampNTZType()),
)

MARKETING_PARTICIPANT = _schema(
    ("campaign_id", LongType()),
    ("state", StringType()),
    ("is_test", BooleanType()),
    ("create_date", TimestampNTZType()),
)

MARKETING_ACTIVITY = _schema(
    ("id", LongType()),
    ("campaign_id", LongType()),
    ("name", StringType()),
    ("activity_type", StringType()),
    ("trigger_type", StringType()),
    ("interval_number", IntegerType()),
    ("interval_type", StringType()),
    ("mass_mailing_id", LongType()),
    ("total_click", IntegerType()),
    ("total_bounce", IntegerType()),
    ("processed", IntegerType()),
    ("rejected", IntegerType()),
)

MAILING_LIST = _schema(
    ("id", LongType()),
    ("name", StringType()),
)

MAILING_CONTACT = _schema(
    ("id", LongType()),
    ("email", StringType()),
)

MAILING_CONTACT_SUBSCRIPTION = _schema(
    ("id", LongType()),
    ("contact_id", LongType()),
    ("list_id", LongType()),
    ("opt_out", BooleanType()),
)

SCHEMAS: dict[str, StructType] = {
    "mailing_mailing": MAILING_MAILING,
    "mailing_trace": MAILING_TRACE,
    "marketing_campaign": MARKETING_CAMPAIGN,
    "marketing_participant": MARKETING_PARTICIPANT,
    "marketing_activity": MARKETING_ACTIVITY,
    "mailing_list": MAILING_LIST,
    "mailing_contact": MAILING_CONTACT,
    "mailing_contact_subscription": MAILING_CONTACT_SUBSCRIPTION,
}

# Enumerations of the stored codes (display lists; nothing enforces them).
# Fixed values of the data model.
MAILING_STATES = ("draft", "in_queue", "sending", "done")
MAILING_TYPES = ("mail", "sms")
TRACE_STATUSES = ("outgoing", "sent", "open", "reply", "click", "cancel", "bounce", "error")
FAILURE_TYPES = (
    "unknown", "mail_email_invalid", "mail_email_missing", "mail_from_missing",
    "mail_from_invalid", "mail_bounce", "mail_bl", "mail_optout", "mail_dup",
    "sms_number_missing", "sms_number_format_wrong", "sms_country_not_supported",
    "sms_registration_needed", "sms_credit", "sms_server", "sms_acc",
    "sms_blacklist", "sms_customer_error", "sms_rejected",
)
CAMPAIGN_STATES = ("draft", "running", "stopped")
ACTIVITY_TYPES = ("email", "action")
TRIGGER_TYPES = (
    "begin", "mail_open", "mail_not_open", "mail_reply", "mail_not_reply",
    "mail_click", "mail_not_click", "mail_bounce", "activity",
)
INTERVAL_TYPES = ("hours", "days", "weeks", "months")
PARTICIPANT_STATES = ("running", "completed", "removed")
AB_WINNER_SELECTIONS = ("manual", "clicks", "open", "reply")
