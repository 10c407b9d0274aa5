"""Audience reports: contact engagement (R13), list health (R14), re-engagement (R15)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import hundredths_to_double, pct, round_div, tier
from ..operators.ranking import range_row_number
from ..operators.rollups import email_mailing_ids
from ..sources.tables import Sources

# Fixed values of the reports, as parameters with the reference's defaults.
ENGAGEMENT_OPEN_WEIGHT = 50    # percent points per opened share (0.5 x 100)
ENGAGEMENT_CLICK_WEIGHT = 40   # 0.4 x 100
ENGAGEMENT_BOUNCE_PENALTY = 10
ENGAGEMENT_TIERS = ((70, "Highly Engaged"), (40, "Moderate"))
ENGAGEMENT_DEFAULT_TIER = "Cold"
HEALTH_BOUNCE_WEIGHT = 20
HEALTH_BADGES = ((85, "Healthy"), (60, "Average"))
HEALTH_DEFAULT_BADGE = "Needs Cleaning"
REENGAGEMENT_DAYS = ((90, "Lost"), (60, "Dormant"), (30, "At Risk"))


def _addressed(traces: DataFrame) -> DataFrame:
    e = F.col("email")
    return traces.where(e.isNotNull() & (e != ""))


def contact_engagement(src: Sources, numbered: bool = True, *,
                       open_weight: int = ENGAGEMENT_OPEN_WEIGHT,
                       click_weight: int = ENGAGEMENT_CLICK_WEIGHT,
                       bounce_penalty: int = ENGAGEMENT_BOUNCE_PENALTY,
                       tiers=ENGAGEMENT_TIERS, default_tier: str = ENGAGEMENT_DEFAULT_TIER) -> DataFrame:
    """Per e-mail address over e-mail traces: counts by current status and a score.

    score = clamp(0..100, 0.5 * open% + 0.4 * click% - 10 if ever bounced),
    rounded to 2 decimals; computed in integers from the counts.  Traces are
    counted per (address, mailing) before the mailing join, so neither a hot
    address nor a hot mailing is shuffled as raw rows, and both are spread
    over the pairs.  Ids: score descending, then address.
    """
    t = _addressed(src.mailing_trace).where(F.col("mass_mailing_id").isNotNull())
    st = F.col("trace_status")
    pairs = t.groupBy("email", "mass_mailing_id").agg(
        F.count(F.lit(1)).alias("_received"),
        F.count_if(st == "open").alias("_opened"),
        F.count_if(st == "click").alias("_clicked"),
        F.count_if(st == "bounce").alias("_bounced"),
    )
    ids = email_mailing_ids(src.mailing_mailing)
    pairs = pairs.join(ids, pairs["mass_mailing_id"] == ids["_mailing_id"], "left_semi")
    per = pairs.groupBy("email").agg(
        *[F.sum(f"_{c}").alias(f"total_{c}") for c in ("received", "opened", "clicked", "bounced")]
    )
    # score x n in percent points, clamped to 0..100 x n, then rounded / n
    raw = (f"total_opened * ({open_weight}) + total_clicked * ({click_weight})"
           f" - CASE WHEN total_bounced > 0 THEN total_received * ({bounce_penalty}) ELSE 0 END")
    clamped = f"greatest(0, least(total_received * 100, {raw}))"
    scored = per.select(
        "email", "total_received", "total_opened", "total_clicked", "total_bounced",
        pct("total_opened", "total_received").alias("open_rate"),
        pct("total_clicked", "total_received").alias("click_rate"),
        round_div(f"{clamped} * 100", "total_received").alias("_score_h"),
    )
    score_h = F.col("_score_h")
    scored = scored.select(
        "email", "total_received", "total_opened", "total_clicked", "total_bounced",
        "open_rate", "click_rate",
        hundredths_to_double(score_h).alias("engagement_score"),
        tier(score_h, [(b * 100, lbl) for b, lbl in tiers], default_tier)
        .alias("engagement_tier"),
    )
    if not numbered:
        return scored
    order = [F.col("engagement_score").desc_nulls_first(), F.col("email").asc_nulls_last()]
    return range_row_number(scored, order)


def bounced_subscribers(src: Sources, *more: Column) -> DataFrame:
    """(address, list, ``more`` columns of the trace) of bounced addresses held by a contact subscribed to the list.

    Addresses are made distinct before the contact join so the trace fact
    shrinks before the fan-out.
    """
    bounced = (
        src.mailing_trace.where((F.col("trace_status") == "bounce") & F.col("email").isNotNull())
        .select(F.col("email").alias("_email"), *more)
        .distinct()
    )
    contacts = src.mailing_contact.select(F.col("id").alias("_cid"), F.col("email").alias("_cemail"))
    hit = bounced.join(contacts, bounced["_email"] == contacts["_cemail"], "inner")
    subs = src.mailing_contact_subscription.select("contact_id", F.col("list_id").alias("_blid"))
    return hit.join(subs, hit["_cid"] == subs["contact_id"], "inner")


def list_health(src: Sources, bounced: DataFrame | None = None, *, bounce_weight: int = HEALTH_BOUNCE_WEIGHT,
                badges=HEALTH_BADGES, default_badge: str = HEALTH_DEFAULT_BADGE) -> DataFrame:
    """Per mailing list with subscriptions: active share, bounce exposure, health.

    ``bounced_ever`` counts distinct bounced addresses held by a contact
    subscribed to the list (exact, case-sensitive address match), or is taken
    from ``bounced`` (list_id, bounced_ever), such as the estimates of
    ``operators.sketches``.
    """
    sub = src.mailing_contact_subscription
    oo = F.col("opt_out")
    stats = sub.groupBy("list_id").agg(
        F.count("id").alias("total_contacts"),
        F.count_if(oo == F.lit(False)).alias("active_contacts"),
        F.count_if(oo == F.lit(True)).alias("opted_out"),
    )
    lists = src.mailing_list.select(F.col("id").alias("_lid"), F.col("name").alias("list_name"))
    stats = stats.join(lists, stats["list_id"] == lists["_lid"], "inner")

    if bounced is None:
        bstats = bounced_subscribers(src).groupBy("_blid").agg(F.count_distinct("_email").alias("_bounced_ever"))
    else:
        bstats = bounced.select(F.col("list_id").alias("_blid"), F.col("bounced_ever").alias("_bounced_ever"))

    j = stats.join(bstats, stats["list_id"] == bstats["_blid"], "left").where(F.col("total_contacts") > 0)
    total = F.col("total_contacts")
    active = F.col("active_contacts")
    bounced_ever = F.coalesce(F.col("_bounced_ever"), F.lit(0))
    health_h = round_div(
        f"greatest(0, active_contacts * 100 - coalesce(_bounced_ever, 0) * ({bounce_weight})) * 100",
        "total_contacts",
    )
    badge = None
    for bound, label in badges:
        cond = active * 100 >= total * bound
        badge = F.when(cond, label) if badge is None else badge.when(cond, label)
    badge = badge.otherwise(default_badge)
    return j.select(
        F.col("list_id").alias("id"),
        "list_id",
        "list_name",
        "total_contacts",
        "active_contacts",
        "opted_out",
        bounced_ever.alias("bounced_ever"),
        pct("active_contacts", "total_contacts").alias("active_pct"),
        hundredths_to_double(health_h).alias("health_score"),
        badge.alias("health_badge"),
    )


def _missed_per_address(src: Sources) -> DataFrame:
    """(address, last open, mailings missed since), from one scan of the traces.

    Per (address, mailing) the last open and the last send that was not
    opened are two events.  All events are numbered by address, newest first
    (an open before a send of the same time, sends without a time last).
    Before an address's first open in that order there are only sends, so
    the distance of the two numbers is the count of mailings missed; without
    an open it is the count of its events.  Numbers, minima and counts merge
    map-side, so a hot address is spread over ranges and never joined.
    """
    t = _addressed(src.mailing_trace)
    opened = F.col("open_datetime")
    pairs = t.groupBy("email", "mass_mailing_id").agg(
        F.max("open_datetime").alias("_open"),
        F.max(F.when(opened.isNull(), F.col("sent_datetime"))).alias("_sent"),
        F.count_if(opened.isNull()).alias("_unopened"),
    )
    seen = F.when(F.col("_open").isNotNull(), F.struct(F.col("_open").alias("at"), F.lit(0).alias("kind")))
    unopened = (F.col("_unopened") > 0) & F.col("mass_mailing_id").isNotNull()
    missed = F.when(unopened, F.struct(F.col("_sent").alias("at"), F.lit(1).alias("kind")))
    nothing = F.when(F.col("_open").isNull() & ~unopened, F.struct(F.col("_open").alias("at"), F.lit(2).alias("kind")))
    events = pairs.select("email", F.explode(F.array_compact(F.array(seen, missed, nothing))).alias("_e")).select("email", "_e.at", "_e.kind")
    order = [F.col("email").asc(), F.col("at").desc_nulls_last(), F.col("kind").asc()]
    e = range_row_number(events, order, "_number")
    number, kind = F.col("_number"), F.col("kind")
    per = e.groupBy("email").agg(
        F.max(F.when(kind == 0, F.col("at"))).alias("last_opened"), F.min(number).alias("_first"),
        F.min(F.when(kind == 0, number)).alias("_open"), F.count_if(kind == 1).alias("_missed"),
    )
    return per.select("email", "last_opened", F.coalesce(F.col("_open") - F.col("_first"), F.col("_missed")).alias("campaigns_since_last_open"))


def _clock(as_of: dt.datetime | str | None) -> Column:
    """The report's clock as a UTC wall-clock time; by default the time of each read.

    A time-zone-aware datetime is converted to UTC first.
    """
    if as_of is None:
        return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(dt.timezone.utc)
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp_ntz")


def reengagement(src: Sources, as_of: dt.datetime | str | None = None,
                 numbered: bool = True, *, thresholds=REENGAGEMENT_DAYS) -> DataFrame:
    """Addresses whose last open is missing or more than 30 days before ``as_of``.

    ``campaigns_since_last_open`` counts distinct mailings with an unopened
    trace sent after the last open (any unopened trace if never opened).
    ``thresholds`` are (days, status) from the longest to the shortest; the
    shortest is the cut-off of the report.
    """
    now = _clock(as_of)
    per = _missed_per_address(src)
    lo = F.col("last_opened")

    def older_than(days: int) -> Column:
        return lo < now - F.make_dt_interval(F.lit(days))

    per = per.where(lo.isNull() | older_than(thresholds[-1][0]))
    status = F.when(lo.isNull(), thresholds[0][1])
    for days, label in thresholds:
        status = status.when(older_than(days), label)
    out = per.select(
        "email",
        "last_opened",
        # whole elapsed days of the wall-clock difference (NTZ - NTZ: no time zone involved)
        F.extract(F.lit("DAY"), now - lo).cast("int").alias("days_since_last_open"),
        "campaigns_since_last_open",
        status.alias("reengagement_status"),
    )
    if not numbered:
        return out
    return range_row_number(out, [lo.asc_nulls_first(), F.col("email").asc_nulls_last()])
