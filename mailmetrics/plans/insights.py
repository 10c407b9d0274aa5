"""Insight reports R6-R12: trend, ranking, failures, send time, subjects, A/B, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import (
    exact_mean,
    hour_label,
    hundredths_to_double,
    iso_weekday,
    mean2,
    month_label_of,
    pct,
    pct_exact_sql,
    ratio2,
    ratio_exact,
    ratio_exact_sql,
    round_div,
    tier,
    weekday_name,
)
from ..operators.ranking import histogram_rank, small_row_number
from ..operators.rollups import email_mailing_ids, trace_rollup
from ..sources.tables import Sources

# Fixed values of the reports (weights and tier bounds), as parameters.
RANKING_WEIGHTS = {"opened_ratio": 4, "received_ratio": 3, "replied_ratio": 2, "bounced_ratio": -1}
RANKING_WEIGHT_SCALE = 10  # weights above are tenths: 0.4, 0.3, 0.2, -0.1
RANKING_TIERS = ((40, "Top Performer"), (20, "Average"))
RANKING_DEFAULT_TIER = "Needs Attention"
SLOT_BEST = 0.8
SLOT_WORST = 0.2


def _sent_email_mailings(src: Sources, rollup: DataFrame | None, require_sent_date: bool) -> DataFrame:
    """Done e-mail mailings joined to their click count (``clicked``, null as 0)."""
    m = src.mailing_mailing.where((F.col("mailing_type") == "mail") & (F.col("state") == "done"))
    if require_sent_date:
        m = m.where(F.col("sent_date").isNotNull())
    r = rollup if rollup is not None else trace_rollup(src.mailing_trace)
    r = r.select("mass_mailing_id", "clicked")
    return m.join(r, m["id"] == r["mass_mailing_id"], "left").withColumn(
        "clicked", F.coalesce(F.col("clicked"), F.lit(0))
    )


def monthly_trend(src: Sources, rollup: DataFrame | None = None) -> DataFrame:
    """Per calendar month of the send date: volumes and mean rates of done e-mail mailings.

    Mean click rate skips mailings without a send count; null stored ratios
    count as 0 in the other means.
    """
    m = _sent_email_mailings(src, rollup, require_sent_date=True)
    sd = F.col("sent_date")
    g = m.groupBy(
        F.year(sd).cast("int").alias("year"),
        F.month(sd).cast("int").alias("month"),
    ).agg(
        F.count("id").alias("campaigns_sent"),
        F.coalesce(F.sum("sent"), F.lit(0)).alias("total_sent"),
        F.coalesce(
            F.sum(F.greatest(F.lit(0), F.coalesce(F.col("sent"), F.lit(0)) - F.coalesce(F.col("bounced"), F.lit(0)))),
            F.lit(0),
        ).alias("total_delivered"),
        F.coalesce(F.sum("opened"), F.lit(0)).alias("total_opened"),
        F.coalesce(F.sum("clicked"), F.lit(0)).alias("total_clicked"),
        F.coalesce(F.sum("bounced"), F.lit(0)).alias("total_bounced"),
        mean2(ratio_exact_sql("opened_ratio")).alias("open_rate"),
        mean2(pct_exact_sql("clicked", "sent")).alias("click_rate"),
        mean2(ratio_exact_sql("bounced_ratio")).alias("bounce_rate"),
        mean2(ratio_exact_sql("received_ratio")).alias("delivery_rate"),
    )
    g = small_row_number(g, [F.col("year").desc_nulls_first(), F.col("month").desc_nulls_first()])
    return g.select(
        "id", month_label_of("year", "month").alias("month_label"), "year", "month", "campaigns_sent", "total_sent", "total_delivered",
        "total_opened", "total_clicked", "total_bounced", "open_rate", "click_rate",
        "bounce_rate", "delivery_rate",
    )


def campaign_ranking(src: Sources, rollup: DataFrame | None = None, *,
                     weights: dict[str, int] = RANKING_WEIGHTS,
                     tiers=RANKING_TIERS, default_tier: str = RANKING_DEFAULT_TIER) -> DataFrame:
    """Done e-mail mailings scored 0.4 open + 0.3 delivery + 0.2 reply - 0.1 bounce.

    The score is rounded to 2 decimals before ranking and tiering; ``rank``
    is SQL ``RANK`` (ties share a rank, gaps follow).  ``weights`` are in
    tenths per stored ratio; ``tiers`` are (lower bound, label), highest first.
    """
    m = _sent_email_mailings(src, rollup, require_sent_date=False)
    weighted = " + ".join(f"{ratio_exact_sql(col)} * ({w})" for col, w in weights.items())
    # percents * tenths -> hundredths of a point, rounded once
    score_h = round_div(f"(({weighted}) * 100)", str(RANKING_WEIGHT_SCALE))
    scored = m.select(
        F.col("id"),
        F.col("subject"),
        F.col("sent_date"),
        ratio2("opened_ratio").alias("open_rate"),
        pct("clicked", "sent").alias("click_rate"),
        ratio2("received_ratio").alias("delivery_rate"),
        ratio2("replied_ratio").alias("reply_rate"),
        ratio2("bounced_ratio").alias("bounce_rate"),
        score_h.alias("_score_h"),
    )
    ranked = histogram_rank(scored, "_score_h", "rank")
    return ranked.select(
        "id",
        F.col("id").alias("mailing_id"),
        "subject",
        "sent_date",
        "rank",
        hundredths_to_double(F.col("_score_h")).alias("engagement_score"),
        tier(F.col("_score_h"), [(b * 100, lbl) for b, lbl in tiers], default_tier)
        .alias("performance_tier"),
        "open_rate", "click_rate", "delivery_rate", "reply_rate", "bounce_rate",
    )


def failure_breakdown(src: Sources) -> DataFrame:
    """E-mail failures per (failure type, month of send): count, share, mailings hit.

    The share's denominator is every non-empty failure of any mailing type,
    orphans included.  Failing traces are counted per (type, month, mailing)
    first, so the fact is shuffled as partial counts only; that table is
    tagged e-mail / other by its mailing and summed, a mailing being one row
    of it.  The grand total is a window sum over the (small) grouped table.
    """
    t = src.mailing_trace.where(F.col("failure_type").isNotNull() & (F.col("failure_type") != ""))
    sd = F.col("sent_datetime")
    per = t.groupBy(
        "failure_type",
        F.year(sd).cast("int").alias("year"),
        F.month(sd).cast("int").alias("month"),
        "mass_mailing_id",
    ).agg(F.count(F.lit(1)).alias("_n"))
    ids = email_mailing_ids(src.mailing_mailing)
    tagged = per.join(ids, per["mass_mailing_id"] == ids["_mailing_id"], "left").withColumn(
        "_is_mail", F.col("_mailing_id").isNotNull()
    )
    g = tagged.groupBy("failure_type", "year", "month", "_is_mail").agg(
        F.sum("_n").alias("failure_count"),
        F.count("_mailing_id").alias("affected_campaigns"),
    )
    g = g.withColumn("_total", F.sum("failure_count").over(Window.partitionBy()))
    g = g.where(F.col("_is_mail")).withColumn("pct_of_total", pct("failure_count", "_total"))
    g = small_row_number(
        g,
        [
            F.col("failure_count").desc_nulls_first(),
            F.col("failure_type").asc_nulls_last(),
            F.col("year").asc_nulls_last(),
            F.col("month").asc_nulls_last(),
        ],
    )
    return g.select(
        "id", "failure_type", month_label_of("year", "month").alias("month_label"), "year", "month",
        "failure_count",
        "pct_of_total", "affected_campaigns",
    )


def send_time_analysis(src: Sources, rollup: DataFrame | None = None, *,
                       best: float = SLOT_BEST, worst: float = SLOT_WORST) -> DataFrame:
    """Done e-mail mailings sliced by hour of day and by ISO weekday.

    One pass: each mailing is exploded into its two slots and grouped once.
    Mean click rate counts a missing rate as 0.  ``percent_rank`` of the
    rounded mean open rate within the slot type labels Best / Worst / Average.
    """
    m = _sent_email_mailings(src, rollup, require_sent_date=True)
    sd = F.col("sent_date")
    hour = F.hour(sd).cast("int")
    slots = F.array(
        F.struct(F.lit("hour").alias("slot_type"), hour_label(hour).alias("slot_label"), hour.alias("slot_value")),
        F.struct(F.lit("day").alias("slot_type"), weekday_name(sd).alias("slot_label"), iso_weekday(sd).alias("slot_value")),
    )
    e = m.select(
        F.explode(slots).alias("slot"),
        ratio_exact("opened_ratio").alias("_open"),
        F.expr(f"coalesce({pct_exact_sql('clicked', 'sent')}, 0)").alias("_click"),
    )
    g = e.groupBy("slot.slot_type", "slot.slot_label", "slot.slot_value").agg(
        F.count(F.lit(1)).alias("campaigns_sent"),
        mean2("_open").alias("avg_open_rate"),
        mean2("_click").alias("avg_click_rate"),
    )
    prank = F.percent_rank().over(Window.partitionBy("slot_type").orderBy(F.col("avg_open_rate").asc_nulls_last()))
    g = g.withColumn("_prank", prank)
    label = F.when(F.col("_prank") >= best, "Best").when(F.col("_prank") <= worst, "Worst").otherwise("Average")
    g = small_row_number(g, [F.col("slot_type").asc_nulls_last(), F.col("slot_value").asc_nulls_last()])
    return g.select(
        "id", "slot_type", "slot_label", "slot_value", "campaigns_sent", "avg_open_rate",
        "avg_click_rate", label.alias("performance_label"),
    )


def subject_lines(src: Sources, rollup: DataFrame | None = None) -> DataFrame:
    """Done e-mail mailings with a subject: subject length and rates."""
    m = _sent_email_mailings(src, rollup, require_sent_date=False).where(F.col("subject").isNotNull())
    return m.select(
        F.col("id").alias("id"),
        F.col("id").alias("mailing_id"),
        "subject",
        F.length(F.coalesce(F.col("subject"), F.lit(""))).alias("subject_length"),
        F.coalesce(F.col("sent"), F.lit(0)).alias("sent"),
        ratio2("opened_ratio").alias("open_rate"),
        pct("clicked", "sent").alias("click_rate"),
        ratio2("bounced_ratio").alias("bounce_rate"),
        "sent_date",
    )


def ab_test_results(src: Sources, rollup: DataFrame | None = None) -> DataFrame:
    """E-mail mailings with A/B testing on, in any state."""
    m = src.mailing_mailing.where(
        (F.col("mailing_type") == "mail") & (F.col("ab_testing_enabled") == F.lit(True))
    )
    r = rollup if rollup is not None else trace_rollup(src.mailing_trace)
    r = r.select("mass_mailing_id", "clicked")
    j = m.join(r, m["id"] == r["mass_mailing_id"], "left")
    no = F.lit(False)
    return j.select(
        F.col("id").alias("id"),
        F.col("id").alias("mailing_id"),
        "subject",
        F.coalesce(F.col("ab_testing_enabled"), no).alias("ab_testing_enabled"),
        F.coalesce(F.col("ab_testing_pc"), F.lit(0)).alias("ab_testing_pc"),
        "ab_testing_winner_selection",
        F.coalesce(F.col("ab_testing_completed"), no).alias("ab_testing_completed"),
        F.coalesce(F.col("ab_testing_is_winner_mailing"), no).alias("is_winner"),
        F.coalesce(F.col("sent"), F.lit(0)).alias("sent"),
        ratio2("opened_ratio").alias("open_rate"),
        pct("coalesce(clicked, 0)", "sent").alias("click_rate"),
        ratio2("bounced_ratio").alias("bounce_rate"),
        "sent_date",
    )


def trigger_effectiveness(src: Sources, rollup: DataFrame | None = None) -> DataFrame:
    """E-mail activities per raw trigger type (null shown as 'begin').

    Activities without a mailing count as 0 in the open and bounce means and
    are skipped in the click mean.  Ids follow the unrounded mean open rate
    descending, ties by the raw trigger (nulls last).
    """
    a = src.marketing_activity.where(F.col("activity_type") == "email").select(
        "id", "trigger_type", "mass_mailing_id"
    )
    mm = src.mailing_mailing.select(
        F.col("id").alias("_mid"), F.col("sent").alias("_sent"),
        "opened_ratio", "bounced_ratio",
    )
    r = rollup if rollup is not None else trace_rollup(src.mailing_trace)
    r = r.select(F.col("mass_mailing_id").alias("_rmid"), "clicked")
    j = a.join(mm, a["mass_mailing_id"] == mm["_mid"], "left").join(
        r, F.col("_mid") == r["_rmid"], "left"
    )
    g = j.groupBy("trigger_type").agg(
        F.count("id").alias("activities_count"),
        F.coalesce(F.sum("_sent"), F.lit(0)).alias("total_sent"),
        mean2(ratio_exact_sql("opened_ratio")).alias("avg_open_rate"),
        mean2(pct_exact_sql("coalesce(clicked, 0)", "_sent")).alias("avg_click_rate"),
        mean2(ratio_exact_sql("bounced_ratio")).alias("avg_bounce_rate"),
        exact_mean(ratio_exact_sql("opened_ratio")).alias("_open_exact"),
    )
    g = small_row_number(
        g, [F.col("_open_exact").desc_nulls_first(), F.col("trigger_type").asc_nulls_last()]
    )
    return g.select(
        "id",
        F.coalesce(F.col("trigger_type"), F.lit("begin")).alias("trigger_type"),
        "activities_count", "total_sent", "avg_open_rate", "avg_click_rate", "avg_bounce_rate",
    )
