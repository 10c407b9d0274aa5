"""mailmetrics: e-mail marketing and automation reports as Spark DataFrames.

    from mailmetrics import Sources, mailing
    src = Sources.from_parquet(spark, "s3://bucket/marketing")
    mailing.campaign_stats(src).where("state = 'done'").show()
"""

from .plans import audience, automation, catalog, insights, mailing, slices
from .plans.catalog import REPORTS, build_report, register_reports
from .sources.tables import Sources

__all__ = ["Sources", "REPORTS", "build_report", "register_reports", "catalog", "slices",
           "mailing", "automation", "insights", "audience"]
