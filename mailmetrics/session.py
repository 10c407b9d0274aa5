"""Session helper: settings the reports rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the reports assume: timestamps are wall-clock values (NTZ) and
# month/weekday names come out in English; AQE re-plans joins and coalesces
# shuffle partitions at runtime and splits skewed join partitions.  Where the
# ids of e-mail mailings are too many to broadcast, Spark puts a Bloom filter
# of them over the scan of a large fact (R1, R2, R13), so other traces aren't
# shuffled: ids of up to 1 GB (Spark's default: 10 MB) make a filter of 4 MB,
# sized for 4 million ids; more ids only let more traces through.
REPORT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mailmetrics",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no server opened)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans are built from many Column calls; skip per-call origin capture.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in {**REPORT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
