"""Session settings every job here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times are UTC throughout; a local zone would move hours and window edges.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode.  A stage with
    # some 65 feature columns is above that; with this limit Spark splits it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows go to Python tasks in batches; long texts make batches of the usual 10,000 rows large on both sides.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
# These can only be given when the session is built.
START_SETTINGS = {
    # Looking up the caller of every column expression costs seconds on the driver
    # when a job builds hundreds of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add all settings to a session that is about to be built."""
    for key, value in {**SETTINGS, **START_SETTINGS}.items():
        builder = builder.config(key, value)
    return builder
