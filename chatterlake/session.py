"""Session defaults for the jobs; a session made elsewhere works as well."""

from pyspark.sql import SparkSession

# Settings the jobs rely on for good plans. They are ordinary session settings,
# so a cluster's own values win when the session already exists.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name="chatterlake", master=None, **extra):
    """Create (or return) a session with the defaults above plus `extra` settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
