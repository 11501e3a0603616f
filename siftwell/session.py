"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "siftwell", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
