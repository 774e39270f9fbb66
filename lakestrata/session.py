"""SparkSession defaults for layered tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(app: str = "lakestrata", **extra: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | extra).getOrCreate()
