"""A session with the settings that the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tallyspark", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's own business."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
