"""Session defaults: adaptive plans, UTC, and Arrow for what must run in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "graphloom", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}),
        **conf,
    }
    return b.config(map=settings).getOrCreate()
