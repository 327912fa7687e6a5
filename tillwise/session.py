"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a UTC clock.

    Adaptive execution does three things the operators count on: it joins small
    reduce partitions, splits skewed join partitions, and turns a shuffle join
    into a broadcast one when the measured size of a side allows it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites are recorded for every column expression otherwise.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
