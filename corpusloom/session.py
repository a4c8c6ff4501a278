"""Session builder with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with UTC, AQE (coalescing and skew splitting) and Arrow switched on.

    ``master`` is only set when given, so a cluster's spark-submit decides it otherwise.
    Keyword arguments use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="64"``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        n = os.cpu_count() or 8
        defaults |= {"spark.sql.shuffle.partitions": str(min(n, 8)), "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
