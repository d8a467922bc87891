"""A session with the settings the operators count on; a cluster's own settings stay."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "segno", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
