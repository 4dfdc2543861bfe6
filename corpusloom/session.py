"""A session with the settings the engine's plans expect; an existing one is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "corpusloom", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # parents of a thread are walked one level a round
        "spark.sql.cteRecursionLevelLimit": "10000",
    } | conf
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings and not os.environ.get("MASTER"):
        builder = builder.master("local[*]")
    return builder.config(map=settings).getOrCreate()
