"""Session settings the operators rely on, and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "newslens", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win by ``conf``."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Months and naive dates are UTC; refuse to compute them in another zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path every executor can reach.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, else
    below the warehouse, which executors share too. Never a machine's own
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/newslens-{name}-{uuid.uuid4().hex}"
