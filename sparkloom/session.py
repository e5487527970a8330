"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: RocksDB state: the store that keyed text splitting needs for processor state of any type.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(app: str = "sparkloom", **more: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; a cluster's own settings win where they are given by name."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }
    for key, value in (defaults | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
