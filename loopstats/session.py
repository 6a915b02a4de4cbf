"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of long texts fill a worker's memory by bytes, not by number; Spark's own limit is 10,000 rows, of any size.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    BATCH_BYTES[0]: BATCH_BYTES[1],
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "loopstats", **extra: str) -> SparkSession:
    """Session with the library's settings; `master` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
