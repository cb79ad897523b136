"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Calendar days and month starts are UTC days and months.
    "spark.sql.session.timeZone": "UTC",
    # Coalesce small shuffle partitions, split hot ones in joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
TASKS_PER_CORE = 3


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings; memory and file split sizes stay the cluster's.

    On a cluster with more cores than shuffle partitions, shuffles start out with a few
    partitions per core and are coalesced to the advisory size at run time.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    if cores > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(TASKS_PER_CORE * cores))
    return spark
