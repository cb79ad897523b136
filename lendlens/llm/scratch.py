"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`.

    Where that is unset, a local session gets a temporary one; on a cluster, whose executors
    would not see it, this is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="llm-")
    return f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Of tables that are small next to what was shuffled, this share of the usual partitions.
FEW = 8


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """`df` as a stored table: its lineage ends here and a lost executor costs no recomputation.

    `few` suits tables that come out of a shuffle with little in each partition.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}"
    if few:
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.coalesce(max(1, usual // FEW)).write.parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
