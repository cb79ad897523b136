"""How much of a table goes to a Python function at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Spark's own bound on a batch is 10,000 rows, which are many bytes where rows hold whole texts.
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES = 1 << 20


def bounded(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends rows to Python in batches of about `BYTES`.

    What a function returns for a row must not depend on the batch. It is a session setting, since
    a lazy result is planned only when it is read; one that is there already stays.
    """
    spark = df.sparkSession
    if spark.conf.get(KEY, None) is None:
        spark.conf.set(KEY, str(BYTES))
    return df
