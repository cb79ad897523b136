"""Applications and tags stored in the same buckets of applications, so that their join moves nothing.

Both tables are bucketed by application id, with equal counts, so each task joins one bucket of
each without a shuffle; only the grouped measures are exchanged at the end. Tags are stored as
counts per application and day: whatever number of tags an application carries, its bucket
holds at most one row a day of it. Bounds on whole days, the only ones that tags meet, are exact
on them.

A bucket is read by one task and cannot be split, so one application id must not stand for many
rows: storing raises an error then, and such applications keep the plain join, which splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens import constants as k
from lendlens.functions import classify
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators.tags import TAG_KEY, tag_counts
from lendlens.sources.tables import Sources

TAG_DAY = "tagged_on"
#: Rows that one application id may have in a bucket.
MOST_ROWS = 1000


class HotApplication(ValueError):
    """An application id with too many rows for one bucket."""


def tag_days(tags: DataFrame) -> DataFrame:
    """LowNGrow and Starter tags by application and day."""
    bucket = F.col("tag_bucket")
    marked = tags.select(
        TAG_KEY, F.to_date("date_created").alias(TAG_DAY), classify.tag_bucket().alias("tag_bucket")
    ).filter(bucket.isNotNull() & F.col(TAG_KEY).isNotNull() & F.col(TAG_DAY).isNotNull())
    return marked.groupBy(TAG_KEY, TAG_DAY).agg(
        F.count_if(bucket == k.BUCKET_LOW_AND_GROW).alias("lowngrow_tags"),
        F.count_if(bucket == k.BUCKET_STARTER).alias("starter_tags"),
    )


def counts_of_days(days: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    """``tag_counts`` from stored days; days may come in several rows."""
    recent = days.filter(F.col(TAG_DAY) >= anchors.days_ago(k.RECENT_DAYS))
    return recent.groupBy(TAG_KEY).agg(
        F.sum("lowngrow_tags").alias("lowngrow_tags"), F.sum("starter_tags").alias("starter_tags")
    )


def counts_of(sources: Sources, anchors: PeriodAnchors) -> DataFrame:
    """Recent tags per application, from stored days where the sources have them."""
    if sources.tag_days is not None:
        return counts_of_days(sources.tag_days, anchors)
    return tag_counts(sources.loan_application_metadata, anchors)


def _save(df: DataFrame, key: str, table: str, buckets: int, path: str | None, mode: str) -> None:
    """One file per bucket and write, as the rows are dealt by the hash that buckets use."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode(mode)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def store_applications(
    apps: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "errorifexists"
) -> None:
    """Applications as a catalog table in buckets of their id; ``append`` adds new ones."""
    most = apps.groupBy("id").count().filter(F.col("id").isNotNull()).agg(F.max("count")).first()[0]
    if most is not None and most > MOST_ROWS:
        raise HotApplication(f"{most} rows of one application")
    _save(apps, "id", table, buckets, path, mode)


def store_tags(
    tags: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "errorifexists"
) -> None:
    """The days of tags as a catalog table; ``append`` adds tags not stored before."""
    _save(tag_days(tags), TAG_KEY, table, buckets, path, mode)
