"""Joins of applications to their tags.

A join that repeats an application once per matching tag is kept as one row with a
``copies`` count. Tags are counted per application first (with map-side combine), so
the join adds at most one row per application, or one per repeat bucket, however
many tags an application carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens import constants as k
from lendlens.functions import classify
from lendlens.functions.anchors import PeriodAnchors
from lendlens.operators import filters

TAG_KEY = "loan_application_id_ref"
SHARDS = 1024


def tag_counts(tags: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    """Recent LowNGrow and Starter tags per application, from one scan.

    A shard, itself a function of the key, is among the grouping keys. So the join has a
    shuffle of its own over the (compact) counts, which the adaptive skew join needs to
    split the rows of a hot application: it does not look through an aggregate.
    """
    recent = filters.lookback_60d(tags, anchors)
    bucket = F.col("tag_bucket")
    return (
        recent.select(TAG_KEY, classify.tag_bucket().alias("tag_bucket"))
        .filter(bucket.isNotNull() & F.col(TAG_KEY).isNotNull())
        .groupBy(TAG_KEY, F.pmod(F.hash(TAG_KEY), F.lit(SHARDS)).alias("shard"))
        .agg(
            F.count_if(bucket == k.BUCKET_LOW_AND_GROW).alias("lowngrow_tags"),
            F.count_if(bucket == k.BUCKET_STARTER).alias("starter_tags"),
        )
        .drop("shard")
    )


def _join(apps: DataFrame, counts: DataFrame) -> DataFrame:
    joined = apps.join(counts, F.col("id") == F.col(TAG_KEY), "left").drop(TAG_KEY)
    return joined.fillna(0, ["lowngrow_tags", "starter_tags"])


def _matched(tags: str) -> Column:
    return F.when(F.col(tags) > 0, F.col("id"))


def _rows(tags: str) -> Column:
    """Rows a left join makes of an application with this many matches."""
    return F.greatest(F.col(tags), F.lit(1).cast("long"))


def left_tag_flag(apps: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join to the LowNGrow tags: ``lowngrow_id`` and ``copies``."""
    return _join(apps, counts).select(
        *apps.columns,
        _matched("lowngrow_tags").alias("lowngrow_id"),
        _rows("lowngrow_tags").alias("copies"),
    )


def left_two_tag_flags(apps: DataFrame, counts: DataFrame) -> DataFrame:
    """Left joins to both tag groups: m and n matches make max(m,1) * max(n,1) rows."""
    return _join(apps, counts).select(
        *apps.columns,
        _matched("lowngrow_tags").alias("lowngrow_id"),
        _matched("starter_tags").alias("starter_id"),
        (_rows("lowngrow_tags") * _rows("starter_tags")).alias("copies"),
    )


def left_tag_bucket(apps: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join to the classified tags: a row per bucket the application is tagged with."""
    low, starter = F.col("lowngrow_tags"), F.col("starter_tags")

    def match(label: Column, copies: Column) -> Column:
        return F.struct(label.alias("tag_bucket"), copies.alias("copies"))

    matches = F.array_compact(
        F.array(
            F.when(low > 0, match(F.lit(k.BUCKET_LOW_AND_GROW), low)),
            F.when(starter > 0, match(F.lit(k.BUCKET_STARTER), starter)),
            F.when(
                (low == 0) & (starter == 0),
                match(F.lit(None).cast("string"), F.lit(1).cast("long")),
            ),
        )
    )
    return (
        _join(apps, counts)
        .select(*apps.columns, F.explode(matches).alias("match"))
        .select(*apps.columns, "match.tag_bucket", "match.copies")
    )


def recent_branches(apps: DataFrame, anchors: PeriodAnchors) -> DataFrame:
    """Created-recently and disbursed-recently applications, kept by both branches.

    An application that meets both bounds counts twice; ``branches`` says how often,
    in one scan instead of a union of two.
    """
    created = F.coalesce(filters.created_recently(anchors), F.lit(False)).cast("long")
    disbursed = F.coalesce(filters.disbursed_recently(anchors), F.lit(False)).cast("long")
    return filters.either_date_60d(apps, anchors).withColumn("branches", created + disbursed)
