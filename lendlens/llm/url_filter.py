"""URL filtering: a blocked Bloom filter in front of an exact join.

The listed URLs are hashed into blocks of one 64-bit word; a URL sets `BITS` bits of its
block. A URL whose bits are all set is a possible hit, and only possible hits reach the join
on the canonical URL, which removes false positives. Both steps are equality joins, so either
side may be of any size.

Defined results: a NULL URL, or one without `://`, has an empty host and path, fits no rule
and is allowed. Equal URLs get equal verdicts, one row per input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.scratch import written

#: Bits that a URL sets in its block, and bits of filter per listed URL.
BITS = 5
BITS_PER_URL = 16
WORD_BITS = 64

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path).
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
#: Parameters that name a visit, not a page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` or `m.`, path without a last slash, query without tracking."""
    found = F.regexp_replace(host(url), r"^(?:www|m)\.", "")
    shown = F.regexp_replace(path(url), r"/+$", "")
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    asked = F.regexp_replace(asked, rf"(^|&){TRACKING}=[^&]*", "$1")
    asked = F.regexp_replace(F.regexp_replace(asked, r"&+", "&"), r"^&|&$", "")
    return F.concat(found, shown, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def rule(found: Column, shown: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); NULL where none does."""
    fitting = None
    for verdict, on, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((found == on) | found.endswith(f".{on}")) & shown.startswith(start)
        said = F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, said) if fitting is None else fitting.when(fits, said)
    return fitting


def _block(of: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), of), F.lit(blocks))


def _mask(of: Column) -> Column:
    """`BITS` positions of six bits each from one hash."""
    hashed = F.xxhash64(F.lit("bits"), of)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        at = F.shiftright(hashed, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of every block that holds a listed URL; `listed` has a column `url_key`."""
    key = F.col("url_key")
    return (
        listed.select(_block(key, blocks).alias("block"), _mask(key).alias("mask"))
        .groupBy("block")
        .agg(F.bit_or("mask").alias("word"))
    )


def possible(keys: DataFrame, filters: DataFrame, blocks: int) -> DataFrame:
    """The rows of `keys`, which have a column `url_key`, that pass the filter."""
    mask = _mask(F.col("url_key"))
    return (
        keys.withColumn("block", _block(F.col("url_key"), blocks))
        .join(filters, "block")
        .filter(F.col("word").bitwiseAND(mask) == mask)
        .select(*keys.columns)
    )


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) of every page.

    `listed` holds canonical URLs in a column `url_key`, in any number and with repeats.
    """
    listed = written(listed.select("url_key").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // WORD_BITS))
    filters = written(bloom(listed, blocks), "bloom")
    keys = pages.select(canonical(F.col(url)).alias("url_key")).distinct()
    hits = written(possible(keys, filters, blocks).join(listed, "url_key", "left_semi"), "hits")
    read = pages.select(
        "page_id",
        host(F.col(url)).alias("host"),
        path(F.col(url)).alias("path"),
        canonical(F.col(url)).alias("canonical"),
    )
    hits = hits.select(F.col("url_key").alias("canonical"), F.lit(True).alias("hit"))
    said = rule(F.col("host"), F.col("path"), rules)
    return (
        read.join(hits, "canonical", "left")
        .withColumn("listed", F.coalesce("hit", F.lit(False)))
        .withColumn("said", said)
        .select(
            "page_id",
            "host",
            "path",
            F.col("said.rule").alias("rule"),
            F.coalesce(
                F.col("said.verdict"),
                F.when(F.col("listed"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)),
            ).alias("verdict"),
            "canonical",
            "listed",
        )
    )
