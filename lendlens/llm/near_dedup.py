"""MinHash near-deduplication with sequential Bayesian verification.

Texts with the same shingle set are one class, which is compared once. Classes that share a
band of their MinHash signature meet in a bucket. A bucket's pairs are not listed: all members
are compared with one hub, links found are closed to components, and only buckets that still
hold several components go on, with other hubs while those are many and at last with all pairs
across components. So no link between two components of a bucket is left out, and within a
component none is needed. Of pairs across components, those are left out whose odd sketches
(the parities of the shingles on each of 1024 bits) already differ in more bits than similar
sets could; that bound is exact.

A pair is compared in batches of 64 signature bits. After each batch it is dropped if the
posterior chance that its similarity reaches the threshold, under an even prior, is below
`MISS`; survivors are verified exactly on their full shingle sets.

Defined results: NULL, empty and wordless texts have no shingles and are linked with nothing,
not even with each other. Texts of fewer than five words are one shingle. Rows of equal text
are linked whatever their doc_id, also to none; rows that repeat a doc_id are judged each by its
own text. A component's id is its smallest doc_id, NULL if it has none, and `kept` tells whether
the row's doc_id is that. Rows of equal doc_id and text have the same verdict; where rows are to
be dropped, one of them stays (`kept_rows`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm import shingles
from lendlens.llm.batches import bounded
from lendlens.llm.components import components
from lendlens.llm.packing import Mask
from lendlens.llm.scratch import written

#: Link texts whose sets have a similarity of at least this percentage.
PERCENT = 85
BANDS, ROWS = 25, 5
BATCH, BATCHES = 64, 3
#: 64-bit words that tell which shingles two texts do not share.
ODD_WORDS = 16
#: Posterior chance of a link below which a pair is dropped.
MISS = 1e-7
#: Bits that tell which buckets are shared, and which texts are looked up, at most.
MASK_BITS = 27
#: While all pairs across components would take more than so many comparisons per row, other
#: hubs come first, in so many rounds at most. Both only order the work.
SPREAD = 1000
HUB_ROUNDS = 3

SIGNED = (
    "doc_id long, text_key long, text_hash long, n_shingles long, digest binary, leader long, "
    "bands array<long>, odd array<long>, s0 long, s1 long, s2 long"
)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors, offsets = shingles.multipliers(BATCH * BATCHES)
    band_factors, _ = shingles.multipliers(ROWS)
    names = np.arange(BANDS, dtype=np.uint64)
    bits = np.uint64(1) << np.arange(BATCH, dtype=np.uint64)
    for batch in batches:
        counts, digests, leaders, bands, odds, signs = [], [], [], [], [], [[], [], []]
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = shingles.shingle_set(text)
            counts.append(len(found))
            if not len(found):
                digests.append(None)
                for column in (leaders, bands, odds, *signs):
                    column.append(None)
                continue
            least = shingles.minima(found, factors, offsets)
            digests.append(shingles.digest(found))
            leaders.append(int.from_bytes(digests[-1][:8], "big", signed=True))
            rows = least[: BANDS * ROWS].reshape(BANDS, ROWS) * band_factors[:, 0]
            keys = shingles.mixed(rows.sum(axis=1, dtype=np.uint64) + names)
            bands.append(keys.view(np.int64))
            odds.append(shingles.odd_bits(found, ODD_WORDS))
            last = (shingles.mixed(least) & np.uint64(1)).reshape(BATCHES, BATCH)
            for column, value in zip(signs, (last * bits).sum(axis=1, dtype=np.uint64), strict=True):
                column.append(int(value.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                batch.column("text_hash"),
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(leaders, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(odds, pa.list_(pa.int64())),
                *(pa.array(column, pa.int64()) for column in signs),
            ],
            names=[field.split()[0] for field in SIGNED.split(", ")],
        )


@lru_cache
def least_matches(bits: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest equal bits of `bits` at which a link is still likelier than `miss`.

    A bit of two sets of similarity s is equal with the chance p = (1 + s) / 2, so an even
    prior of s is one of p over [1/2, 1], and the posterior is a cut beta distribution.
    """

    def above(p: float, equal: int) -> float:
        """P(X > p) for X ~ Beta(equal + 1, bits - equal + 1): a binomial sum."""
        n = bits + 1
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(equal + 1))

    bound = (1 + percent / 100) / 2
    return next(
        equal for equal in range(bits + 1) if above(bound, equal) >= miss * above(0.5, equal)
    )


def plausible(percent: int = PERCENT) -> Column:
    """The batches' verdict on a pair with columns n, s0.. and hub_n, hub_s0..; stops early."""
    small, large = F.least("n", "hub_n"), F.greatest("n", "hub_n")
    holds, equal = small * 100 >= large * percent, F.lit(0)
    for i in range(BATCHES):
        differ = F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"hub_s{i}")))
        equal = equal + (BATCH - differ)
        holds = holds & (equal >= least_matches(BATCH * (i + 1), percent))
    return holds


def _linked(percent: int):
    """Exact verification: whether the full sets of two texts are similar enough."""

    def check(one: pd.Series, other: pd.Series) -> pd.Series:
        of = lru_cache(maxsize=8)(lambda text: shingles.shingle_set(text.encode()))
        verdicts = []
        for a, b in zip(one, other, strict=True):
            common = len(np.intersect1d(of(a), of(b), assume_unique=True))
            union = len(of(a)) + len(of(b)) - common
            verdicts.append(100 * common >= percent * union)
        return pd.Series(verdicts, dtype=bool)

    return F.pandas_udf(check, "boolean")


MEMBER = ["digest", "n", "s0", "s1", "s2"]


def _as_hub(rows: DataFrame, *more: str) -> DataFrame:
    """The bucket, and the rest under names of a hub."""
    return rows.select("bucket", *(F.col(c).alias(f"hub_{c}") for c in (*MEMBER, *more)))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and what finds the row of a text again."""
    number, hashed = F.col(doc_id).cast("long"), F.xxhash64(text)
    return docs.select(
        number.alias("doc_id"),
        F.coalesce(number, hashed).alias("text_key"),
        hashed.alias("text_hash"),
        F.col(text).alias("text"),
    )


class _Search:
    """The links between classes of equal sets."""

    def __init__(self, docs: DataFrame, signs: DataFrame, percent: int):
        self.percent = percent
        alike = ("n_shingles", "leader", "bands", "odd", "s0", "s1", "s2")
        first = [F.first(c).alias(c) for c in alike]
        classes = (
            signs.filter(F.col("digest").isNotNull())
            .groupBy("digest")
            .agg(
                F.min("doc_id").alias("first_id"),
                F.min(F.struct("text_key", "text_hash")).alias("where"),
                *first,
            )
            .withColumnRenamed("n_shingles", "n")
        )
        self.classes = written(classes, "classes")
        self.banded = self._banded()
        wanted = written(self.banded.select("digest", "where.*").distinct(), "wanted")
        # Both sides grow with the corpus: one plan at every size. Texts that are surely not
        # wanted stay where they are.
        may_be = Mask(wanted, MASK_BITS, "text_hash").may_hold("text_hash")
        found = docs.filter("text_hash is not null").filter(may_be)
        texts = found.join(wanted.hint("merge"), ["text_key", "text_hash"])
        texts = texts.select("digest", "text")
        self.texts = written(texts, "texts")

    def _banded(self) -> DataFrame:
        """Every class in each of its buckets that holds another one."""
        rows = self.classes.select("where", "leader", *MEMBER, F.explode("bands").alias("bucket"))
        shared = rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("members"), F.min("leader").alias("first")
        )
        shared = written(shared.filter(F.col("members") > 1), "shared")
        may_be = Mask(shared, MASK_BITS, "bucket").may_hold("bucket")
        return written(rows.filter(may_be).join(shared, "bucket").drop("members"), "banded")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (digest, hub_digest) whose full sets are similar enough."""
        pairs = written(pairs.select("digest", "hub_digest").distinct(), "pairs", few=True)
        hubs = self.texts.select(F.col("digest").alias("hub_digest"), F.col("text").alias("hub_text"))
        both = pairs.join(self.texts, "digest").join(hubs, "hub_digest")
        links = both.filter(_linked(self.percent)("text", "hub_text"))
        return written(links.select(F.col("digest").alias("a"), F.col("hub_digest").alias("b")), "verified")

    def first_links(self) -> DataFrame:
        """Links of every member with the least class of its bucket."""
        hubs = _as_hub(self.banded.filter(F.col("leader") == F.col("first")))
        members = self.banded.filter(F.col("leader") != F.col("first"))
        pairs = members.join(written(hubs, "hubs", few=True), "bucket").filter(plausible(self.percent))
        return self._verified(pairs)

    def open_rows(self, roots: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with theirs and the largest."""
        named = roots.select(F.col("node").alias("digest"), "root")
        rows = self.banded.join(named, "digest", "left")
        rows = rows.withColumn("root", F.coalesce("root", "digest"))
        sizes = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
        buckets = (
            sizes.groupBy("bucket")
            .agg(
                F.sum("size").alias("members"),
                F.max(F.struct("size", "root")).alias("most"),
                F.count(F.lit(1)).alias("roots"),
            )
            .filter(F.col("roots") > 1)
            .select("bucket", "members", F.col("most.root").alias("most"))
        )
        rows = written(rows.join(written(buckets, "open", few=True), "bucket"), "open_rows")
        odd = self.classes.select("digest", "odd").hint("merge")
        return written(rows.join(odd, "digest"), "open_rows")

    def _reachable(self) -> Column:
        """Whether two classes of different components can be similar enough.

        The odd bits that differ are a lower bound of the shingles that only one has.
        """
        words = [
            F.bit_count(
                F.get(F.col("odd"), F.lit(i)).bitwiseXOR(F.get(F.col("hub_odd"), F.lit(i)))
            )
            for i in range(ODD_WORDS)
        ]
        apart, both = sum(words, F.lit(0)), F.col("n") + F.col("hub_n")
        near = apart * (100 + self.percent) <= both * (100 - self.percent)
        return (F.col("root") != F.col("hub_root")) & plausible(self.percent) & near

    def hub_links(self, rows: DataFrame, seed: int) -> DataFrame:
        """Links across components with one hub per bucket, another one for each seed."""
        rank = F.xxhash64(F.lit(seed), "bucket", "leader")
        least = rows.groupBy("bucket").agg(F.min(rank).alias("least"))
        ranked = rows.withColumn("rank", rank).join(written(least, "least", few=True), "bucket")
        hubs = ranked.filter(F.col("rank") == F.col("least"))
        hubs = written(_as_hub(hubs, "root", "odd"), "hubs", few=True)
        return self._verified(rows.join(hubs, "bucket").filter(self._reachable()))

    def all_links(self, rows: DataFrame) -> DataFrame:
        """Links across components, those of a bucket's largest one with all others."""
        others = rows.filter(F.col("root") != F.col("most"))
        hubs = written(_as_hub(others, "root", "odd"), "hubs", few=True)
        once = (F.col("root") == F.col("most")) | (F.col("digest") < F.col("hub_digest"))
        return self._verified(rows.join(hubs, "bucket").filter(once & self._reachable()))

    def roots(self) -> DataFrame:
        """(node, root) of every class that is linked with another one."""
        links = self.first_links()
        for seed in range(HUB_ROUNDS + 1):
            roots = components(links)
            rows = self.open_rows(roots)
            other = F.col("root") != F.col("most")
            found = rows.agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum(F.when(other, F.col("members"))).alias("compared"),
            ).first()
            if not found["rows"]:
                return roots
            if seed == HUB_ROUNDS or found["compared"] <= SPREAD * found["rows"]:
                break
            links = links.union(self.hub_links(rows, seed))
        return components(links.union(self.all_links(rows)))


def _named(
    docs: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and of every class (digest, first_id) the root of its component."""
    read = _keyed(bounded(docs), doc_id, text)
    signs = written(read.mapInArrow(_signed, SIGNED), "signed")
    search = _Search(read, signs, percent)
    roots = search.roots()
    named = search.classes.join(
        roots.select(F.col("node").alias("digest"), "root"), "digest", "left"
    ).select("digest", "first_id", F.coalesce("root", "digest").alias("root"))
    return signs, written(named, "named")


def deduplicated(
    docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    signs, named = _named(docs, percent, doc_id, text)
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    labels = named.join(written(least, "least"), "root").select("digest", "component")
    number = F.col("doc_id")
    return (
        signs.join(written(labels, "labels"), "digest", "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), number).otherwise(F.col("component")))
        .select("doc_id", "n_shingles", "component_id", number.eqNullSafe(F.col("component_id")).alias("kept"))
    )


def kept_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of every component, and all rows without shingles, with their own columns.

    Rows are told apart by doc_id and text. The row of the smallest doc_id stays, one without
    doc_id only where the component has none; of rows that agree in both, any one.
    """
    signs, named = _named(docs, percent)
    rows = (
        signs.filter(F.col("digest").isNotNull())
        .groupBy("digest", "doc_id", "text_hash")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(named.select("digest", "root"), "digest")
        .select(
            "root",
            F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash").alias("row"),
            "times",
        )
    )
    rows = written(rows, "rows")
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    judged = rows.join(written(first, "first"), "root")
    stays = F.col("row") == F.col("first")
    marked = judged.filter(~stays | (F.col("times") > 1)).select(
        F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"), stays.alias("_stays")
    )
    marked = written(marked, "marked")

    def same(marks: DataFrame):
        own_id = docs["doc_id"].cast("long").eqNullSafe(marks["_id"])
        return own_id & (F.xxhash64(docs["text"]) == marks["_hash"])

    repeated = marked.filter("_stays")
    once = docs.join(repeated, same(repeated)).dropDuplicates(["_id", "_hash"])
    others = docs.join(marked.hint("merge"), same(marked), "left_anti")
    return others.union(once.select(*(docs[name] for name in docs.columns)))
