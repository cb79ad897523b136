"""SimHash near-deduplication by deletion variants of two halves.

A fingerprint has 64 bits, one per bit of the XXH64 hashes of a text's three-word shingles: 1 if
more than half of them, repeats included, have a 1. Fingerprints link at two or fewer differing
bits. Cut into two halves, of two such fingerprints one half differs in one bit at most. So every
half is indexed under its 32 variants, each with one bit deleted; fingerprints that link share a
variant, and an equality join finds them. Equal halves share all variants, of which the first
alone counts, and a variant whose members all have the same deleted bit is left to that one.

Each distinct fingerprint is indexed once, whatever the number of its texts. Members of a variant
are compared with one another while there are `FEW` of them at most. Members of a larger one are
not: there the other half has its bits deleted too (one more, or two where the first halves are
equal), after which at most four fingerprints agree, and they link. That finds every link at a
cost in proportion to the members. Components of the links are found by contraction.

Defined results: texts without words, NULL among them, have fingerprint zero, which is linked
like any other; fewer than three words are one shingle. Rows are documents of their own even
where they repeat a doc_id; component_id is the smallest doc_id of the component, NULL where it
has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.components import components
from lendlens.llm.scratch import written

WIDTH = 3
SEED = 42
HALF = 32
#: Largest number of differing bits of a link; the variants are made for this one.
RADIUS = 2
#: Members of a variant that are compared pair by pair.
FEW = 128
#: Shingles whose bits are counted at a time.
CHUNK = 65_536

SIGNED = "doc_id long, print long"


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text, unsigned."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(WIDTH, len(words))
    long = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(long + 1) - 1
    starts = (ends - long)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[start:end], SEED) for start, end in spans]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        made = np.array([fingerprint(text) for text in texts], np.uint64).view(np.int64)
        columns = [batch.column("doc_id"), pa.array(made, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) of every row; the print as a signed long."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(_signed, SIGNED)


def _half(of: Column, which: Column) -> Column:
    """The lower half of a print, or its upper one, as a number of 32 bits."""
    chosen = F.when(which == 0, of).otherwise(F.shiftrightunsigned(of, HALF))
    return chosen.bitwiseAND(F.lit(2**HALF - 1))


def _bit(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def variants(prints: DataFrame) -> DataFrame:
    """(variant, which, deleted, bit, print): every half with every bit deleted."""
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("which")
    deleted = F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("deleted")
    rows = prints.select("print", half).select("print", "which", deleted)
    part = _half(F.col("print"), F.col("which"))
    rest = part.bitwiseAND(F.bitwise_not(_bit("deleted")))
    name = F.col("which") * HALF + F.col("deleted")
    key = F.call_function("shiftleft", name.cast("long"), F.lit(HALF)).bitwiseOR(rest)
    bit = (part.bitwiseAND(_bit("deleted")) != 0).cast("int")
    return rows.select(key.alias("variant"), "which", "deleted", bit.alias("bit"), "print")


def shared(rows: DataFrame) -> DataFrame:
    """(variant, members) of the variants that can hold a link found under no earlier one."""
    sizes = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("members"), F.min("bit").alias("low"), F.max("bit").alias("high")
    )
    deleted = F.shiftright("variant", HALF) % HALF  # as part of its name
    several = (deleted == 0) | (F.col("low") != F.col("high"))
    return sizes.filter((F.col("members") > 1) & several).select("variant", "members")


def _differ() -> Column:
    return F.col("a").bitwiseXOR(F.col("b"))


def close_pairs(rows: DataFrame) -> DataFrame:
    """Links (a, b) within small variants; equal halves count under the first alone."""
    named = rows.select("variant", "which", "deleted", F.col("bit"), F.col("print").alias("a"))
    other = rows.select("variant", F.col("bit").alias("other_bit"), F.col("print").alias("b"))
    new = (F.col("deleted") == 0) | (F.col("bit") != F.col("other_bit"))
    pairs = named.join(other, "variant").filter((F.col("a") < F.col("b")) & new)
    return pairs.filter(F.bit_count(_differ()) <= RADIUS).select("a", "b")


def twice_deleted(rows: DataFrame) -> DataFrame:
    """Links (a, b) within large variants, by deleting bits of the other half too.

    Where one bit of each half is deleted, two prints that agree differ in these at most. Two
    bits of the other half are deleted where the halves are equal, once for each half, that is
    under the first variant with the deleted bit as part of the key.
    """
    every = F.sequence(F.lit(0), F.lit(HALF - 1))
    one = F.transform(every, lambda i: _bit(i))
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(HALF - 2)),
            lambda i: F.transform(
                F.sequence(i + 1, F.lit(HALF - 1)), lambda j: _bit(i).bitwiseOR(_bit(j))
            ),
        )
    )
    own, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = F.transform(one, lambda gone: F.struct(gone.alias("gone"), none.alias("kept")))
    double = F.transform(
        two, lambda gone: F.struct(gone.alias("gone"), (own + F.col("bit")).alias("kept"))
    )
    gone = F.when(F.col("deleted") == 0, F.concat(single, double)).otherwise(single)
    other = _half(F.col("print"), 1 - F.col("which"))
    cut = rows.withColumn("other", other).select(
        "variant", "print", "other", F.explode(gone).alias("by")
    )
    rest = F.col("other").bitwiseAND(F.bitwise_not(F.col("by.gone")))
    keyed = cut.select(
        "variant",
        F.col("by.gone").alias("gone"),
        F.col("by.kept").alias("kept"),
        rest.alias("rest"),
        "print",
    )
    # At most four prints agree in all bits but two, so the sets are small.
    groups = keyed.groupBy("variant", "gone", "kept", "rest").agg(
        F.min("print").alias("a"), F.collect_set("print").alias("members")
    )
    groups = groups.filter(F.size("members") > 1)
    return groups.select("a", F.explode("members").alias("b")).filter("a != b")


def links(prints: DataFrame, few: int = FEW) -> DataFrame:
    """Pairs (a, b) of distinct prints that connect all whose bits differ in two at most."""
    rows = variants(prints)
    found = written(shared(rows), "shared", few=True)
    open_rows = written(rows.join(found, "variant"), "open", few=True)
    near = close_pairs(open_rows.filter(F.col("members") <= few))
    made = near.union(twice_deleted(open_rows.filter(F.col("members") > few)))
    return written(made.distinct(), "links", few=True)


def clustered(
    docs: DataFrame, few: int = FEW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    signs = written(fingerprints(docs, doc_id, text), "signs")
    prints = written(signs.groupBy("print").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(links(prints.select("print"), few))
    roots = roots.select(F.col("node").alias("print"), "root")
    named = prints.join(roots, "print", "left")
    named = written(named.withColumn("root", F.coalesce("root", "print")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "root").select("print", "component_id")
    return signs.join(labels, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
