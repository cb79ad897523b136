"""Mixing sources to target weights by temperature.

A source's weight is its share of all words raised to an exponent and normalised. The exponent
is the nearest to 1 that meets the targets: entropy of the weights at least `ENTROPY` of the
most possible, unless a source would then be repeated more than `REPEATS` times as often as
the least repeated one; then it is the one at which that limit is met. It is found by cutting
an interval into `PARTS` parts again and again, each time with one aggregate over the sources'
totals, which stay distributed.

The weights are realised as whole passes over each source and a part of one more. The budget is
by default the smallest at which every document is used once. A source's documents are hashed
into blocks of about `BLOCK_WORDS` words; each pass takes the blocks in a permutation of its
own, and the last one ends with the document that reaches the budget. Blocks are split by hash
and their words are summed before any of them is put in order, so no task holds a source.

Defined results: a NULL source is a source of its own; NULL and wordless texts have no words,
count as used and are taken in full passes only; if no text has a word every document is used
once. Rows of equal doc_id and text are taken together. The rows are carried whole, so further
columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.scratch import written
from lendlens.llm.words import WORD

#: Target entropy, as a share of the entropy of equal weights.
ENTROPY = 0.97
#: Most passes over a source for one over the least repeated source.
REPEATS = 2.0
BLOCK_WORDS = 1_000_000
PARTS = 32
PRECISION = 1e-9
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _measured(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy of its weights, most passes for one of the least repeated source)."""
    a = F.col("a")
    part = F.pow("share", a)
    rows = (
        totals.withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
        .groupBy("a")
        .agg(
            F.sum(part).alias("z"),
            F.sum(part * a * F.log("share")).alias("y"),
            F.max(F.pow("share", a - 1)).alias("most"),
            F.min(F.pow("share", a - 1)).alias("least"),
        )
        .collect()
    )
    return sorted((r["a"], math.log(r["z"]) - r["y"] / r["z"], r["most"] / r["least"]) for r in rows)


def exponent(
    totals: DataFrame, sources: int, entropy: float = ENTROPY, repeats: float = REPEATS
) -> float:
    """The exponent for `totals`, which has a column `share` per source.

    As the exponent falls from 1 to 0 the entropy and the repetition only grow.
    """
    target = entropy * math.log(sources)

    def cut(low: float, high: float, meets) -> float:
        """Where `meets` ends, from one end of the interval to the other."""
        while high - low > PRECISION:
            step = (high - low) / PARTS
            found = _measured(totals, [low + i * step for i in range(PARTS + 1)])
            past = next((i for i, row in enumerate(found) if not meets(row)), PARTS)
            low, high = found[max(past - 1, 0)][0], found[max(past, 1)][0]
        return (low + high) / 2

    flat, plain = _measured(totals, [0.0, 1.0])
    if plain[1] >= target:
        return 1.0
    even = 0.0 if flat[1] <= target else cut(0.0, 1.0, lambda row: row[1] >= target)
    if _measured(totals, [even])[0][2] <= repeats:
        return even
    return cut(0.0, 1.0, lambda row: row[2] > repeats)


def weighted(
    totals: DataFrame, entropy: float, repeats: float, budget: float | None
) -> tuple[DataFrame, float]:
    """(of_source, words, weight, passes) of the sources that have words; the exponent."""
    some = totals.filter(F.col("words") > 0)
    row = some.agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("all")).first()
    if not row["n"]:
        return some.withColumns({"weight": F.lit(0.0), "passes": F.lit(1.0)}), 1.0
    some = written(some.withColumn("share", F.col("words") / F.lit(float(row["all"]))), "shares")
    found = exponent(some, row["n"], entropy, repeats)
    z, least = some.agg(
        F.sum(F.pow("share", F.lit(found))), F.min(F.pow("share", F.lit(found - 1)))
    ).first()
    words = budget if budget is not None else row["all"] * z / least
    weight = F.pow("share", F.lit(found)) / z
    passes = F.round(weight * words / F.col("words"), 9)
    return some.select("of_source", "words", weight.alias("weight"), passes.alias("passes")), found


def mixed(
    docs: DataFrame,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    budget: float | None = None,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """(_row, n_words, weight, pass, block, place): every use of every row of `docs`.

    `place` in [0, 1) orders the blocks of the whole mixture, passes of a source in turn;
    `_row` is the row itself.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("NULL"))
    rows = docs.select(
        F.struct("*").alias("_row"),
        named.alias("of_source"),
        n_words(F.col(text)).alias("n_words"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"),
    )
    # Only numbers are stored; the texts are read again at the end.
    numbers = written(rows.select("of_source", "n_words", "h"), "numbers")
    totals = written(
        numbers.groupBy("of_source").agg(
            F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("rows")
        ),
        "totals",
    )
    weights, _ = weighted(totals, entropy, repeats, budget)
    plan = totals.join(weights.drop("words"), "of_source", "left").select(
        "of_source",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("passes", F.lit(1.0)).alias("passes"),
        F.greatest(F.lit(1), F.ceil(F.col("words") / BLOCK_WORDS)).alias("blocks"),
        "words",
    )
    plan = written(plan, "plan")
    block = F.pmod(F.col("h"), F.col("blocks")).alias("block")
    ends = _last_pass(numbers, plan, block, seed)

    full = F.floor("passes").cast("int")
    once_more = F.col("reached") & (F.col("h") <= F.coalesce("cutoff", F.col("h")))
    once_more = F.coalesce(once_more & (F.col("n_words") > 0), F.lit(False)).cast("int")
    used = (
        rows.join(plan, "of_source")
        .select("_row", "n_words", "weight", "h", block, "of_source", full.alias("full"), "passes")
        .join(ends, ["of_source", "block"], "left")
        .withColumn("uses", F.col("full") + once_more)
        .filter(F.col("uses") > 0)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    )
    return used.select(
        "_row",
        "n_words",
        "weight",
        "pass",
        "block",
        ((F.col("pass") + _shuffled(seed)) / F.ceil("passes")).alias("place"),
    )


def _shuffled(seed: int, number: Column | None = None) -> Column:
    """Where a block stands in a pass's permutation, in [0, 1)."""
    number = F.col("pass") if number is None else number
    drawn = F.xxhash64(F.lit(seed), F.lit("block"), "of_source", "block", number)
    return F.pmod(drawn, F.lit(1 << 52)) / float(1 << 52)


def _last_pass(numbers: DataFrame, plan: DataFrame, block: Column, seed: int) -> DataFrame:
    """(of_source, block, reached, cutoff) of the blocks in each source's last, partial pass.

    The block in which the budget ends has the largest row hash that still belongs to it.
    """
    partial = plan.withColumn("left", F.col("words") * (F.col("passes") - F.floor("passes")))
    partial = written(
        partial.filter(F.col("left") > 0).withColumn("pass", F.floor("passes")), "partial"
    )
    rows = numbers.filter(F.col("n_words") > 0).join(partial, "of_source")
    rows = rows.select("of_source", "n_words", "h", block, "pass", "left")
    held = rows.groupBy("of_source", "block", "pass", "left").agg(F.sum("n_words").alias("held"))
    order = Window.partitionBy("of_source").orderBy(_shuffled(seed), "block")
    before = F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = held.withColumn("before", F.coalesce(before, F.lit(0)))
    blocks = blocks.filter(F.col("before") < F.col("left"))
    blocks = written(blocks.select("of_source", "block", "before", "held", "left"), "blocks")
    is_last = F.col("before") + F.col("held") > F.col("left")
    # One block of each source ends the pass: its rows are put in order.
    last = blocks.filter(is_last).drop("held")
    cut = rows.drop("left").join(last, ["of_source", "block"])
    inside = Window.partitionBy("of_source", "block").orderBy("h")
    so_far = F.sum("n_words").over(inside.rangeBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("at", F.col("before") + F.coalesce(so_far, F.lit(0)))
    cut = cut.filter(F.col("at") < F.col("left"))
    cutoff = written(cut.groupBy("of_source", "block").agg(F.max("h").alias("cutoff")), "cutoff")
    ends = blocks.join(cutoff, ["of_source", "block"], "left")
    return written(ends.select("of_source", "block", F.lit(True).alias("reached"), "cutoff"), "ends")


def uses(docs: DataFrame, **targets) -> DataFrame:
    """doc_id, source, n_words, weight, pass, block and place of every use of a document."""
    return mixed(docs, **targets).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_row.source").alias("source"),
        "n_words",
        "weight",
        "pass",
        "block",
        "place",
    )


def mixed_rows(docs: DataFrame, **targets) -> DataFrame:
    """The rows of `docs`, with their own columns, once per use."""
    return mixed(docs, **targets).select("_row.*")
