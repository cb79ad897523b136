"""Benchmark decontamination by SimHash prints of item-sized windows.

Texts and items are cut into words (letters and digits, lower case) and five-word shingles. The
similarity of a window and an item is the weight of the shingles they share, with multiplicity,
over the weight of the item; a text holds an item if any window of the item's length, at any
start, reaches `SIMILARITY`. Weights are 1 to 4 by rarity among the items; shingles of no item
weigh nothing.

Prints have 128 bits. The k-th occurrence of a shingle in a window is a feature of its own, and
a bit is the sign of the features' projections, uniform values times the root of the weight.
Between an item and a window that lacks a share s of its weight, a bit then differs with chance
arccos(sqrt(1 - s)) / pi, whatever the weights are: 0.148 at similarity 0.8, so that more than
`RADIUS` bits differ with a chance of about 3e-4. Foreign shingles of other items of the length
add to that. Windows are those of every start, as running sums over the starts at which features
come and go, and those too light for every item of the length are left out.

Windows' and items' prints meet in multi-index blocks: of `BLOCKS` blocks, prints within the
radius differ in at most `ERRORS` bits in one of them, and the index holds every value that near,
so all fingerprints within the radius are found. The pairs of text and item they give are decided
exactly: a shingle's occurrence counts for the starts of the windows that hold it and fewer than
n earlier ones, n being its number in the item; these starts are an interval, and a running sum
over the ends of all intervals gives every window's similarity.

Everything is done once per distinct text.

Defined results: NULL and empty texts and those of fewer than five words match nothing, nor do
items of fewer than five words or without text. Items with equal text are all reported. Equal
texts get equal results, one row per row and item. A text shorter than an item is one window.
Items have fewer than 400,000 shingles: sums of more may leave their 32 bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.scratch import written

WIDTH = 5
SIMILARITY = 0.8
#: Bits of 128 in which prints may differ.
RADIUS = 32
#: Bits of each block; of eleven, one differs in at most 32 // 11 = 2 bits.
BLOCKS = (12,) * 7 + (11,) * 4
ERRORS = RADIUS // len(BLOCKS)
#: Two sums of 32 bits each in one long.
LANES = 64
HEAVIEST = 4
#: Items' shingles that are broadcast at a time.
PART = 2_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def shingles(text: Column) -> Column:
    """Hashes of every five successive words of a text."""

    def windows(words: Column) -> Column:
        return F.transform(
            F.slice(words, F.lit(WIDTH), F.size(words)),
            lambda last, i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH - 1)), last),
        )

    words = F.transform(F.split(F.lower(text), NOT_WORD), lambda word: F.xxhash64(word))
    # As a lambda's argument the words are computed once, however the plan is rewritten.
    return F.get(F.transform(F.array(words), windows), F.lit(0))


def shingled(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with an array `shingles` in place of the text, without those that have no text."""
    rows = rows.filter(F.col(text).isNotNull())
    return rows.withColumn("shingles", shingles(F.col(text))).drop(text)


class Items:
    """The benchmark: items by content, their shingles, weights and prints."""

    def __init__(
        self,
        benchmark: DataFrame,
        item_id: str = "item_id",
        text: str = "text",
    ):
        # Edges that are not words would be empty words.
        edges = rf"^{NOT_WORD}|{NOT_WORD}$"
        clean = benchmark.select(
            F.col(item_id).alias("item_id"), F.regexp_replace(text, edges, "").alias("text")
        ).filter(F.col("text") != "")
        contents = shingled(clean).filter(F.size("shingles") > 0)
        self.contents = written(contents.withColumn("item", F.xxhash64("shingles")), "items")
        rows = self.contents.dropDuplicates(["item"]).select(
            "item", F.size("shingles").alias("length"), F.explode("shingles").alias("shingle")
        )
        counted = rows.groupBy("item", "length", "shingle").agg(F.count(F.lit(1)).alias("n"))
        counted = written(counted, "item_shingles")
        among = counted.agg(F.count_distinct("item")).scalar()
        rare = F.log(1 + among / F.col("df")) / F.log(F.lit(1) + among)
        weights = counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
        weights = weights.select(
            "shingle",
            "df",
            F.greatest(F.lit(1), F.round(HEAVIEST * rare)).cast("int").alias("weight"),
        )
        counted = counted.join(weights.drop("df"), "shingle").withColumn(
            "total", F.sum(F.col("n") * F.col("weight")).over(Window.partitionBy("item"))
        )
        self.counted = written(counted, "counted")
        self.most = self.counted.agg(F.max("n")).first()[0]
        features = self.counted.groupBy("shingle", "length", "weight").agg(F.max("n").alias("n"))
        lightest = self.counted.groupBy("length").agg(F.min("total").alias("lightest"))
        self.features = written(features.join(lightest, "length"), "features")
        self.prints = written(self._prints(), "item_prints")
        # Looked up in parts of a bounded size; each part is a pass over the texts.
        found = self.counted.select("shingle").distinct()
        parts = max(1, -(-found.count() // PART))
        part = F.pmod(F.xxhash64("shingle"), F.lit(parts)).alias("part")
        kinds = written(found.select("shingle", part), "kinds")
        self.parts = [kinds.filter(F.col("part") == i).drop("part") for i in range(parts)]

    def _prints(self) -> DataFrame:
        """(item, length, print_0, print_1)."""
        each = self.counted.select(
            "item",
            "length",
            "shingle",
            "weight",
            F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"),
        )
        sums = each.groupBy("item", "length").agg(
            *(F.sum(lane).alias(f"lane_{i}") for i, lane in enumerate(_lanes()))
        )
        return sums.select("item", "length", *_print())


def _lanes() -> list[Column]:
    """Projections of the feature (shingle, k), two to a long, times the root of its weight."""
    root = F.round(10 * F.sqrt("weight")).cast("long")

    def projection(word: Column, at: int) -> Column:
        byte = F.shiftrightunsigned(word, at).bitwiseAND(F.lit(255))
        return (2 * byte - 255) * root

    words = [F.xxhash64("shingle", "k", F.lit(i)) for i in range(LANES // 4)]
    return [
        projection(word, at) + projection(word, at + 8) * F.lit(1 << 32)
        for word in words
        for at in range(0, 64, 16)
    ]


def _print() -> list[Column]:
    """The signs of the sums in the columns lane_0, lane_1 and so on."""

    def packed(bits: list[Column]) -> Column:
        each = [F.when(bit, F.shiftleft(F.lit(1).cast("long"), i)) for i, bit in enumerate(bits)]
        halves = [
            reduce(Column.bitwiseOR, (e.otherwise(F.lit(0).cast("long")) for e in each[i : i + 32]))
            for i in (0, 32)
        ]
        return halves[0].bitwiseOR(halves[1])

    lanes = [F.col(f"lane_{i}") for i in range(LANES)]
    low = [F.shiftright(F.shiftleft(lane, 32), 32) for lane in lanes]
    return [
        packed([one > 0 for one in low]).alias("print_0"),
        packed([lane - one > 0 for lane, one in zip(lanes, low)]).alias("print_1"),
    ]


def _blocks() -> Column:
    """(block, value) of every block of a print."""
    made, at = [], 0
    for i, bits in enumerate(BLOCKS):
        word, shift = divmod(at, 64)
        value = F.shiftrightunsigned(f"print_{word}", shift)
        if shift + bits > 64:
            value = value.bitwiseOR(F.shiftleft(f"print_{word + 1}", 64 - shift))
        value = value.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        made.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        at += bits
    return F.explode(F.array(*made))


def _masks(bits: int) -> list[int]:
    """Differences of at most `ERRORS` bits."""
    return [
        sum(1 << at for at in chosen)
        for n in range(ERRORS + 1)
        for chosen in combinations(range(bits), n)
    ]


def candidates(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(length, print_0, print_1, item): all fingerprints of a length within the radius.

    `prints` has columns length, print_0 and print_1, `items` also item.
    """
    masks = F.when(F.lit(False), F.array().cast("array<int>"))
    for bits in sorted(set(BLOCKS)):
        of = F.col("at.block").isin([i for i, b in enumerate(BLOCKS) if b == bits])
        masks = masks.when(of, F.array(*map(F.lit, _masks(bits))))
    names = ["length", "print_0", "print_1"]
    near = items.select("item", *names, _blocks().alias("at")).select(
        "item",
        "length",
        F.col("print_0").alias("item_0"),
        F.col("print_1").alias("item_1"),
        "at.block",
        "at.value",
        F.explode(masks).alias("mask"),
    )
    near = near.withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    probes = prints.select(*names).distinct().select(*names, _blocks().alias("at"))
    probes = probes.select(*names, "at.block", "at.value")
    differ = F.bit_count(F.col("print_0").bitwiseXOR(F.col("item_0"))) + F.bit_count(
        F.col("print_1").bitwiseXOR(F.col("item_1"))
    )
    found = probes.join(written(near, "near"), ["length", "block", "value"])
    return found.filter(differ <= RADIUS).select(*names, "item").distinct()


def _hits(texts: DataFrame, items: Items) -> DataFrame:
    """(text_hash, shingle, count, at): where every text has an item's shingle.

    `count` is the text's number of shingles.
    """
    # The outer form adds no filter, which would cut every text a second time.
    rows = texts.select(
        "text_hash",
        F.size("shingles").alias("count"),
        F.posexplode_outer("shingles").alias("pos", "shingle"),
    )
    found = [rows.join(F.broadcast(part), "shingle") for part in items.parts]
    # Equal texts have equal hits.
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("text_hash", "shingle")
        .agg(F.first("count").alias("count"), F.array_sort(F.collect_set("pos")).alias("at"))
    )


def _windows(hits: DataFrame, items: Items, similarity: float) -> DataFrame:
    """(text_hash, length, print_0, print_1): the windows heavy enough for an item of a length."""
    places = hits.select("text_hash", "shingle", "count", F.explode("at").alias("pos"))
    # A place and the ones before it that an item's copies of the shingle can reach.
    before = Window.partitionBy("text_hash", "shingle").orderBy("pos")
    before = before.rowsBetween(-(items.most or 0), Window.currentRow)
    places = places.withColumn("back", F.reverse(F.collect_list("pos").over(before)))
    upto = F.least(F.size("back"), F.col("n")).cast("int") - 1
    each = places.join(items.features, "shingle").withColumn(
        "k", F.explode(F.sequence(F.lit(0), upto))
    )
    # The starts of the windows in which the place is the k-th of its shingle.
    low = F.greatest(
        F.coalesce(F.get("back", F.col("k") + 1), F.lit(-1)) + 1,
        F.col("pos") - F.col("length") + 1,
        F.lit(0),
    )
    high = F.least(
        F.get("back", F.col("k")), F.greatest(F.col("count") - F.col("length"), F.lit(0))
    )
    each = each.withColumns({"low": low, "high": high}).filter("low <= high")
    ends = F.array(
        F.struct(F.col("low").alias("start"), F.lit(1).alias("sign")),
        F.struct((F.col("high") + 1).alias("start"), F.lit(-1).alias("sign")),
    )
    key = ["text_hash", "length"]
    changes = each.select(*key, "lightest", "shingle", "k", "weight", F.explode(ends).alias("end"))
    changes = changes.select(*key, "lightest", "shingle", "k", "weight", "end.*")
    # Moved before the projections are made, which are wide.
    lanes = [(F.col("sign") * lane).alias(f"change_{i}") for i, lane in enumerate(_lanes())]
    mass = (F.col("sign") * F.col("weight")).alias("change")
    changes = changes.repartition(*key).select(*key, "lightest", "start", mass, *lanes)
    along = Window.partitionBy(*key).orderBy("start")
    along = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = changes.select(
        *key,
        "lightest",
        F.sum("change").over(along).alias("mass"),
        *(F.sum(f"change_{i}").over(along).alias(f"lane_{i}") for i in range(LANES)),
    )
    # A little less than needed, so that rounding leaves none out.
    heavy = sums.filter(F.col("mass") >= (similarity - 1e-6) * F.col("lightest"))
    return heavy.select(*key, *_print()).distinct()


def _pairs(windows: DataFrame, items: Items) -> DataFrame:
    """(text_hash, item) of all texts with a window whose print is within the radius."""
    near = written(candidates(windows, items.prints), "candidates")
    return windows.join(near, ["length", "print_0", "print_1"]).select("text_hash", "item").distinct()


def _best_windows(pairs: DataFrame, hits: DataFrame, items: Items) -> DataFrame:
    """(text_hash, item, shared, start, length, total): the best window, the first of equals."""
    each = (
        pairs.join(hits, "text_hash")
        .join(items.counted, ["item", "shingle"])
        .select(
            "text_hash",
            "item",
            "length",
            "total",
            "weight",
            "count",
            # The n-th occurrence before this one; a window with both has enough without this.
            F.posexplode(
                F.transform(
                    "at",
                    lambda pos, i: F.struct(
                        pos.alias("pos"),
                        F.when(
                            i >= F.col("n"), F.get("at", (i - F.col("n")).cast("int"))
                        ).otherwise(-1).alias("full"),
                    ),
                )
            ).alias("i", "one"),
        )
    )
    last = F.greatest(F.col("count") - F.col("length"), F.lit(0))
    low = F.greatest(F.col("one.full") + 1, F.col("one.pos") - F.col("length") + 1, F.lit(0))
    high = F.least("one.pos", last)
    ends = F.array(
        F.struct(low.alias("start"), F.col("weight").alias("change")),
        F.struct((high + 1).alias("start"), (-F.col("weight")).alias("change")),
    )
    changes = (
        each.filter(low <= high)
        .select("text_hash", "item", "length", "total", F.explode(ends).alias("end"))
        .groupBy("text_hash", "item", "length", "total", "end.start")
        .agg(F.sum("end.change").alias("change"))
    )
    along = Window.partitionBy("text_hash", "item").orderBy("start")
    along = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        changes.withColumn("shared", F.sum("change").over(along))
        .groupBy("text_hash", "item", "length", "total")
        .agg(F.max(F.struct("shared", (-F.col("start")).alias("back"))).alias("best"))
        .select(
            "text_hash",
            "item",
            F.col("best.shared").alias("shared"),
            (-F.col("best.back")).alias("start"),
            "length",
            "total",
        )
    )


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(text_hash, item_id, similarity, start, size): the best window of each text and item.

    `docs` needs columns text_hash and text, see `keyed`.
    """
    items = Items(benchmark)
    hits = written(_hits(shingled(docs.select("text_hash", "text")), items), "hits")
    windows = written(_windows(hits, items, similarity), "windows")
    sure = _best_windows(_pairs(windows, items), hits, items)
    sure = sure.withColumn("similarity", F.col("shared") / F.col("total"))
    sure = written(sure.filter(F.col("similarity") >= similarity), "sure")
    size = (F.col("length") + WIDTH - 1).alias("size")
    best = F.struct("similarity", (-F.col("start")).alias("back"), size)
    return (
        sure.join(items.contents.select("item_id", "item"), "item")
        .groupBy("text_hash", "item_id")
        .agg(F.max(best).alias("best"))
        .select(
            "text_hash",
            "item_id",
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.back")).alias("start"),
            F.col("best.size").alias("size"),
        )
    )


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text and its hash."""
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start, size) of every text that holds a benchmark item.

    `start` and `size` are the best window's first word and number of words.
    """
    rows = keyed(docs)
    found = written(matches(rows, benchmark, similarity), "matches")
    return rows.select("doc_id", "text_hash").join(found, "text_hash").drop("text_hash")


def kept_rows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with their own columns, that hold no benchmark item."""
    found = written(matches(keyed(docs), benchmark, similarity), "matches")
    found = written(found.select(F.col("text_hash").alias("_leaked")).distinct(), "leaked")
    return docs.join(found, F.xxhash64(docs["text"]) == found["_leaked"], "left_anti")
