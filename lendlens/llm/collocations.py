"""Phrase collocations from a weighted de Bruijn graph of word n-grams, per language.

Every word of a piece starts one longest gram: of `LONGEST` words, or of what is left of its
piece. The former are the edges of the graph, counted; an edge leads from the node of its first
words to the node of its last ones. The latter are the corrections at the ends of pieces. What
flows through a node, that is its count, is the sum over the edges that leave it plus the pieces
that end with it; and in the same way the counts of all shorter grams follow level by level,
without another pass over texts. A node whose whole flow comes by one edge, or leaves by one,
lies on a unary path and is compacted into that edge: as a phrase of its own it says nothing more.

Only what can be part of a phrase counted `LEAST` times needs to be in the graph. Passes before it
count words, pairs and triples of them, each among those whose parts are often enough; a word's
longest gram then also ends before a pair or triple counted less often, and rarer words start
none. These passes count 32-bit keys, which tasks send as packed lists by range of keys, and the
keys that are often enough are sent to all tasks as one bit each of a mask of fixed size. Keys
that agree, or share a bit, only make a gram longer than it need be, so counts do not depend on
them; phrases themselves are counted as text.

Defined results: NULL and empty texts have no words, a NULL language is `und`. Repeated rows
count as often as they are there; doc_id and other columns are not looked at. Scores are whole
numbers, computed in decimals of 38 digits. Phrases of equal score and count are ranked by bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.packing import Mask, packed, unpacked
from lendlens.llm.scratch import written
from lendlens.llm.shingles import mixed, runs, span_hashes

LONGEST = 5
#: Occurrences that a phrase needs, and how many phrases of a language are listed.
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: The first places of a language are chosen in so many parts, then among those.
PARTS = 256

#: Passes that tell what can be part of a phrase: words, pairs, triples.
PASSES = 3
#: Tasks that cut out longest grams, at most; each has one table of them.
TASKS_PER_CORE = 2

#: Keys have so many bits; those that agree in the upper ones are counted in one task.
KEY_BITS, RANGE_BITS = 32, 20

LISTS = "part int, listed binary"
KEYS = "key long"
GRAMS = "lang string, k int, gram string, n long"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CUTS = re.compile(rb"[.,;:!?\x0A-\x0D]")
_WORD, _SPACE, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.int8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _CUT


@dataclass(frozen=True)
class Sizes:
    """What bounds the memory of a task; results do not depend on it."""

    #: A mask has 2^mask_bits bits and is sent to every task.
    mask_bits: int = 27
    #: Bytes of text that are cut into words together.
    chunk_bytes: int = 1 << 20
    #: Bytes of text whose longest grams, and keys that, are counted together.
    block_bytes: int = 1 << 22
    block_keys: int = 1 << 22
    #: Different grams of several blocks that a task holds before it sends them on.
    table_grams: int = 1 << 19


class Chunk:
    """The words of some texts, with a key for each word of a language."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.buffer = b"\n".join(texts).lower()  # a line break parts pieces; ASCII letters only
        data = np.frombuffer(self.buffer, np.uint8)
        kind = _KIND[data]
        self.starts, self.ends = runs(kind == _WORD)
        piece = np.cumsum(kind == _CUT, dtype=np.int64)[self.starts]
        #: Whether a word and the next one are neighbours in a piece.
        self.joined = piece[1:] == piece[:-1]
        first = np.cumsum([0] + [len(text) + 1 for text in texts[:-1]])
        self.text = np.searchsorted(first, self.starts, side="right") - 1
        self.langs = langs
        seeds = np.array([seed(lang) for lang in langs], np.uint64)
        self.keys = mixed(span_hashes(data, self.starts, self.ends) + seeds[self.text])

    def grams(self, at: np.ndarray, long: np.ndarray | int) -> np.ndarray:
        """The keys of the grams of some words, `long` each, that start at `at`."""
        long = np.broadcast_to(long, at.shape)
        made = self.keys[at].copy()
        for step in range(1, int(long.max(initial=1))):
            more = np.flatnonzero(long > step)
            made[more] = made[more] * _BASE + self.keys[at[more] + step]
        return mixed(made + long.astype(np.uint64))


def short(keys: np.ndarray) -> np.ndarray:
    """The bits of keys that are counted."""
    return keys >> np.uint64(64 - KEY_BITS)


def seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def parts(text: bytes, chunk_bytes: int) -> Iterator[bytes]:
    """A text, a long one in parts that end where a piece ends."""
    at = 0
    while len(text) - at > chunk_bytes:
        found = _CUTS.search(text, at + chunk_bytes)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    if at < len(text):
        yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[Chunk]:
    texts, langs, size = [], [], 0
    for batch in batches:
        of = batch.column("lang").to_pylist()
        for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), of, strict=True):
            for part in parts(text or b"", chunk_bytes):
                texts.append(part)
                langs.append(UNKNOWN if lang is None else lang)
                size += len(part)
                if size >= chunk_bytes:
                    yield Chunk(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Chunk(texts, langs)


def _candidates(chunk: Chunk, masks: list[Mask]) -> list[np.ndarray]:
    """For 1, 2, ... words: whether the gram at a word may be frequent by all its parts.

    The last one, of a word more than there are masks, is told by its parts alone.
    """
    found = [np.ones(len(chunk.keys), bool)]
    for words, mask in enumerate(masks, 1):
        at = np.flatnonzero(found[-1])
        found[-1][at] = mask.holds(short(chunk.grams(at, words)))
        longer = np.zeros(len(chunk.keys), bool)
        longer[:-1] = found[-1][:-1] & found[-1][1:]
        if words == 1:
            longer[:-1] &= chunk.joined
        found.append(longer)
    return found


def _lists(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys and how often each is there, packed by range of keys."""
    found, counts = np.unique(keys, return_counts=True)
    parts = found >> np.uint64(RANGE_BITS)
    edges = np.flatnonzero(np.diff(parts, prepend=-1).astype(bool)).tolist()
    names, lists = [], []
    for start, end in zip(edges, [*edges[1:], len(found)], strict=True):
        steps = np.diff(found[start:end] & np.uint64(2**RANGE_BITS - 1), prepend=np.uint64(0))
        names.append(int(parts[start]))
        lists.append(packed(np.concatenate([steps, counts[start:end].astype(np.uint64)])))
    columns = [pa.array(names, pa.int32()), pa.array(lists, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "listed"])


def _tally(masks: list[Mask], sizes: Sizes):
    """Lists of the keys of the grams that may be frequent, by blocks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for chunk in _chunks(batches, sizes.chunk_bytes):
            at = np.flatnonzero(_candidates(chunk, masks)[-1])
            keys = chunk.grams(at, len(masks) + 1)
            found.append(short(keys))
            size += len(at)
            if size >= sizes.block_keys:
                yield from _lists(np.concatenate(found))
                found, size = [], 0
        if size:
            yield from _lists(np.concatenate(found))

    return made


def _often(least: int):
    """Keys counted at least `least` times, from lists in the order of their ranges."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, current, seen, size = np.zeros(2**RANGE_BITS, np.int64), None, [], 0

        def frequent() -> pa.RecordBatch:
            """The keys of the range that ends, whose counts are set back."""
            few = size < 2**RANGE_BITS
            at = np.unique(np.concatenate(seen)) if few else np.arange(2**RANGE_BITS)
            often = at[counts[at] >= least]
            counts[at] = 0
            return pa.RecordBatch.from_arrays(
                [pa.array((current << RANGE_BITS) + often)], names=["key"]
            )

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)
            for part, listed in rows:
                if part != current:
                    if seen:
                        yield frequent()
                    current, seen, size = part, [], 0
                steps, times = np.split(unpacked(listed), 2)
                at = np.cumsum(steps, dtype=np.int64)
                counts[at] += times
                if size < 2**RANGE_BITS:
                    seen.append(at)
                size += len(at)
        if seen:
            yield frequent()

    return made


def _frequent(texts: DataFrame, masks: list[Mask], least: int, sizes: Sizes) -> Mask:
    lists = texts.mapInArrow(_tally(masks, sizes), LISTS)
    in_order = lists.repartition("part").sortWithinPartitions("part")
    return Mask(in_order.mapInArrow(_often(least), KEYS), sizes.mask_bits)


class _Grams:
    """The longest grams that start in some chunks, each once, with its count and its text."""

    def __init__(self, masks: list[Mask], longest: int):
        self.masks, self.longest = masks, longest
        self.chunks: list[tuple[Chunk, np.ndarray, np.ndarray]] = []
        self.waiting: list[np.ndarray] = []
        self.size = 0
        #: Keys in order, and where in the lists the gram of each is.
        self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.langs: list[str] = []
        self.ks: list[int] = []
        self.grams: list[str] = []

    def add(self, chunk: Chunk) -> None:
        found = _candidates(chunk, self.masks)
        at = np.flatnonzero(found[0])
        long = sum(own[at].astype(np.int64) for own in found)
        place = found[-1]
        for _ in range(len(found), self.longest):
            # Of two grams one word apart that may be frequent, one a word longer.
            place = place & np.append(place[1:], False)
            long += place[at]
        long = np.minimum(long, self.longest)
        self.waiting.append(chunk.grams(at, long))
        self.chunks.append((chunk, at.astype(np.int32), long.astype(np.int8)))
        self.size += len(chunk.buffer)

    def count(self) -> None:
        """Counts what the chunks hold; only grams not met before are cut out of the texts."""
        keys, first, counts = np.unique(
            np.concatenate(self.waiting), return_index=True, return_counts=True
        )
        near = np.searchsorted(self.keys, keys)
        known = near < len(self.keys)
        known[known] = self.keys[near[known]] == keys[known]
        self.counts[self.places[near[known]]] += counts[known]
        first = first[~known]
        edges = np.cumsum([0] + [len(own) for own in self.waiting])
        of = np.searchsorted(edges, first, side="right") - 1
        for part, index in zip(of.tolist(), (first - edges[of]).tolist(), strict=True):
            chunk, at, long = self.chunks[part]
            word, k = int(at[index]), int(long[index])
            span = chunk.buffer[chunk.starts[word] : chunk.ends[word + k - 1]]
            self.langs.append(chunk.langs[chunk.text[word]])
            self.ks.append(k)
            self.grams.append(b" ".join(span.split()).decode(errors="replace"))
        places = np.arange(len(self.counts), len(self.grams))
        self.counts = np.concatenate([self.counts, counts[~known]])
        self.keys = np.concatenate([self.keys, keys[~known]])
        self.places = np.concatenate([self.places, places])
        order = np.argsort(self.keys)
        self.keys, self.places = self.keys[order], self.places[order]
        self.chunks, self.waiting, self.size = [], [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        table = pa.table(
            {
                "lang": pa.array(self.langs, pa.string()),
                "k": pa.array(self.ks, pa.int32()),
                "gram": pa.array(self.grams, pa.string()),
                "n": pa.array(self.counts, pa.int64()),
            }
        )
        yield from table.to_batches(max_chunksize=1 << 16)


def _longest(masks: list[Mask], longest: int, sizes: Sizes):
    """Longest grams, and all words of a language as a gram of none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        grams = _Grams(masks, longest)
        for chunk in _chunks(batches, sizes.chunk_bytes):
            counts = np.bincount(chunk.text, minlength=len(chunk.langs)).tolist()
            for lang, n in zip(chunk.langs, counts, strict=True):
                totals[lang] += n
            grams.add(chunk)
            if grams.size >= sizes.block_bytes:
                grams.count()
                if len(grams.grams) >= sizes.table_grams:
                    yield from grams.batches()
                    grams = _Grams(masks, longest)
        if grams.size:
            grams.count()
        yield from grams.batches()
        if totals:
            size = len(totals)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(totals), pa.string()),
                    pa.array([0] * size, pa.int32()),
                    pa.array([""] * size, pa.string()),
                    pa.array(list(totals.values()), pa.int64()),
                ],
                names=["lang", "k", "gram", "n"],
            )

    return made


def longest_grams(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    lang: str = "lang",
    text: str = "text",
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """(lang, k, gram, n): the edges (k = longest), the ends of pieces, and all words (k = 0)."""
    texts = docs.select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    masks: list[Mask] = []
    for _ in range(min(PASSES, longest)):
        masks = [*masks, _frequent(texts, masks, least, sizes)]
    # A gram is sent once by every task that has it, so tasks follow the cores, not the splits.
    tasks = TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    grams = texts.coalesce(tasks).mapInArrow(_longest(masks, longest, sizes), GRAMS)
    return grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def flows(grams: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, k, gram, n) of every gram counted at least `least` times, from the flow of nodes."""
    level = grams.filter(F.col("k") == longest).select("lang", "gram", "n")
    kept = []
    for k in range(longest, 0, -1):
        if k < longest:
            ends = grams.filter(F.col("k") == k).select("lang", "gram", "n")
            first = F.substring_index("gram", " ", k).alias("gram")
            leaving = level.select("lang", first, "n")
            level = leaving.union(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            level = written(level, f"level{k}")
        often = level.filter(F.col("n") >= least)
        kept.append(often.select("lang", F.lit(k).alias("k"), "gram", "n"))
    made = kept[0]
    for more in kept[1:]:
        made = made.union(more)
    return made


def compacted(counts: DataFrame, shortest: int = 2) -> DataFrame:
    """The phrases that lie on no unary path: no longer one has them and their whole count."""
    longer = counts.filter(F.col("k") > shortest)
    head = F.expr("substring_index(gram, ' ', k - 1)")
    tail = F.expr("substring_index(gram, ' ', 1 - k)")
    inner = longer.select("lang", "n", F.explode(F.array(head, tail)).alias("gram")).distinct()
    phrases = counts.filter(F.col("k") >= shortest)
    return phrases.join(inner, ["lang", "gram", "n"], "left_anti")


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the cut that scores least, the first of several."""
    words = phrases.select(
        "lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.split("gram", " ").alias("w")
    )
    cut = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut")
    cuts = words.select("lang", "phrase", "a", "w", cut).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left_part"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("right_part"),
    )
    left = counts.select("lang", F.col("gram").alias("left_part"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("gram").alias("right_part"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"])
    both = both.join(totals, "lang")
    wide = "decimal(20, 0)"
    score = F.expr(f"(cast(a as {wide}) * n * 1000) div (cast(l as {wide}) * r) as score")
    best = both.select("lang", "phrase", "a", "n", F.struct(score, "cut", "l", "r").alias("by"))
    best = best.groupBy("lang", "phrase", "a", "n").agg(F.min("by").alias("by"))
    return best.select("lang", "phrase", "a", "by.l", "by.r", "n", "by.score")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` rows of a language, chosen in parts of it before they meet."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    first = rows.select("*", part).withColumn("place", place).filter(F.col("place") <= top)
    row = F.struct(
        (-F.col("score")).alias("later"), (-F.col("a")).alias("fewer"), "phrase", "l", "r", "n"
    )
    listed = first.groupBy("lang").agg(F.collect_list(row).alias("rows"))
    listed = listed.select(
        "lang", F.posexplode(F.slice(F.sort_array("rows"), 1, top)).alias("at", "row")
    )
    return listed.select(
        "lang",
        (F.col("at") + 1).cast("long").alias("rank"),
        "row.phrase",
        (-F.col("row.fewer")).alias("a"),
        "row.l",
        "row.r",
        "row.n",
        (-F.col("row.later")).alias("score"),
    )


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    longest: int = LONGEST,
    lang: str = "lang",
    text: str = "text",
    sizes: Sizes = Sizes(),
) -> DataFrame:
    """The best collocations of every language: lang, rank, phrase, a, l, r, n, score."""
    grams = written(longest_grams(docs, least, longest, lang, text, sizes), "grams")
    totals = grams.filter("k = 0").select("lang", "n")
    counts = written(flows(grams, least, longest), "counts", few=True)
    return ranked(scored(compacted(counts), counts, totals), top)
