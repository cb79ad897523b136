"""Language identification by bit-sliced Bloom filters of character trigrams.

One filter serves all languages: each position holds a bitmask with a bit per language, in as
many words of `BITS` as the languages need, and the conjunction of a trigram's positions is the set of languages that contain it. A text's trigrams
are looked up at once, each language's hits are counted from the masks, corrected for the false
positives expected of its filter, and the language with most decides. The score is its share of
all languages' corrected hits.

A trigram enters a language's filter if it makes up at least `MIN_SHARE` of the language's
training trigrams and its share there is at least `MIN_RATIO` of its share anywhere else. So a
language has at most 1 / MIN_SHARE trigrams, which bounds what the driver and each task hold;
the filter has a fixed size. Training takes about `TRAINING_TEXTS` distinct texts per language,
by hash of the text; prediction reads every text whole and nothing but the text.

Defined results: NULL texts and those without a letter are `und` with score 0. If no trigram of
a text is in a filter, the language with most training texts is given, with score 0; without
any training language every text is `und`. Of equal counts the first language by name wins.
Equal texts get equal predictions, one row per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.scratch import written

TRAINING_TEXTS = 4000
MIN_SHARE = 2e-5
MIN_RATIO = 0.1
POSITIONS = 1 << 20
HASHES = 3
#: Bits of a word of a mask.
BITS = 63
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Characters looked at together, so that a long text needs little memory.
_CHUNK = 1 << 20


@lru_cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of a text's trigrams, in chunks; anything but letters is a word boundary."""
    for at in range(0, max(len(text), 1), _CHUNK):
        part = text[max(0, at - 2) : at + _CHUNK].lower()
        codes = np.frombuffer(f" {part} ".encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
        inside = codes[1:-1] != 0
        parts = codes[:-2] * _FACTORS[0] + codes[1:-1] * _FACTORS[1] + codes[2:] * _FACTORS[2]
        hashed = parts[inside]
        hashed = (hashed ^ (hashed >> np.uint64(29))) * _FACTORS[1]
        yield hashed ^ (hashed >> np.uint64(32))


def _positions(grams: np.ndarray) -> list[np.ndarray]:
    bits = POSITIONS.bit_length() - 1
    return [(grams >> np.uint64(i * bits)) & np.uint64(POSITIONS - 1) for i in range(HASHES)]


class Filters:
    """The masks, the languages of their bits, and the false positive rate of each.

    Language i has bit i % BITS of word i // BITS; `masks` of the trigrams may have one column per
    word. `words` holds an array of positions per word, `masks` is the first.
    """

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray):
        self.languages = languages
        columns = masks.reshape(len(grams), -1).T if len(grams) else []
        self.words = [np.zeros(POSITIONS, np.uint64) for _ in range(max(1, -(-len(languages) // BITS)))]
        for word, column in zip(self.words, columns, strict=False):
            for at in _positions(grams):
                np.bitwise_or.at(word, at.astype(np.int64), column)
        filled = [self._has(self.words[i // BITS], i % BITS).mean() for i in range(len(languages))]
        self.false = np.array(filled, float) ** HASHES

    @property
    def masks(self) -> np.ndarray:
        return self.words[0]

    @staticmethod
    def _has(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks >> np.uint64(i)) & np.uint64(1)

    def counted(self, text: str) -> tuple[np.ndarray, int]:
        """Corrected hits of every language, and the number of trigrams."""
        hits, n = np.zeros(len(self.languages)), 0
        for grams in trigrams(text):
            positions = _positions(grams)
            n += len(grams)
            for first, word in zip(range(0, len(hits), BITS), self.words, strict=True):
                found = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
                for at in positions:
                    found &= word[at]
                here = range(min(BITS, len(hits) - first))
                hits[first : first + BITS] += [self._has(found, i).sum() for i in here]
        return np.maximum(0, (hits - n * self.false) / (1 - self.false)), n

    def predict(self, text: str | None, usual: str) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        hits, n = self.counted(text)
        if not n:
            return UNDETERMINED, 0.0
        total = hits.sum()
        if not total:
            return usual, 0.0
        best = int(hits.argmax())
        return self.languages[best], float(hits[best] / total)


def _partial_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) of each batch."""
    for part in parts:
        for lang, texts in part.groupby("lang")["text"]:
            grams = [chunk for text in texts for chunk in trigrams(text)]
            found, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": found.view(np.int64), "n": n})


def trained(
    labelled: DataFrame, training_texts: int = TRAINING_TEXTS
) -> tuple[Filters, str]:
    """Filters and the usual language from rows (lang, text)."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Filters([], np.zeros(0, np.uint64), np.zeros(0, np.uint64)), UNDETERMINED
    languages = sorted(counts)
    usual = max(languages, key=counts.__getitem__)
    steps = 1 << 20
    # A row per language, joined: a CASE over many labels would be a deep expression.
    known = labelled.sparkSession.createDataFrame(
        [
            (lang, min(steps, -(-steps * training_texts // counts[lang])), i // BITS, 1 << i % BITS)
            for i, lang in enumerate(languages)
        ],
        "lang string, part long, word int, bit long",
    )
    hashed = F.xxhash64("text")
    sample = (
        labelled.join(F.broadcast(known.select("lang", "part")), "lang")
        .filter(F.pmod(hashed, F.lit(steps)) < F.col("part"))
        .groupBy("lang", hashed.alias("h"))
        .agg(F.min("text").alias("text"))
        .select("lang", "text")
    )
    grams = sample.mapInPandas(_partial_counts, "lang string, gram long, n long")
    grams = written(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = written(grams.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    shares = grams.join(totals, "lang").select(
        "lang", "gram", (F.col("n") / F.col("total")).alias("share")
    )
    best = shares.groupBy("gram").agg(
        F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("each")
    )
    kept = (
        best.filter(F.col("best") >= MIN_SHARE)
        .select("gram", "best", F.explode("each").alias("one"))
        .filter(F.col("one.share") >= F.greatest(F.lit(MIN_SHARE), F.col("best") * MIN_RATIO))
        .select("gram", F.col("one.lang").alias("lang"))
        .join(F.broadcast(known.select("lang", "word", "bit")), "lang")
        .groupBy("gram", "word")
        .agg(F.bit_or("bit").alias("mask"))
        .collect()
    )
    grams = np.array([row["gram"] for row in kept], np.int64)
    found, place = np.unique(grams, return_inverse=True)
    masks = np.zeros((len(found), -(-len(languages) // BITS)), np.uint64)
    masks[place, [row["word"] for row in kept]] = [row["mask"] for row in kept]
    found = found.view(np.uint64)
    return Filters(languages, found, masks), usual


def predicted(text: Column, filters: Filters, usual: str, spark) -> Column:
    """A struct (lang_pred, score) of a text."""
    shared = spark.sparkContext.broadcast((filters, usual))  # of a fixed size

    def predict(texts: pd.Series) -> pd.DataFrame:
        model, most = shared.value
        rows = [model.predict(text, most) for text in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return F.pandas_udf(predict, "lang_pred string, score double")(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a NULL doc_id is neither held out nor learned."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def identified(docs: DataFrame, training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    labelled = docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
    filters, usual = trained(labelled, training_texts)
    said = predicted(F.coalesce("text", F.lit("")), filters, usual, docs.sparkSession)
    return docs.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        said.alias("said"),
    ).select("doc_id", "held_out", "said.*")
