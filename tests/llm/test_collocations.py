"""Collocations against SQL and against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lendlens.llm import collocations, queries
from tests.conftest import TESTDATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall("[^\x20\x09]+", piece)


def brute(docs, least, top):
    counts, sizes = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            sizes[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = [(*key, a) for key, a in counts.items() if len(key[1]) > 1 and a >= least]
    rows = []
    for lang, phrase, a in candidates:
        inside = any(
            other_lang == lang
            and len(other) > len(phrase)
            and b >= a
            and any(other[i : i + len(phrase)] == phrase for i in range(len(other)))
            for other_lang, other, b in candidates
        )
        if inside:
            continue
        scores = []
        for j in range(1, len(phrase)):
            left, right = counts[lang, phrase[:j]], counts[lang, phrase[j:]]
            scores.append((1000 * a * sizes[lang] // (left * right), j, left, right))
        score, _, left, right = min(scores)
        rows.append((lang, " ".join(phrase), a, left, right, sizes[lang], score))
    rows.sort(key=lambda row: (row[0], -row[-1], -row[2], row[1].encode()))
    place, made = Counter(), []
    for lang, *rest in rows:
        place[lang] += 1
        if place[lang] <= top:
            made.append((lang, place[lang], *rest))
    return made


def listed(rows):
    return sorted(tuple(row[name] for name in COLUMNS) for row in rows)


def test_query_against_sql(spark):
    rows = queries.op13_debruijn_phrases(spark, f"{TESTDATA}/sf0.01").collect()
    with duckdb.connect() as db:
        db.execute(f"create view documents as from '{TESTDATA}/sf0.01/documents.parquet'")
        made = db.sql(queries.ORACLE_SQL["op13_debruijn_phrases"])
        assert made.columns == COLUMNS
        assert listed(rows) == sorted(made.fetchall())
    assert rows


def few_words(seed, docs):
    """Few words, so that phrases, ties and passages that repeat are common."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices("abcdefghijkl", k=40))
    made = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 12)):
            words = rng.choices(["a", "B", "c", "dd", "é", "中"], k=rng.randint(0, 9))
            parts.append(rng.choice([" ", "\t", "  "]).join(words))
            parts.append(rng.choice([".", ",", "\n", "\r\n", "?!", " ", "\x0b"]))
        if rng.random() < 0.3:
            parts.append(passage)
        made.append((rng.choice([None, "", "".join(parts)]), rng.choice([None, "en", "en", "und", "x y"])))
    return made


#: Texts cut into many chunks and blocks.
SMALL = collocations.Sizes(chunk_bytes=40, block_bytes=100, block_keys=30)


@pytest.mark.parametrize("least, top", [(1, 10**6), (5, 10**6), (40, 3)])
def test_against_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "PARTS", 3)
    docs = few_words(least, 80)
    frame = spark.createDataFrame(docs, "text string, lang string")
    got = collocations.collocations(frame, least, top, sizes=SMALL).collect()
    assert listed(got) == sorted(brute(docs, least, top))


def test_a_task_sends_a_gram_once(spark):
    """However many blocks of text it has, as long as its table has room."""
    frame = spark.createDataFrame(few_words(5, 60), "text string, lang string")
    texts = frame.select("lang", "text").coalesce(1)
    masks = [collocations._frequent(texts, [], 1, SMALL)]
    made = texts.mapInArrow(collocations._longest(masks, 5, SMALL), collocations.GRAMS).collect()
    assert len(made) == len({(row.lang, row.k, row.gram) for row in made}) > 100


def test_a_small_table_changes_nothing(spark):
    docs = few_words(11, 80)
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(7)
    sizes = collocations.Sizes(chunk_bytes=40, block_bytes=100, block_keys=30, table_grams=8)
    got = collocations.collocations(frame, 5, sizes=sizes).collect()
    assert listed(got) == sorted(brute(docs, 5, 2000))


def test_a_mask_without_room_changes_nothing(spark):
    """Where all keys share a few bits nothing is cut, and counts are the same."""
    docs = few_words(9, 60)
    frame = spark.createDataFrame(docs, "text string, lang string")
    got = collocations.collocations(frame, 4, sizes=collocations.Sizes(mask_bits=7)).collect()
    assert listed(got) == sorted(brute(docs, 4, 2000))


def test_flow_of_nodes(spark):
    """Counts of short grams follow from edges and ends of pieces."""
    docs = few_words(3, 50)
    frame = spark.createDataFrame(docs, "text string, lang string")
    grams = collocations.longest_grams(frame, 1)
    found = {(r.lang, r.gram): r.n for r in collocations.flows(grams, 1).collect()}
    counts = Counter()
    for text, lang in docs:
        for words in pieces(text):
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", " ".join(words[i : i + k])] += 1
    assert found == counts


def test_large_numbers_are_exact(spark):
    big = 3_037_000_507  # its square passes 63 bits
    phrases = spark.createDataFrame([("x", 2, "p q", big)], "lang string, k int, gram string, n long")
    parts = [("x", 1, "p", big + 10), ("x", 1, "q", big + 7)]
    counts = spark.createDataFrame(parts, phrases.schema)
    totals = spark.createDataFrame([("x", 10**13)], "lang string, n long")
    (row,) = collocations.scored(phrases, counts, totals).collect()
    assert row.score == 1000 * big * 10**13 // ((big + 10) * (big + 7))


def test_long_texts_are_cut_where_pieces_end():
    for text in (b"", b"a", b"abc def ghi jkl, mno. pqr stu vwx yz", b"x" * 50, b"." * 50):
        parts = list(collocations.parts(text, 10))
        assert b"".join(parts) == text
        assert all(part[-1:] in b".,;:!?\n\x0b\x0c\r" for part in parts[:-1])


def test_edges(spark, edge_docs, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(no_docs, 1).collect() == []
    docs = edge_docs.filter("doc_id not in (4, 5)").withColumn("gram", F.lit(1))
    plain = [(row["text"], row["lang"]) for row in docs.collect()]
    assert listed(collocations.collocations(docs, 2).collect()) == sorted(brute(plain, 2, 2000))
    assert collocations.collocations(edge_docs, 2, top=5).count() >= 5
