"""Near-duplicate components against brute force."""

import random
import re
from collections import defaultdict

import pytest

from lendlens.llm import near_dedup, queries, shingles
from lendlens.llm.components import components
from tests.conftest import TESTDATA
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(texts):
    """Component ids by comparing every two sets that share a shingle."""
    classes = defaultdict(list)
    for key, text in texts.items():
        classes[plain_set(text)].append(key)
    classes.pop(frozenset(), None)
    sets = list(classes)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holding = defaultdict(list)
    for i, own in enumerate(sets):
        met = defaultdict(int)
        for gram in own:
            for j in holding[gram]:
                met[j] += 1
            holding[gram].append(i)
        for j, common in met.items():
            if 100 * common >= 85 * (len(own) + len(sets[j]) - common):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, own in enumerate(sets):
        groups[find(i)] += classes[own]
    made = {key: key for key in texts}
    for members in groups.values():
        made.update(dict.fromkeys(members, min(members)))
    return made


def check(rows, texts):
    expected = brute_components(texts)
    assert len(rows) == len(texts)
    for row in rows:
        key = row["doc_id"]
        assert row["n_shingles"] == len(plain_set(texts[key]))
        assert row["component_id"] == expected[key]
        assert row["kept"] == (key == expected[key])


def test_query(spark, documents):
    _, texts = documents("sf0.01")
    check(queries.op10_minhash_bayes(spark, f"{TESTDATA}/sf0.01").collect(), texts)


def near_texts():
    """A chain of small edits, a crowd around one text, and strangers."""
    rng = random.Random(11)
    texts = {}

    def add(words):
        texts[len(texts)] = " ".join(words)

    chain = sentence(rng, 200).split()
    for step in range(25):
        add(chain)
        chain = list(chain)
        chain[(8 * step) % 200] = f"edit{step}"
    crowd = sentence(rng, 150).split()
    for i in range(300):
        copy = list(crowd)
        for at in rng.sample(range(150), rng.randint(0, 3)):
            copy[at] = f"word{rng.randint(0, 50)}"
        add(copy if i % 7 else [w.upper() for w in copy])
    for _ in range(50):
        add(sentence(rng, 60).split())
    return texts


@pytest.mark.parametrize("spread", [1000, 0])
def test_chain_and_crowd(spark, monkeypatch, spread):
    monkeypatch.setattr(near_dedup, "SPREAD", spread)
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(near_dedup.deduplicated(docs.repartition(5)).collect(), texts)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7), (300, 100)]
    made = components(spark.createDataFrame(links, "a long, b long")).collect()
    found = {row["node"]: row["root"] for row in made}
    assert set(found) == {*range(61), 100, 200, 300}
    assert len({found[i] for i in range(61)}) == 1 == len({found[i] for i in (100, 200, 300)})
    assert len(set(found.values())) == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_posterior_bounds():
    """Against the posterior summed over a fine grid of similarities."""
    for bits in (64, 128, 192):
        least = near_dedup.least_matches(bits)
        grid = [0.5 + (i + 0.5) / 4000 for i in range(2000)]

        def chance(equal, bits=bits, grid=grid):
            weights = [p**equal * (1 - p) ** (bits - equal) for p in grid]
            return sum(w for p, w in zip(grid, weights, strict=True) if p >= 0.925) / sum(weights)

        assert chance(least) >= near_dedup.MISS * 0.9
        assert chance(least - 1) <= near_dedup.MISS * 1.1


def test_shingle_sets():
    for text in ("", "One", "a B c d", "a b c d e", "a b c d e a b c d e", "é x\x0by\x1cz w v"):
        assert len(shingles.shingle_set(text.encode())) == len(plain_set(text))
    same = shingles.shingle_set(b"A b  c\nd e f")
    assert (same == shingles.shingle_set(b"a b c d e f")).all()
    long_text = " ".join(f"w{i}" for i in range(30_000))
    assert len(shingles.shingle_set(long_text.encode())) == 29_996


def test_edges(edge_docs, no_docs):
    rows = near_dedup.deduplicated(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = defaultdict(list)
    for row in rows:
        by_id[row["doc_id"]].append(row)
    for empty in (1, 2, 3):
        assert by_id[empty][0]["n_shingles"] == 0 and by_id[empty][0]["kept"]
    assert by_id[5][0]["component_id"] == 4 and by_id[7][0]["component_id"] == 6
    assert by_id[4][0]["n_shingles"] > 30_000
    assert [row["component_id"] for row in by_id[None]] == [10, 10]
    assert len(by_id[9]) == 2 and all(row["kept"] for row in by_id[9])
    kept = near_dedup.kept_rows(edge_docs)
    assert kept.columns == edge_docs.columns
    # One row of each component, also where copies have no doc_id or the same one.
    groups = {row["component_id"] for row in rows if row["n_shingles"]}
    assert kept.count() == len(groups) + sum(not row["n_shingles"] for row in rows)
    assert near_dedup.deduplicated(no_docs).count() == 0 == near_dedup.kept_rows(no_docs).count()


def test_one_row_of_each_component_stays(spark):
    """Rows without doc_id, and texts that share one, are judged each by its own text."""
    same, other = sentence(random.Random(1), 30), sentence(random.Random(2), 30)
    rows = [(None, same), (None, same), (1, same), (2, other), (2, same)]
    docs = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], "doc_id long, text string, n int")
    kept = near_dedup.kept_rows(docs).collect()
    assert sorted((row["doc_id"], row["text"], row["n"]) for row in kept) == [(1, same, 2), (2, other, 3)]
    verdicts = {(row["doc_id"], row["component_id"], row["kept"]) for row in near_dedup.deduplicated(docs).collect()}
    assert verdicts == {(None, 1, False), (1, 1, True), (2, 2, True), (2, 1, False)}


def test_one_of_equal_rows_stays(spark):
    text = sentence(random.Random(3), 30)
    rows = [(7, text), (7, text), (7, text), (None, ""), (None, ""), (8, None), (9, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.kept_rows(docs).collect()
    assert sorted(map(str, kept)) == sorted(
        str(row) for row in spark.createDataFrame([rows[0], *rows[3:]], docs.schema).collect()
    )
    without = spark.createDataFrame([(None, text), (None, text)], docs.schema)
    assert near_dedup.kept_rows(without).count() == 1
