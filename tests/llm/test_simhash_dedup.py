"""SimHash components against comparing every two fingerprints."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash

from lendlens.llm import queries, simhash_dedup
from tests.conftest import TESTDATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    width = min(3, len(words))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    counts = [sum(h >> bit & 1 for h in hashes) for bit in range(64)]
    return sum(1 << bit for bit, n in enumerate(counts) if 2 * n > len(hashes))


def brute_components(prints):
    """Component ids by comparing every two distinct prints."""
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for a, b in combinations(list(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for key, p in prints.items():
        groups[find(p)].append(key)
    return {key: min(keys) for keys in groups.values() for key in keys}


def check(rows, texts):
    prints = {key: brute_print(text) for key, text in texts.items()}
    expected = brute_components(prints)
    assert len(rows) == len(texts)
    for row in rows:
        assert row["fingerprint"] == f"{prints[row['doc_id']]:016x}"
        assert row["component_id"] == expected[row["doc_id"]]


def test_query(spark, documents):
    _, texts = documents("sf0.01")
    check(queries.op12_deletion_variants(spark, f"{TESTDATA}/sf0.01").collect(), texts)


def signed(p):
    return p - 2**64 if p >= 2**63 else p


@pytest.mark.parametrize("few", [0, 8, 10**6])
def test_links_find_every_close_pair(spark, few):
    """Crowds around some prints, within one half and across both, and strangers."""
    rng = random.Random(4)
    prints = {0, 2**64 - 1}
    for _ in range(6):
        middle = rng.getrandbits(64)
        for _ in range(60):
            made = middle
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                made ^= 1 << bit
            prints.add(made)
    low = rng.getrandbits(32)
    prints |= {(rng.getrandbits(32) << 32) | low for _ in range(100)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints |= {(low << 32) | 1 << i | 1 << j for i in range(32) for j in range(i, 32)}
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = simhash_dedup.links(rows, few).collect()
    pairs = {frozenset((a % 2**64, b % 2**64)) for a, b in found}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in pairs:
        root[find(a)] = find(b)
    expected = brute_components({p: p for p in prints})
    for a, b in combinations(prints, 2):
        assert (find(a) == find(b)) == (expected[a] == expected[b])
    if few:
        return
    # Nothing but groups of at most four that agree in all bits but two.
    variants = simhash_dedup.variants(rows)
    assert variants.count() == 64 * len(prints)


def test_ties_and_repeats_of_words():
    for text in ("a b c", "a b c d", "A b C\vd\fe", "x " * 500, "é É é É é", "one two", "one"):
        assert simhash_dedup.fingerprint(text.encode()) == brute_print(text)
    long = " ".join(random.Random(1).choices("abcdefgh", k=150_000))
    assert simhash_dedup.fingerprint(long.encode()) == brute_print(long)


def test_edges(spark, edge_docs, no_docs):
    rows = simhash_dedup.clustered(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    of = defaultdict(list)
    for row in rows:
        of[row["doc_id"]].append(row)
    assert [row["fingerprint"] for key in (1, 2, 3) for row in of[key]] == ["0" * 16] * 3
    assert {row["component_id"] for key in (1, 2, 3) for row in of[key]} == {1}
    assert {row["component_id"] for key in (4, 5) for row in of[key]} == {4}
    assert {row["component_id"] for row in of[None]} == {10}  # the same text has an id there
    assert {row["component_id"] for key in (6, 7) for row in of[key]} == {6}
    assert simhash_dedup.clustered(no_docs).collect() == []


def test_a_component_without_ids_has_none(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [row["component_id"] for row in simhash_dedup.clustered(docs).collect()] == [None, None]
