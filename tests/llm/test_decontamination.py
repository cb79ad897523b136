"""Benchmark leaks against brute force, and the guarantees of prints and Hamming blocks."""

import math
import random
import re
from collections import Counter, defaultdict

from lendlens.llm import decontamination as dc
from lendlens.llm import queries
from tests.conftest import TESTDATA

WORD = re.compile(r"[^\W_]+")


def grams(text):
    words = WORD.findall((text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_query(spark, documents):
    """Passages of the sample texts are whole, so a leak shares most shingles anywhere."""
    _, texts = documents("sf0.1")
    items = spark.read.parquet(f"{TESTDATA}/sf0.1/benchmark.parquet").collect()
    holding = defaultdict(set)
    sizes = {}
    for item in items:
        own = grams(item["text"])
        sizes[item["item_id"]] = len(set(own))
        for gram in own:
            holding[gram].add(item["item_id"])
    expected = set()
    for doc_id, text in texts.items():
        shared = Counter(i for gram in set(grams(text)) for i in holding.get(gram, ()))
        expected |= {(doc_id, i) for i, n in shared.items() if n >= 0.8 * sizes[i]}
    rows = queries.op8_simhash_windows(spark, f"{TESTDATA}/sf0.1").collect()
    assert {(row["doc_id"], row["item_id"]) for row in rows} == expected and expected
    assert all(0.8 <= row["similarity"] <= 1 for row in rows)


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_blocks_list_every_print_within_the_radius(spark):
    assert sum(dc.BLOCKS) == 128 and dc.RADIUS < len(dc.BLOCKS) * (dc.ERRORS + 1)
    rng = random.Random(2)
    items = [(i, 30, rng.getrandbits(128)) for i in range(20)]
    prints = set()
    for _, size, value in items:
        for bits in range(0, 50, 2):
            flipped = value
            for bit in rng.sample(range(128), bits):
                flipped ^= 1 << bit
            prints.add((size + (bits == 4), flipped))

    def rows(values):
        return [(*key, signed(v % (1 << 64)), signed(v >> 64)) for *key, v in values]

    made = dc.candidates(
        spark.createDataFrame(rows(sorted(prints)), "length int, print_0 long, print_1 long"),
        spark.createDataFrame(rows(items), "item long, length int, print_0 long, print_1 long"),
    ).collect()
    near = {
        (size, signed(p % (1 << 64)), signed(p >> 64), i)
        for size, p in prints
        for i, length, q in items
        if size == length and (p ^ q).bit_count() <= dc.RADIUS
    }
    assert {tuple(row[c] for c in ("length", "print_0", "print_1", "item")) for row in made} == near
    assert len(near) > 200


def test_prints_differ_as_the_similarity_tells(spark):
    """Windows that lack a fifth of an item's weight, in few heavy or many light shingles."""
    rng = random.Random(3)
    rows, differ = [], []
    for i in range(300):
        heavy, light = rng.choice([(4, 4), (1, 16), (8, 8), (0, 5), (30, 30), (5, 0)])
        weights = [4] * heavy + [1] * light
        lost, left = set(), 0.2 * sum(weights)
        for at in sorted(range(len(weights)), key=lambda at: (weights[at] * (-1) ** i, at)):
            if weights[at] <= left:
                left -= weights[at]
                lost.add(at)
        for at, weight in enumerate(weights):
            rows.append((2 * i, 1000 * i + at, weight))
            if at not in lost:
                rows.append((2 * i + 1, 1000 * i + at, weight))
    table = spark.createDataFrame(rows, "item long, shingle long, weight int")
    table = table.selectExpr("*", "0 as k").groupBy("item")
    lanes = [dc.F.sum(lane).alias(f"lane_{i}") for i, lane in enumerate(dc._lanes())]
    made = {r["item"]: r for r in table.agg(*lanes).select("item", *dc._print()).collect()}
    for i in range(300):
        a, b = made[2 * i], made[2 * i + 1]
        xor = (a["print_0"] ^ b["print_0"]) % (1 << 64), (a["print_1"] ^ b["print_1"]) % (1 << 64)
        differ.append(sum(x.bit_count() for x in xor))
    assert sum(d > dc.RADIUS for d in differ) <= 2 and sum(differ) / 300 < 128 * 0.16
    other = [made[2 * i]["print_0"] ^ made[2 * i + 2]["print_0"] for i in range(299)]
    assert 30 < sum((x % (1 << 64)).bit_count() for x in other) / 299 < 34


def word_list(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_changed_passages(spark):
    """Case, punctuation and single changed words do not hide a passage; half of one does."""
    rng = random.Random(4)
    items, docs, leaked = [], [], set()
    for i in range(30):
        words = word_list(rng, rng.randint(25, 50))
        items.append((i, " ".join(words)))
        before, after = word_list(rng, rng.randint(0, 30)), word_list(rng, 20)
        whole = [w.upper() + "," for w in words]
        near = [*words[:12], "changed", *words[13:]]
        half = words[: len(words) // 2]
        for kind, passage in enumerate((whole, near, half)):
            docs.append((3 * i + kind, "\n".join([*before, *passage, *after])))
            # A changed word takes five of the item's shingles.
            if kind == 0 or kind == 1 and len(words) - 4 - 5 >= 0.8 * (len(words) - 4):
                leaked.add((3 * i + kind, i))
    docs.append((900, items[0][1]))
    leaked.add((900, 0))
    found = dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    got = {(row["doc_id"], row["item_id"]) for row in found}
    exact = {(d, i) for d, i in leaked if d % 3 == 0 or d == 900}
    assert exact <= got <= leaked and len(got) >= 0.95 * len(leaked)


def test_repeated_shingles_and_long_items(spark):
    rng = random.Random(6)
    long_item = " ".join(word_list(rng, 5000))
    chorus = " ".join(["la la la la la lo"] * 6)
    items = [(1, long_item), (2, chorus), (3, chorus), (4, "too short now"), (5, None), (6, "")]
    docs = [(1, long_item), (2, f"x y z {chorus}"), (3, "la la la la la lo"), (4, "too short now")]
    found = dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    got = {(row["doc_id"], row["item_id"]): row["similarity"] for row in found}
    assert set(got) == {(1, 1), (2, 2), (2, 3)} and got[2, 2] == 1


def test_edges(edge_docs, no_docs, spark):
    text = edge_docs.filter("doc_id = 10").first()["text"]
    items = spark.createDataFrame([(7, " ".join(text.split()[20:60])), (8, None)], "item_id long, text string")
    found = dc.leaks(edge_docs, items).collect()
    assert sorted((row["doc_id"] or 0, row["item_id"]) for row in found) == [(0, 7), (0, 7), (10, 7)]
    kept = dc.kept_rows(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert dc.kept_rows(edge_docs, items.limit(0)).count() == edge_docs.count()
    assert dc.leaks(no_docs, items).count() == 0 == dc.kept_rows(no_docs, items).count()


def similarities(text, item):
    """By brute force: every window's shared shingles over the item's, all of one weight."""
    own, there = Counter(grams(item)), grams(text)
    size = sum(own.values())
    starts = range(max(len(there) - size, 0) + 1)
    return [sum((Counter(there[a : a + size]) & own).values()) / size for a in starts]


def test_one_rule_for_items_of_every_length(spark):
    """The last words or a tenth of a long item are no leak; four fifths are, in any place."""
    rng = random.Random(8)
    items, docs, leaked = [], [], set()
    for i, n in enumerate((40, 1999, 2001, 2004, 9000)):
        words = word_list(rng, n)
        items.append((i, " ".join(words)))
        for kind, part in enumerate((words[-5:], words[: n // 10], words[: n // 2], words[n // 8 :])):
            text = [*word_list(rng, 30), *part, *word_list(rng, 30)]
            docs.append((10 * i + kind, " ".join(text)))
        # Most of the first half is new, so that no piece of it is like the item.
        kept = [w if k % 7 or k > n // 4 else "new" for k, w in enumerate(words)]
        docs.append((10 * i + 4, " ".join(kept)))
        leaked |= {(10 * i + 3, i)}
        if max(similarities(docs[-1][1], items[-1][1])) >= 0.8:
            leaked.add((10 * i + 4, i))
    found = dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(row["doc_id"], row["item_id"]) for row in found} == leaked


def test_no_passage_is_missed_at_any_weight(spark):
    """Items that share template wording, with light and heavy shingles replaced at random."""
    rng = random.Random(9)
    template = word_list(rng, 20)
    items = [(i, " ".join([*template, *word_list(rng, rng.randint(15, 30))])) for i in range(80)]
    df = Counter(gram for _, item in items for gram in set(grams(item)))
    rare = {g: math.log(1 + len(items) / n) / math.log(1 + len(items)) for g, n in df.items()}
    weight = {gram: max(1, math.floor(4 * r + 0.5)) for gram, r in rare.items()}
    docs, leaked, spared = [], set(), 0
    for i, item in items:
        own = Counter(grams(item))
        total = sum(n * weight[g] for g, n in own.items())
        for kind in range(12):
            words = item.split()
            for at in rng.sample(range(20 if kind % 3 else len(words)), 1 + kind % 4):
                words[at] = "".join(rng.choices("klmnop", k=6))
            docs.append((100 * i + kind, " ".join([*word_list(rng, 9), *words, *word_list(rng, 9)])))
            there = grams(docs[-1][1])
            size = len(grams(item))
            best = max(
                sum(n * weight[g] for g, n in (Counter(there[a : a + size]) & own).items())
                for a in range(len(there) - size + 1)
            )
            if best / total >= 0.8:
                leaked.add((docs[-1][0], i))
            else:
                spared += 1
    found = dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == leaked
    assert len(leaked) > 200 and spared > 50
