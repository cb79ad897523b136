"""Token groups and links against brute force over byte ranges."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lendlens.llm import alignment, queries
from tests.conftest import TESTDATA

#: How byte-level vocabularies write bytes, by the letters of Latin-1 and what is left of them.
SHOWN = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xFF and c != 0xAD]
BYTES = {chr(c): c for c in SHOWN}
BYTES |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in SHOWN)}


@pytest.fixture(scope="module")
def plain():
    """The libraries themselves."""
    a = Tokenizer.from_file(alignment.FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.FILE_B)


@pytest.fixture(scope="module")
def aligner():
    with open(alignment.FILE_A) as a, open(alignment.FILE_B, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


def spans(parts):
    at, made = 0, []
    for part in parts:
        made.append((at, at + len(part)))
        at += len(part)
    return made


def brute(plain, text):
    """(a ids, b ids, groups, links as positions) by comparing every two byte ranges."""
    a, b = plain
    if not text:
        return [], [], [], []
    wanted = f" {text}".encode()
    ids_a = a.encode(f" {text}", add_special_tokens=False).ids
    ids_b = b.encode(text)
    parts_a = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        if piece.startswith("<0x"):
            parts_b.append(bytes.fromhex(piece[3:5]))
        else:
            parts_b.append(piece.replace("▁", " ").encode())
    if b"".join(parts_a) != wanted or b"".join(parts_b) != wanted:
        return [], [], [], []
    spans_a, spans_b = spans(parts_a), spans(parts_b)
    ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, start = [], 0
    for end in ends:
        inside = [
            [i for i, (s, e) in zip(ids, at, strict=True) if start <= s and e <= end]
            for ids, at in ((ids_a, spans_a), (ids_b, spans_b))
        ]
        groups.append(tuple(inside))
        start = end
    links = [
        (i, j)
        for i, (s, e) in enumerate(spans_a)
        for j, (t, f) in enumerate(spans_b)
        if s < f and t < e
    ]
    return ids_a, ids_b, groups, links


def expected(plain, texts):
    made, holding = {}, Counter()
    for key, text in texts.items():
        a, b, groups, links = brute(plain, text)
        pairs = [(a[i], b[j]) for i, j in links]
        made[key] = a, b, groups, pairs
        holding.update(set(pairs))
    most = Counter()
    for (a, _), n in holding.items():
        most[a] = max(most[a], n)
    rows = {}
    for key, (a, b, groups, pairs) in made.items():
        written = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows[key] = (
            len(a),
            len(b),
            len(groups),
            len(pairs),
            sum(holding[pair] == most[pair[0]] for pair in pairs),
            sum(holding[pair] for pair in pairs),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        )
    return rows


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(rows):
    return {row["doc_id"]: tuple(row[name] for name in NAMES) for row in rows}


def strange_texts():
    rng = random.Random(2)
    letters = "ab é中\U0001f600▁ \t\n'sé'll 12 ...<|endoftext|><s><0x41>ﬁ́　\x00\x85"
    texts = {i: "".join(rng.choices(letters, k=rng.randint(1, 60))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: " ", 1003: "  ", 1004: "a", 1005: "<|endoftext|>"}
    texts |= {1006: "ab" * 5000, 1007: " " * 3000 + "x", 1008: "\n" * 2000, 1009: "same", 1010: "same"}
    return texts


def test_strange_texts(spark, plain):
    texts = strange_texts()
    short = {key: text for key, text in texts.items() if not text or len(text) < 4000}
    docs = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    want = expected(plain, short)
    for size in (1, 500, alignment.BLOCK_PAIRS):  # a document a block, a few, all
        assert got(alignment.link_digests(docs, block_pairs=size).collect()) == want


def test_sample_ids_are_the_libraries(aligner, plain, documents):
    _, texts = documents("sf0.01")
    for text in [*texts.values(), *strange_texts().values()]:
        if text:
            a, b = aligner.tokens(text.encode())
            ids = plain[0].encode(f" {text}", add_special_tokens=False).ids
            assert a in (ids, [])
            assert b in (plain[1].encode(text), [])


def test_query(spark, plain, documents):
    _, texts = documents("sf0.001")
    rows = queries.op11_token_alignment(spark, f"{TESTDATA}/sf0.001").collect()
    found = got(rows)
    assert len(rows) == len(texts)
    short = {key: text for key, text in texts.items() if text is None or len(text) < 3000}
    for key, (n_a, n_b, n_groups, n_links, *_, hashed) in expected(plain, short).items():
        assert found[key][:4] == (n_a, n_b, n_groups, n_links)
        assert found[key][6] == hashed


def test_counts_over_all_documents(spark, plain, documents):
    _, texts = documents("sf0.001")
    short = {key: text[:400] for key, text in texts.items() if text}
    docs = spark.createDataFrame(list(short.items()), "doc_id long, text string").repartition(4)
    assert got(alignment.link_digests(docs).collect()) == expected(plain, short)


def test_groups_and_links(spark, plain):
    texts = {1: "Überraschung, naïve tokenizers!", 2: None, 3: "中文 and more"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in alignment.aligned(docs).collect():
        a, b, groups, links = brute(plain, texts[row["doc_id"]])
        assert (row["a_ids"], row["b_ids"]) == (a, b)
        assert [(g["a"], g["b"]) for g in row["groups"]] == groups
        assert [(link["a"], link["b"]) for link in row["links"]] == sorted(links)


def test_very_long_runs(aligner):
    for text in ("a" * 300_000, " " * 300_000, "\n" * 300_000, "é" * 100_000, "1" * 300_000):
        a, b = aligner.tokens(text.encode())
        n_groups, codes, _ = aligner.digest(a, b)
        assert not a or (n_groups >= 1 and len(codes) >= max(len(a), len(b)))


def test_edges(spark, edge_docs, no_docs):
    rows = alignment.link_digests(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for row in rows:
        if row["doc_id"] in (1, 2):
            assert tuple(row[1:]) == (0, 0, 0, 0, 0, 0, "")
    assert alignment.link_digests(no_docs).collect() == []
    assert alignment.aligned(no_docs).collect() == []
    renamed = edge_docs.withColumn("lang", F.lit(1)).filter("doc_id = 9")
    assert len(alignment.link_digests(renamed).collect()) == 2
