"""Virtual slots: bytes, places, versions."""

import zlib

from lendlens.llm import queries, slots
from tests.conftest import TESTDATA


def test_query(spark, documents):
    _, texts = documents("sf0.1")
    rows = queries.op2_virtual_slots(spark, f"{TESTDATA}/sf0.1").collect()
    assert sorted(row["doc_id"] for row in rows) == sorted(texts)
    held, places = [0] * 40, [[] for _ in range(40)]
    for row in rows:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert row["law"] == "bytes" and row["grown_shard"] is None
        held[row["shard"]] += row["size"]
        places[row["shard"]].append(row["slot"])
    assert max(held) - min(held) <= 2 * slots.TOLERANCE * sum(held) / 40
    assert all(sorted(of) == list(range(len(of))) for of in places)
    one = {(row["virtual_slot"], row["shard"]) for row in rows}
    assert len(one) == len({slot for slot, _ in one})


def test_versions():
    sizes = {slot: 100 + slot % 7 for slot in range(1000)}
    first = slots.rebalanced(slots.SlotMap.initial(1000, 10), sizes)
    again = slots.rebalanced(first, sizes)
    assert (first.version, again.version) == (1, 2) and again.shard_of == first.shard_of
    sizes[3] += 5000
    edited = slots.rebalanced(first, sizes)
    moved = sum(a != b for a, b in zip(first.shard_of, edited.shard_of, strict=True))
    assert 0 < moved < 200
    grown = slots.rebalanced(first, sizes, shards=11)
    held = [0] * 11
    for slot, shard in enumerate(grown.shard_of):
        held[shard] += sizes[slot]
    assert max(held) - min(held) <= 0.01 * sum(held)


def test_one_heavy_slot_and_none():
    assert slots.rebalanced(slots.SlotMap.initial(4, 2), {}).shard_of == (0, 1, 0, 1)
    made = slots.rebalanced(slots.SlotMap.initial(4, 2), {0: 100, 2: 1, 1: 1})
    assert made.shard_of[0] != made.shard_of[2]


def test_edges(edge_docs, no_docs):
    rows = slots.sharded(edge_docs, shards=3)[0].collect()
    assert len(rows) == edge_docs.count()
    empty = next(row for row in rows if row["doc_id"] == 1)
    assert (empty["size"], empty["text_crc32"]) == (16, 0)
    for shard in range(3):
        places = sorted(row["slot"] for row in rows if row["shard"] == shard)
        assert places == list(range(len(places)))
    assert slots.sharded(no_docs)[0].count() == 0
