"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded by a byte-level BPE (A, of space and text) and by a piece model (B, which
adds the space itself). Dictionaries lead from the byte offset where a token ends to the number
of tokens up to there; the offsets in both, in order, slice both lists of ids into groups, and
within each group the tokens whose byte ranges overlap are linked.

Corpus counts: tasks gather the documents they read into blocks of a bounded number of pairs. A
block names every pair of ids it holds once, with the number of its documents that hold it, and
its documents refer to that list. So the counts of pairs are summed over blocks, not documents,
and a block is sent each of its pairs' counts once. No list of pairs is broadcast or collected.

Defined results: a text that is NULL or empty, or whose tokens' bytes of A or B are not those of
space and text, has no tokens: its numbers are zero and its groups are empty. Special tokens'
strings within a text are plain text. Rows are independent: rows that repeat a doc_id count as
documents of their own, a NULL doc_id stays NULL, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm.packing import packed, unpacked
from lendlens.llm.scratch import written

FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of ids in the documents of one block, each once per document.
BLOCK_PAIRS = 4_000_000
#: How a byte-level BPE with `use_regex` cuts a text (a fixed value of that format).
BYTE_LEVEL_CUT = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)

GROUPS = (
    "doc_id long, a_ids array<int>, b_ids array<int>, "
    "groups array<struct<a: array<int>, b: array<int>>>, "
    "links array<struct<a: int, b: int>>"
)
BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, "
    "packed binary, pairs array<long>, n_docs array<long>"
)
DIGEST = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups_sha256 string"
)


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [byte for byte in range(256) if byte not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _A:
    """The byte-level BPE: ids of texts, and every id's bytes."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        made = json.loads(definition)
        alphabet = byte_alphabet()
        special = {token["content"] for token in made["added_tokens"]}
        vocab = made["model"]["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, number in vocab.items():
            if entry in special:
                self.bytes[number] = entry.encode()
            else:
                self.bytes[number] = bytes(alphabet[c] for c in entry)
        self._ranks = None
        if self._ranked(made, special):
            import tiktoken

            ranks = {self.bytes[n]: n for entry, n in vocab.items() if entry not in special}
            self._ranks = tiktoken.Encoding(
                "ranked", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={}
            )
        else:
            self._plain = Tokenizer.from_str(definition)
            self._plain.encode_special_tokens = True

    @staticmethod
    def _ranked(made: dict, special: set[str]) -> bool:
        """Whether merges come in the order of their ids and texts are cut the usual way."""
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        usual = (
            made["normalizer"] is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
        )
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        numbers = [model["vocab"]["".join(pair)] for pair in pairs]
        whole = len(numbers) + 256 == len(set(model["vocab"]) - special)
        return usual and whole and numbers == sorted(set(numbers))

    def ids(self, text: str) -> list[int]:
        if self._ranks is not None:
            return self._ranks.encode_ordinary(text)
        return self._plain.encode(text, add_special_tokens=False).ids


class _B:
    """The piece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._written(i) for i in range(self._model.vocab_size())]

    def _written(self, number: int) -> bytes:
        if self._model.is_byte(number):
            return bytes([int(self._model.id_to_piece(number)[3:-1], 16)])
        return self._model.id_to_piece(number).replace("▁", " ").encode()

    def ids(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


class Aligner:
    """Tokens, groups and links of one text at a time."""

    def __init__(self, definition_a: str, model_b: bytes):
        self.a, self.b = _A(definition_a), _B(model_b)
        self._longs = [[len(x) for x in side.bytes] for side in (self.a, self.b)]
        self._long = [np.array(long, np.int64) for long in self._longs]
        #: Ids as they stand in a group of one token of each.
        self._shown = [
            [f"{i}|" for i in range(len(self.a.bytes))],
            [str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)))],
        ]

    def tokens(self, text: bytes | None) -> tuple[list[int], list[int]]:
        """The ids of A and B; none where their bytes are not the text's."""
        try:
            plain = text.decode() if text else ""
        except UnicodeDecodeError:
            plain = ""
        if not plain:
            return [], []
        found = self.a.ids(f" {plain}"), self.b.ids(plain)
        for side, ids in zip((self.a, self.b), found, strict=True):
            if b"".join(map(side.bytes.__getitem__, ids)) != b" " + text:
                return [], []
        return found

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B up to the end of each group: the common keys, in order.

        Keys are offsets within the text, so the dictionaries are arrays over it, zero where
        no token ends.
        """
        long_a, long_b = self._long
        ends_a, ends_b = np.cumsum(long_a[a]), np.cumsum(long_b[b])
        size = int(max(ends_a[-1:].sum(), ends_b[-1:].sum())) + 1
        at_a, at_b = np.zeros(size, np.int32), np.zeros(size, np.int32)
        at_a[ends_a] = np.arange(1, len(a) + 1)
        at_b[ends_b] = np.arange(1, len(b) + 1)
        common = np.flatnonzero((at_a > 0) & (at_b > 0))
        return at_a[common], at_b[common]

    def slices(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """The first token and the one after the last, of A and of B, of each group."""
        i = j = 0
        cuts = self.cuts(np.array(a, np.int64), np.array(b, np.int64))
        for end_a, end_b in zip(*(cut.tolist() for cut in cuts), strict=True):
            yield i, end_a, j, end_b
            i, j = end_a, end_b

    def crossed(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
        """Positions of linked tokens in a group."""
        of_a, of_b = self._longs
        i = j = 0
        end_a, end_b = of_a[a[0]], of_b[b[0]]
        while True:
            yield i, j
            at = min(end_a, end_b)
            if end_a == at:
                i += 1
                if i == len(a):
                    return  # a group ends where both end
                end_a += of_a[a[i]]
            if end_b == at:
                j += 1
                end_b += of_b[b[j]]

    def links(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Positions of the linked tokens of a text, group by group."""
        made = []
        for i, end_a, j, end_b in self.slices(a, b):
            made += [(i + p, j + q) for p, q in self.crossed(a[i:end_a], b[j:end_b])]
        return made

    def digest(self, a: list[int], b: list[int]) -> tuple[int, np.ndarray, str]:
        """The number of groups, linked ids as a * 2^32 + b, and the hash of the groups."""
        if not a:
            return 0, np.empty(0, np.int64), ""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        cut_a, cut_b = self.cuts(ids_a, ids_b)
        last_a, last_b = ids_a[cut_a - 1], ids_b[cut_b - 1]
        # Most groups are one token of each; those are made all at once, the others in turn.
        shown_a, shown_b = self._shown
        pairs = zip(last_a.tolist(), last_b.tolist(), strict=True)
        written_groups = [shown_a[i] + shown_b[j] for i, j in pairs]
        one = (np.diff(cut_a, prepend=0) == 1) & (np.diff(cut_b, prepend=0) == 1)
        others, codes = np.flatnonzero(~one), []
        starts_a, starts_b = (np.concatenate([[0], cut[:-1]]) for cut in (cut_a, cut_b))
        edges = (side[others].tolist() for side in (starts_a, cut_a, starts_b, cut_b))
        for group, i, end_a, j, end_b in zip(others.tolist(), *edges, strict=True):
            own, other = a[i:end_a], b[j:end_b]
            if len(own) == 1:
                codes += [own[0] << 32 | q for q in other]
            elif len(other) == 1:
                codes += [p << 32 | other[0] for p in own]
            else:
                codes += [own[p] << 32 | other[q] for p, q in self.crossed(own, other)]
            shown = ",".join([shown_b[p] for p in own]), ",".join([shown_b[q] for q in other])
            written_groups[group] = "|".join(shown)
        linked = np.concatenate([last_a[one] << 32 | last_b[one], np.array(codes, np.int64)])
        hashed = hashlib.sha256(";".join(written_groups).encode()).hexdigest()
        return len(cut_a), linked, hashed


class _Files:
    """The two vocabularies as tasks get them: a few megabytes, whatever the corpus."""

    def __init__(self, spark: SparkSession, file_a: str, file_b: str):
        with open(file_a, encoding="utf-8") as a, open(file_b, "rb") as b:
            self._sent = spark.sparkContext.broadcast((a.read(), b.read()))

    def aligner(self) -> Aligner:
        return _aligner(*self._sent.value)


@lru_cache(maxsize=2)
def _aligner(definition_a: str, model_b: bytes) -> Aligner:
    return Aligner(definition_a, model_b)


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes | None]]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return zip(batch.column("doc_id").to_pylist(), texts, strict=True)


def aligned(
    docs: DataFrame,
    file_a: str = FILE_A,
    file_b: str = FILE_B,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every row's ids, groups of ids, and links as positions in both lists of ids."""
    files = _Files(docs.sparkSession, file_a, file_b)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("a_ids", pa.list_(pa.int32())),
            ("b_ids", pa.list_(pa.int32())),
            ("groups", pa.list_(pa.struct([(s, pa.list_(pa.int32())) for s in "ab"]))),
            ("links", pa.list_(pa.struct([(s, pa.int32()) for s in "ab"]))),
        ]
    )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = files.aligner()
        for batch in batches:
            for number, text in _texts(batch):
                a, b = aligner.tokens(text)
                groups = [
                    {"a": a[i:end_a], "b": b[j:end_b]} for i, end_a, j, end_b in aligner.slices(a, b)
                ]
                links = [{"a": p, "b": q} for p, q in aligner.links(a, b)]
                row = {"doc_id": number, "a_ids": a, "b_ids": b, "groups": groups, "links": links}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return _read(docs, doc_id, text).mapInArrow(made, GROUPS)


class _Block:
    """Documents of one task, until they hold enough pairs."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, aligner: Aligner, text: bytes | None) -> None:
        a, b = aligner.tokens(text)
        n_groups, codes, hashed = aligner.digest(a, b)
        found, times = np.unique(codes, return_counts=True)
        self.rows.append((doc_id, len(a), len(b), n_groups, len(codes), hashed, len(found)))
        self.codes.append(found)
        self.times.append(times.astype(np.uint32))
        self.size += len(found)

    def batch(self, block: int) -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate(self.codes), return_inverse=True)
        n_docs = np.bincount(place, minlength=len(pairs))
        steps = np.diff(place, prepend=0).astype(np.int64) & 0xFFFFFFFF
        both = packed(np.concatenate([steps, np.concatenate(self.times)]))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.int64()]
        columns = zip(kinds, zip(*self.rows, strict=True), strict=True)
        lists = [pa.array([column], pa.list_(kind)) for kind, column in columns]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                *lists,
                pa.array([both], pa.binary()),
                pa.array([pairs], pa.list_(pa.int64())),
                pa.array([n_docs], pa.list_(pa.int64())),
            ],
            names=[field.split()[0] for field in BLOCKS.split(", ")],
        )


def _blocks(files: _Files, block_pairs: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = files.aligner(), _Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in _texts(batch):
                block.add(doc_id, aligner, text)
                if block.size >= block_pairs:
                    yield block.batch(number)
                    number, block = number + 1, _Block()
        if block.rows:
            yield block.batch(number)

    return made


def _summed(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of one block's documents, given the corpus counts of its pairs."""
    lists = {name: block.column(name)[0].values for name in block.column_names[1:8]}
    size = len(block.column("pairs")[0].values)
    count, best = np.zeros(size, np.int64), np.zeros(size, bool)
    at = counts.column("place").to_numpy()
    count[at] = counts.column("n").to_numpy()
    best[at] = counts.column("best").to_numpy(zero_copy_only=False)
    n_pairs = lists["n_pairs"].to_numpy()
    total = int(n_pairs.sum())
    numbers = unpacked(block.column("packed")[0].as_py())
    place = np.cumsum(numbers[:total].view(np.int32), dtype=np.int64)
    times = numbers[total:].astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(n_pairs)])

    def sums(values: np.ndarray) -> pa.Array:
        run = np.concatenate([[0], np.cumsum(values)])
        return pa.array(run[edges[1:]] - run[edges[:-1]], pa.int64())

    made = lists | {"n_best": sums(times * best[place]), "count_sum": sums(times * count[place])}
    names = [field.split()[0] for field in DIGEST.split(", ")]
    return pa.table({name: made[name] for name in names})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether its A id has no higher."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("held"))
    counts = held.groupBy(F.col("held.pairs").alias("pair")).agg(F.sum("held.n_docs").alias("n"))
    counts = written(counts, "pair_counts")
    of_a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(of_a).agg(F.max("n").alias("most"))
    named = counts.withColumn("a", of_a).join(most, "a")
    return written(named.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def link_digests(
    docs: DataFrame,
    file_a: str = FILE_A,
    file_b: str = FILE_B,
    doc_id: str = "doc_id",
    text: str = "text",
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """Every row's numbers of tokens, groups and links, and what its links count corpus-wide."""
    files = _Files(docs.sparkSession, file_a, file_b)
    blocks = _read(docs, doc_id, text).mapInArrow(_blocks(files, block_pairs), BLOCKS)
    blocks = written(blocks, "blocks")
    own = F.col("block").alias("of_block")
    held = blocks.select(own, F.posexplode("pairs").alias("place", "pair"))
    counts = held.join(pair_counts(blocks), "pair").select("of_block", "place", "n", "best")
    both = blocks.drop("n_docs").groupBy("block").cogroup(counts.groupBy("of_block"))
    return both.applyInArrow(_summed, DIGEST)
