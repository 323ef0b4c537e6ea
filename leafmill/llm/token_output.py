"""Token ids as binary blocks, with the documents' bounds in Elias-Fano code.

A block is a self-contained image in the format below; blocks are the rows of a Parquet table
that Spark writes, so that a retried or duplicated task leaves no half-written or second copy.
Documents are in ascending doc_id order (null first) over all partitions, blocks and rows. Null and empty texts
hold the end id alone. Equal doc_ids are ordered by their texts. An empty table gives no
blocks. A document is never cut: a block closes with the first one that fills it, and texts of
any length are encoded whole. Columns other than doc_id and text aren't looked at. Readers
find a document's ids by select, without a table of all ends.

Image, little-endian: magic LMTB, u16 version, u16 bytes per id, u64 documents, u64 ids, u8 low
bits, u64 words of upper bits; the low bits of all ends, packed; the upper bits in unary, in
u64 words; u32 position of every 64th set bit; the ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import each, materialize, table
from leafmill.llm.token_counts import byte_letters, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 18
SAMPLE = 64
HEADER = struct.Struct("<4sHHQQBQ")
#: Words and pre-tokens that a worker remembers, twice so many at most, and the longest of them.
MEMO_WORDS, MEMO_PIECES, MEMO_CHARS = 1 << 17, 1 << 18, 64


class EliasFano:
    """Non-decreasing integers, in 2 + log2(largest / count) bits each, with select."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.upper, self.samples = count, low_bits, low, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, largest = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (largest // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(ones[-1]) + 1) // 64) * 64 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        high = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, count=self.count * self.low_bits, bitorder="little").reshape(self.count, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on, without decoding the others."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, bits = at // 64, int(self.upper[at // 64]) >> (at % 64) << (at % 64)
        while (held := bits.bit_count()) <= left:
            left, word = left - held, word + 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return high << self.low_bits | low & (1 << self.low_bits) - 1

    def span(self, i: int) -> tuple[int, int]:
        """Start and end of the i-th document, when the values are ends."""
        return self.select(i - 1) if i else 0, self.select(i)


def image(ends: np.ndarray, ids: np.ndarray) -> bytes:
    code = EliasFano.of(ends)
    head = HEADER.pack(b"LMTB", 1, ids.dtype.itemsize, code.count, len(ids), code.low_bits, len(code.upper))
    return b"".join((head, code.low.tobytes(), code.upper.tobytes(), code.samples.tobytes(), ids.tobytes()))


def open_image(data: bytes) -> tuple[EliasFano, np.ndarray]:
    """The ends of the documents and all ids."""
    magic, version, width, n, total, bits, words = HEADER.unpack_from(data)
    if magic != b"LMTB" or version != 1:
        raise ValueError("not a token block")
    at, parts = HEADER.size, []
    for kind, count in (("u1", -(-n * bits // 8)), ("<u8", words), ("<u4", -(-n // SAMPLE)), (f"<u{width}", total)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    return EliasFano(n, bits, *parts[:3]), parts[3]


class Memo:
    """Remembers what was asked for of late: new entries displace those of the generation before."""

    def __init__(self, rows: int):
        self.rows, self.new, self.old = rows, {}, {}

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= MEMO_CHARS:
            if len(self.new) >= self.rows:
                self.old = dict(self.new)
                self.new.clear()
            self.new[key] = ids
        return ids


class Encoder:
    """Ids as the tokenizer's encode() gives them, each distinct spelling encoded once.

    The vocabulary's normaliser drops white space and its pre-tokens never contain any, so a
    text's ids are those of its words in turn. A word of Latin-1 letters and ASCII marks, which
    normalising only puts into lower case, is cut into pre-tokens here; the library merges those
    not seen of late. It gets all other words, and those with special strings, whole.
    """

    #: Words that need no more than lower case, and their pre-tokens: the vocabulary's own pattern (fixed value), for these characters.
    plain = re.compile("[!-~À-ÿ]+").fullmatch
    pre_tokens = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile(special).search if special else lambda word: None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.words, self.pieces = Memo(MEMO_WORDS), Memo(MEMO_PIECES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, x: str) -> bytes:
        if (ids := self.pieces.old.get(x)) is None:
            letters = x if x.isascii() else "".join([self.letters[b] for b in x.encode()])
            found = [t.id for t in self.merge(letters)]
            ids = struct.pack(f"<{len(found)}{self.code}", *found)
        return self.pieces.keep(x, ids)

    def word(self, word: str) -> bytes:
        if (ids := self.words.old.get(word)) is None:
            if self.plain(word) and not self.special(word):
                known, piece = self.pieces.new.get, self.piece
                ids = b"".join([known(x) or piece(x) for x in self.pre_tokens(word.lower())])
            else:
                ids = self.whole(word)
        return self.words.keep(word, ids)

    def encode(self, text: str) -> bytes:
        known, word = self.words.new.get, self.word
        return b"".join([known(x) or word(x) for x in text.replace("\n", " ").split(" ") if x])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """docs(doc_id, text) -> the written blocks: part, part_start, doc_ids, n_ids, image.

    part is the range partition, part_start the ids of the same part before the block.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer_path(vocabulary)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.kind).tobytes()
        doc_ids: list = []
        pieces: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // coder.kind.itemsize for x in pieces])
            data = image(ends, np.frombuffer(b"".join(pieces), coder.kind))
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(id_type)), pa.array([ends[-1]], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "part_start", "doc_ids", "n_ids", "image"])

        for b in batches:
            id_type = b.column("doc_id").type
            for doc_id, text in zip(each(b.column("doc_id")), each(b.column("text")), strict=True):
                doc_ids.append(doc_id)
                pieces.append(coder.encode(text or "") + end)
                held += len(pieces[-1]) // coder.kind.itemsize
                if held >= block_ids:
                    yield block()
                    before, held = before + held, 0
                    doc_ids.clear()
                    pieces.clear()
        if pieces:
            yield block()

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return materialize(ordered.mapInArrow(blocks, f"part int, part_start long, doc_ids array<{kind}>, n_ids long, image binary"), "token-blocks")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Digest of each document as the blocks hold it: doc_id, start, n_tokens, ids_crc32.

    Broadcasts one row per partition of the writing job: the ids of all parts before it.
    """
    from pyspark.sql import Window

    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("offset"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_type = b.column("doc_ids").type.value_type
            for part, before, doc_ids, data in zip(*(each(b.column(x)) for x in ("part", "part_start", "doc_ids", "image")), strict=True):
                code, ids = open_image(data)
                rows = []
                for k in range(code.count):
                    i, j = code.span(k)
                    rows.append((part, before + i, j - i, zlib.crc32(ids[i:j].astype("<u4"))))
                columns = [pa.array(doc_ids, id_type), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "part_start", "doc_ids", "image").mapInArrow(digests, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(write_blocks(table(spark, sf_dir, "documents")))
