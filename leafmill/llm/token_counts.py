"""Token counts by the whole-token shortcut.

A vocabulary string that the tokenizer proves to encode alone as one token is counted
directly wherever it stands as a pre-token; only the other pre-tokens are merged. Null and empty texts have
no tokens. Texts of any length are counted whole, in pieces that the pre-tokenizer's own
rules separate. Rows are counted one by one; equal rows give equal counts, an empty table an
empty result. Columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Spellings remembered by a worker before it forgets them all, and the longest one kept.
MEMO_ROWS, MEMO_CHARS = 1 << 20, 64
#: The byte-level pre-tokenizer's pattern (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(tokenizer) -> frozenset[str]:
    """The texts among the vocabulary that encode alone as one token: the proof, entry by entry."""
    byte_of = {c: b for b, c in byte_letters().items()}
    found = set()
    for letters, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(byte_of[c] for c in letters).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # an added string, or a part of a character, which is no text
        tokens = tokenizer.model.tokenize(letters)
        if len(tokens) == 1 and tokens[0].id == number:
            found.add(text)
    return frozenset(found)


class Counter:
    """Counts tokens as the tokenizer's encode() does, without its encodings."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = whole_tokens(self.tokenizer)
        self.letters = byte_letters()
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        # a space before a visible character always begins a pre-token, so texts can be cut there; not before a special string, which parts the spaces from what follows
        unless = f"(?!{'|'.join(map(re.escape, special))})" if special else ""
        self.cut = re.compile(rf" (?=\S){unless}").split
        self.memo: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in piece.encode())))

    def plain(self, text: str) -> int:
        return sum(1 if x in self.whole else self.merged(x) for x in self.pre_tokens(text))

    def count(self, text: str) -> int:
        """Tokens of a text, with added strings inside it as one token each."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return self.plain(text)
        return n + sum(map(self.plain, self.special.split(text)))

    def known(self, chunk: str) -> int:
        n = self.count(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ROWS:
                self.memo.clear()
            self.memo[chunk] = n
        return n

    def total(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = self.cut(text)
        n, get, known = self.count(first), self.memo.get, self.known
        for x in rest:
            y = " " + x
            n += get(y) or known(y)
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One for each Python worker, which keeps it from task to task."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; narrow, without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counter(tokenizer_path(vocabulary)).total
        for b in batches:
            n_tokens = pa.array([total(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    columns = docs.select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    counted = columns.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
