"""Benchmark decontamination by winnowing.

Every span of n words that a document shares with a benchmark item holds a k-gram whose hash is
the least among the k-grams of the span. Both sides keep such k-grams, so that equal
fingerprints meet; each meeting is then extended word by word, and counts if the shared run
holds a whole window. Items of fewer than n words are one window of their own length and have
fingerprints of their own length. Null and wordless texts have no words and no hits; an empty
benchmark hits nothing; equal rows give equal results. Texts are read whole. Items with equal ids
count as one in the lists; other columns are carried along or not looked at, so that no name clashes.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ASCII_LOWER, ASCII_UPPER, each, materialize, table

WINDOW, GRAM = 13, 5
#: The largest benchmark, in characters, that is sent to every task; a larger one is joined.
BROADCAST_CHARS = 32 << 20
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
find_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
MEMO_ROWS = 1 << 18


class Hashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ROWS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


def split(text: str | None) -> list[str]:
    return find_words(text.translate(LOWER)) if text else []


def numbers(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hashes().__getitem__, words), np.uint64, len(words))


def winnow(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text of word hashes h, and where their k-grams begin.

    The last of the least k-grams of every window of length words: any two texts that share
    such a window keep the same k-gram of it.
    """
    k = min(gram, length)
    if len(h) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.full(len(h) - k + 1, length, np.uint64)
    for i in range(k):
        grams = (grams ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    span = length - k + 1
    best = np.arange(len(grams) - span + 1) + span - 1
    for i in range(span - 2, -1, -1):
        at = np.arange(len(best)) + i
        best = np.where(grams[at] < grams[best], at, best)
    kept = np.unique(best)
    return grams[kept], kept


class Index:
    """Items by their fingerprints."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, gram: int):
        self.gram, self.items, self.places = gram, [], defaultdict(list)
        for item_id, text in items:
            if words := split(text):
                length = min(window, len(words))
                self.items.append((item_id, words, length))
                for f, at in zip(*winnow(numbers(words), length, gram), strict=True):
                    self.places[int(f)].append((len(self.items) - 1, int(at)))
        self.lengths = sorted({x[2] for x in self.items})
        self.keys = np.array(sorted(self.places), np.uint64)

    def hits(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the items with windows that occur."""
        hit, found = np.zeros(len(words), bool), set()
        if not len(self.keys) or not words:
            return hit, []
        h = numbers(words)
        for length in self.lengths:
            prints, at = winnow(h, length, self.gram)
            near = np.minimum(np.searchsorted(self.keys, prints), len(self.keys) - 1)
            until: dict[tuple[int, int], int] = {}
            for i in np.flatnonzero(self.keys[near] == prints):
                p = int(at[i])
                for item, q in self.places[int(prints[i])]:
                    item_id, own, least = self.items[item]
                    if until.get((item, p - q), -1) > p:
                        continue
                    a = b = 0
                    while p - a and q - a and words[p - a - 1] == own[q - a - 1]:
                        a += 1
                    while p + b < len(words) and q + b < len(own) and words[p + b] == own[q + b]:
                        b += 1
                    until[item, p - q] = p + b
                    if a + b >= least:
                        hit[p - a : p + b] = True
                        found.add(item_id)
        return hit, sorted(found)


#: The index of the benchmark that this worker last saw, by a name of its own.
_INDEXES: dict[str, Index] = {}


def _scan(spark: SparkSession, items: list[tuple[str, str | None]], window: int, gram: int, judge):
    """A function over Arrow batches: judge(batch, words of each text, their hits).

    The items, of a checked size, are a broadcast variable; a worker indexes them once for all its tasks.
    """
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[name] = Index(sent.value, window, gram)
        index = _INDEXES[name]
        for batch in batches:
            words = [split(t) for t in each(batch.column("text"))]
            yield judge(batch, words, [index.hits(w) for w in words])

    return scan


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """key (the hash of a text), items and n_hit of every text that is hit, by joins.

    Fingerprints meet first. Around each that does, a text's windows are rows, told by 128 bits of hash; they
    meet the windows of items. A text and an item are a pair only where they share a window, which
    the lists of items ask for, and no text is shipped for a pair. Equal texts are matched once.
    """
    items = materialize(benchmark.select(F.col("item_id").cast("string"), F.col("text").alias("item_text")).filter("item_text IS NOT NULL").distinct(), "items")
    lengths = items.select(F.least(F.lit(window), n_words_of(F.col("item_text"))).alias("n")).distinct()
    lengths = sorted(r.n for r in lengths.collect() if r.n)  # window values at most
    texts = docs.select("text").filter("text IS NOT NULL").distinct().select(F.sha2("text", 256).alias("key"), "text")
    texts = materialize(texts, "texts")
    hashed = lambda words: xxhash.xxh3_128_digest(" ".join(words))

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                h = numbers(split(text))
                for n in lengths:
                    f, at = winnow(h, n, gram)
                    if len(f):
                        yield pd.DataFrame({"key": key, "n": n, "print": f.view(np.int64), "at": at})

    def own_prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["item_text"]:
                h = numbers(split(text))
                if n := min(window, len(h)):
                    yield pd.DataFrame({"n": n, "print": winnow(h, n, gram)[0].view(np.int64)})

    def own_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item_id, text in zip(b["item_id"], b["item_text"], strict=True):
                words = split(text)
                if n := min(window, len(words)):
                    yield pd.DataFrame({"item_id": item_id, "w": [hashed(words[i : i + n]) for i in range(len(words) - n + 1)]})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, text, met in zip(b["key"], b["text"], b["met"], strict=True):
                words = split(text)
                starts = {(m["n"], i) for m in met for i in range(max(0, m["at"] + min(gram, m["n"]) - m["n"]), min(m["at"], len(words) - m["n"]) + 1)}
                if starts:
                    rows = [(key, i, i + n, hashed(words[i : i + n])) for n, i in sorted(starts)]
                    yield pd.DataFrame(rows, columns=["key", "a", "b", "w"])

    theirs = items.mapInPandas(own_prints, "n long, print long").distinct()
    ours = texts.mapInPandas(prints, "key string, n long, print long, at long").join(theirs, ["n", "print"], "left_semi")
    met = ours.groupBy("key").agg(F.collect_set(F.struct("n", "at")).alias("met"))  # no more than a text has fingerprints
    near = texts.join(met, "key").mapInPandas(windows, "key string, a long, b long, w binary")
    kept = materialize(items.mapInPandas(own_windows, "item_id string, w binary").distinct(), "item-windows")
    hit = materialize(near.join(kept.select("w").distinct(), "w", "left_semi"), "hit-windows")
    found = hit.select("key", "w").distinct().join(kept, "w").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    per_text = hit.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate("runs", start, lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")))["n"]
    return per_text.join(found, "key").select("key", "items", union.alias("n_hit"))


def n_words_of(text: Column) -> Column:
    found = F.regexp_count(F.translate(text, ASCII_UPPER, ASCII_LOWER), F.lit(find_words.__self__.pattern))
    return F.coalesce(found, F.lit(0)).cast("long")


def _items(benchmark: DataFrame, broadcast_chars: int) -> tuple[DataFrame, list | None]:
    """The items with their ids as strings; also as a list if their size allows it."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    chars = named.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first().n
    return named, [(r.item_id, r.text) for r in named.collect()] if chars <= broadcast_chars else None


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, items.

    A document word inside any occurrence of an item's window is hit; items are the ids, as
    strings, of the items with windows that occur. A benchmark of a checked size goes to
    every task, and documents aren't shuffled; a larger one is joined.
    """
    named, items = _items(benchmark, broadcast_chars)
    if items is None:
        counted = docs.select("doc_id", F.sha2("text", 256).alias("key"), n_words_of(F.col("text")).alias("n_words"))
        return counted.join(_joined(docs, named, window, gram), "key", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )

    def rows(batch, words, hits):
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(map(len, words), pa.int64()),
                pa.array([int(h.sum()) for h, _ in hits], pa.int64()),
                pa.array([x for _, x in hits], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "items"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan(docs.sparkSession, items, window, gram, rows), f"doc_id {kind}, n_words long, n_hit long, items array<string>")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    named, items = _items(benchmark, broadcast_chars)
    if items is None:
        bad = _joined(docs, named, window, gram)
        keyed = docs.select(F.struct("*").alias("doc"), F.sha2("text", 256).alias("key")).join(bad, "key", "left")
        return keyed.filter(~F.coalesce(contaminated(F.col("n_hit"), n_words_of(F.col("doc.text"))), F.lit(False))).select("doc.*")

    def rows(batch, words, hits):
        return batch.filter(pa.array([not (n := int(h.sum())) or 20 * n < len(w) for w, (h, _) in zip(words, hits, strict=True)], pa.bool_()))

    return docs.mapInArrow(_scan(docs.sparkSession, items, window, gram, rows), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )
