"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone, so that every alphabet has
its own without a table. An n-gram binds its letters: their vectors, each rotated by how far the
letter stands from the end, are multiplied element by element. A text bundles its n-grams, that
is, adds their vectors, and a language bundles its texts. A document gets the language whose
bundle has the largest cosine with its own.

Text is lower-cased; what isn't a letter is a separator, runs of separators count as one, and a
text begins and ends with one. Bundles are whole numbers, so that reruns agree to the last bit. Null
texts and texts without a letter are `und`, with score 0; so is everything if there is nothing to
learn from. Ties go to the language that sorts first. Texts of any length are read whole, in pieces. Repeated rows count as often as they
occur. Only doc_id, text and lang are looked at, lang for learning alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import each, materialize, table

DIMENSIONS, GRAM = 1024, 3
UNKNOWN = "und"
#: Characters and texts that are counted at once, and languages that are compared at once.
BLOCK_CHARS, BLOCK_TEXTS, BLOCK_LANGS = 1 << 19, 256, 512
#: n-grams of so few symbols are numbered by a table, others by sorting.
TABLE = 1 << 24


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbol_vectors(symbols: np.ndarray, dimensions: int) -> np.ndarray:
    """A vector of +1 and -1 for each symbol; 0 is the separator."""
    words = symbols.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    bits = np.unpackbits(mixed(words).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """grams: rows of symbols -> the bound vector of each, as float32 for the products that follow."""
    symbols, at = np.unique(grams, return_inverse=True)
    at, vectors = at.reshape(grams.shape), symbol_vectors(symbols, dimensions)
    bound = vectors[at[:, -1]]
    for k in range(1, grams.shape[1]):
        bound *= np.roll(vectors, k, axis=1)[at[:, -1 - k]]
    return bound.astype(np.float32)


def gram_counts(pieces: list[tuple[int, str]], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pieces(owner, text) -> distinct n-grams, and for each occurrence its owner and the number of its n-gram.

    An n-gram begins at every place of a piece but the last ones; those with two separators together don't count.
    """
    raw = np.frombuffer("".join(t for _, t in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for _, t in pieces])
    symbols = np.where(letters()[raw], raw, 0)
    inside = np.ones(len(symbols), bool)
    for k in range(1, gram):
        inside[np.cumsum(lens) - k] = False
    at = [symbols[k : len(symbols) - gram + 1 + k] for k in range(gram)]
    good = inside[: len(symbols) - gram + 1].copy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        good &= (a != 0) | (b != 0)
    owner = np.repeat(np.array([o for o, _ in pieces]), lens)[: len(good)][good]
    seen = np.zeros(0x110000, bool)
    seen[symbols] = True
    known = np.flatnonzero(seen)
    if len(known) ** gram <= TABLE:
        number = np.zeros(0x110000, np.int32)
        number[known] = np.arange(len(known))
        key = np.zeros(int(good.sum()), np.int32)
        for x in at:
            key = key * len(known) + number[x[good]]
        found = np.flatnonzero(np.bincount(key, minlength=1))
        place = np.zeros(len(known) ** gram, np.int32)
        place[found] = np.arange(len(found))
        code = place[key]
        grams = np.stack([known[found // len(known) ** (gram - 1 - k) % len(known)] for k in range(gram)], axis=1)
    else:
        grams, code = np.unique(np.stack([x[good] for x in at], axis=1), axis=0, return_inverse=True)
    return grams, owner, code.reshape(-1)


def bundles(pieces: list[tuple[int, str]], owners: int, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each owner's n-grams, and how many there are; exact, as float32 holds whole numbers of this size."""
    grams, owner, code = gram_counts(pieces, gram)
    counts = np.bincount(owner * len(grams) + code, minlength=owners * len(grams)).reshape(owners, -1).astype(np.float32)
    return (counts @ gram_vectors(grams, dimensions)).astype(np.int64), counts.sum(axis=1)


def cut(text: str, gram: int = GRAM) -> Iterator[str]:
    """A text, with its outer separators, in pieces that overlap so that each n-gram is in one."""
    full = f" {text.lower()} "
    for i in range(0, max(1, len(full) - gram + 1), BLOCK_CHARS):
        yield full[i : i + BLOCK_CHARS + gram - 1]


def blocks(texts: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Pieces of texts, about BLOCK_CHARS and at most BLOCK_TEXTS at a time."""
    held, size = [], 0
    for owner, text in texts:
        for piece in cut(text):
            held.append((owner, piece))
            size += len(piece)
            if size >= BLOCK_CHARS or len(held) >= BLOCK_TEXTS:
                yield held
                held, size = [], 0
    if held:
        yield held


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """docs(text, lang) -> lang, profile: the bundle of all texts of each language; what lacks either teaches nothing.

    Tasks add up their texts by language; the sums of all tasks meet by language and dimension.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = list(dict.fromkeys(langs))
            number = {x: i for i, x in enumerate(names)}
            for block in blocks((number[x], t) for x, t in zip(langs, each(batch.column("text")), strict=True)):
                present = {o: k for k, o in enumerate(dict.fromkeys(o for o, _ in block))}
                made, _ = bundles([(present[o], t) for o, t in block], len(present), dimensions, gram)
                for o, v in zip(present, made, strict=True):
                    sums[names[o]] = sums.get(names[o], 0) + v
            if len(sums) > BLOCK_LANGS:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "profile"])

    texts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    parts = texts.mapInArrow(add, "lang string, profile array<long>").select("lang", F.posexplode("profile").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    profile = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"])
    return sums.groupBy("lang").agg(profile.alias("profile"))


def predict(docs: DataFrame, profiles: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns but text, lang_pred and score, the cosine (0 if it is below).

    Languages are compared by blocks, each in a pass that keeps the best so far; a pass carries at
    most BLOCK_LANGS profiles to the tasks, and up to that number of languages there is just one.
    """
    own = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    found = docs.select(F.struct(*own).alias("own"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    profiles = materialize(profiles.repartitionByRange("lang").sortWithinPartitions("lang"), "profiles")
    last = None
    while True:
        rest = profiles if last is None else profiles.filter(F.col("lang") > last)
        block = rest.orderBy("lang").limit(BLOCK_LANGS).collect()
        if not block:
            break
        found = found.mapInArrow(_compare([r["lang"] for r in block], np.array([r["profile"] for r in block], np.float64), dimensions, gram), found.schema)
        last = block[-1]["lang"]
        if len(block) < BLOCK_LANGS:
            break
    return found.select("own.*", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _compare(names: list[str], profiles: np.ndarray, dimensions: int, gram: int):
    norms = np.sqrt((profiles**2).sum(axis=1))
    unit = profiles / np.where(norms == 0, 1, norms)[:, None]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            langs, scores = batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy(zero_copy_only=False).copy()
            sums: dict[int, np.ndarray] = {}
            done = 0

            def judge(upto: int) -> None:
                """Compares the documents before upto, whose bundles are whole."""
                for i in [i for i in sums if i < upto]:
                    vector = sums.pop(i)
                    cosines = unit @ vector / (np.sqrt((vector * vector).sum()) or 1)
                    best = int(np.argmax(cosines))
                    if langs[i] == UNKNOWN or cosines[best] > scores[i]:
                        langs[i], scores[i] = names[best], float(cosines[best])

            for block in blocks((i, t) for i, t in enumerate(each(texts)) if t):
                present = list(dict.fromkeys(o for o, _ in block))
                number = {o: k for k, o in enumerate(present)}
                made, n = bundles([(number[o], t) for o, t in block], len(present), dimensions, gram)
                for k in np.flatnonzero(n).tolist():
                    sums[present[k]] = sums.get(present[k], 0) + made[k].astype(np.float64)
                done = present[-1]
                judge(done)
            judge(done + 1)
            yield pa.RecordBatch.from_arrays([batch.column("own"), texts, pa.array(langs, pa.string()), pa.array(scores)], ["own", "text", "lang_pred", "score"])

    return compare


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))))
    judged = predict(docs.select("doc_id", "text"), profiles)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
