"""How far the sources of a language lie apart, over the terms that many of its documents hold.

Which terms those are is found by iceberg prefix refinement. A prefix occurs in at least as many
documents as any term that begins with it, so the first level counts documents by the first few
bytes of their terms, and a prefix below the threshold takes all its terms with it. Each further
level extends the surviving prefixes, to twice the length, and counts again, until none is left
that goes on. A term that ends within a level is complete: its count is its own, and it is kept or not.

A task counts the terms of some megabytes of text as arrays and hands on packed rows, one for each
language and bucket of items; a bucket's rows are summed by array operations as well, and only
what is frequent leaves it. Survivors reach the next level as a bitmap of fixed size, whatever
their number: a prefix that only looks like a survivor costs a count, which then discards it.

Then each (language, source) group gives each kept term a smoothed share p, in billionths, and
- part `pair` sums |p - q| over the terms for every two groups of a language, in tiles of terms and sources,
- part `term` lists the terms that a group holds above the share q in the whole language.

All arithmetic is exact. Null text, lang and source are read as ''. Groups without terms occur
too; with no kept term at all, pairs have value 0. Repeated rows are documents of their own. Texts and terms
of any length are counted whole; a long term costs a level per doubling only while its prefix is
frequent. An empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, table

DOCUMENTS, ADD, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of the prefixes of the first level; each level takes twice as many.
FIRST_BYTES = 4
#: Bytes of text that a task counts at once, and bits of the map of survivors, as a power of two.
BLOCK_BYTES, MAP_BITS = 8 << 20, 26
#: A tile of the pair sums holds about so many terms, and sources on either side.
TILE_TERMS, TILE_SOURCES = 1024, 128
GROUP = ["lang", "source"]
#: Bytes of terms, once A-Z are lower-cased: a-z, and all of letters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
#: What one slice of terms has of each source.
PLACED = pa.schema([("lang", pa.string()), ("slice", pa.int64()), ("side", pa.int64()), ("source", pa.string()), ("codes", pa.binary()), ("n", pa.binary()), ("total", pa.int64())])
#: Takes the first m bytes of a word.
FIRST = np.array([(1 << 64) - (1 << (64 - 8 * m)) for m in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang, seed=13)


def hashed(seeds: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """63 bits, so that Spark's longs hold them too."""
    out = seeds
    for w in words:
        out = mixed((out ^ w) * np.uint64(0x9E3779B97F4A7C15))
    return out >> np.uint64(1)


class Terms:
    """The terms of some texts: where they begin, how long they are, and whose they are."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\0".join([b"", *texts, bytes(16)]).lower(), np.uint8)
        letter = LETTER[data]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.starts, ends = edges[::2], edges[1::2]
        self.lens = ends - self.starts
        begin = np.cumsum([1] + [len(x) + 1 for x in texts])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, begin)))
        self.words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of the terms at, as numbers; zeros where a term has ended."""
        left = np.clip(self.lens[at] - 8 * k, 0, 8)
        return self.words[np.minimum(self.starts[at] + 8 * k, len(self.words) - 1)].astype(np.uint64) & FIRST[left]

    def prefix(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        """The first n bytes, in words."""
        words = [self.word(at, k) for k in range(max(1, n // 8))]
        return words if n >= 8 else [words[0] & FIRST[n]]


def numbered(words: list[np.ndarray]) -> np.ndarray:
    """A number for each distinct row of words."""
    code = np.unique(words[0], return_inverse=True)[1]
    for w in words[1:]:
        code = np.unique(code.astype(np.int64) << 32 | np.unique(w, return_inverse=True)[1], return_inverse=True)[1]
    return code


def tally(terms: Terms, low: int, high: int, owner: np.ndarray, seeds: np.ndarray, survivors: np.ndarray | None, complete: bool):
    """owner, words, whole, n_docs, n: items of over low bytes, as their first high bytes, in the documents of each owner.

    Only what the map of survivors has counts: the first low bytes of an item, or complete items themselves.
    """
    at = np.flatnonzero((terms.lens > low) & (terms.lens <= high)) if complete else np.flatnonzero(terms.lens > low)
    if survivors is not None:
        place = hashed(seeds[terms.doc[at]], terms.prefix(at, high if complete else low)) >> np.uint64(63 - MAP_BITS)
        at = at[(survivors[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    if not len(at):
        return None
    words, doc = terms.prefix(at, high), terms.doc[at]
    code = numbered(words) * 2 + (terms.lens[at] <= high)
    size = int(code.max()) + 1
    where = np.empty(size, np.int64)
    where[code] = np.arange(len(code))
    found, n = np.unique(owner[doc].astype(np.int64) * size + code, return_counts=True)
    once = np.unique(doc.astype(np.int64) * size + code)
    n_docs = np.unique(owner[once // size].astype(np.int64) * size + once % size, return_counts=True)[1]
    own, code = np.divmod(found, size)
    return own, [w[where[code]] for w in words], code % 2, n_docs, n


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], list[bytes]]]:
    """Languages, sources and texts, some megabytes at a time."""
    held, size = ([], [], []), 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            for to, x in zip(held, (lang, source, text.as_py()), strict=True):
                to.append(x)
            size += len(held[2][-1])
            if size >= BLOCK_BYTES:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def packed(key_names: list[str], keys: list, order: np.ndarray, cuts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each run of order between cuts, with the bytes of its part of each column."""
    pieces = [pa.array(x) for x in keys]
    for values in columns.values():
        values = values[order]
        pieces.append(pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(pieces, [*key_names, *columns])


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where the runs begin and end."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order) - 1, bool)
    for k in keys:
        new |= k[order][1:] != k[order][:-1]
    return order, np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]])


def _read(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def _level(docs: DataFrame, low: int, high: int, survivors, buckets: int, threshold: int) -> DataFrame:
    """lang, item (high bytes, zeros after its end), hash, whole, n_docs, n of the frequent items of a level."""
    width = max(1, high // 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, _, texts in blocks(batches):
            names, owner = np.unique(np.array(langs, object), return_inverse=True)
            seeds = np.array([lang_seed(x) for x in names], np.uint64)
            made = tally(Terms(texts), low, high, owner, seeds[owner], None if survivors is None else np.frombuffer(survivors.value, np.uint64), False)
            if made is None:
                continue
            own, words, whole, n_docs, n = made
            bucket = (hashed(seeds[own], words) % np.uint64(buckets)).astype(np.int64)
            order, cuts = runs(own, bucket)
            first = order[cuts[:-1]]
            columns = {"items": np.stack(words, axis=1).astype(">u8"), "whole": whole.astype(np.int8), "n_docs": n_docs, "n": n}
            yield packed(["lang", "bucket"], [list(names[own[first]]), bucket[first]], order, cuts, columns)

    def merge(part: pa.Table) -> pa.Table:
        lang = part.column("lang")[0].as_py()
        joined = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
        items = joined("items", ">u8").reshape(-1, width).astype(np.uint64)
        words, whole = list(items.T), joined("whole", np.int8)
        code = numbered(words) * 2 + whole
        sums = np.zeros((2, int(code.max()) + 1), np.int64)
        for to, c in zip(sums, ("n_docs", "n"), strict=True):
            np.add.at(to, code, joined(c, np.int64))
        where = np.empty(sums.shape[1], np.int64)
        where[code] = np.arange(len(code))
        often = np.flatnonzero(sums[0] >= threshold)
        at = where[often]
        hashes = hashed(np.full(len(at), lang_seed(lang), np.uint64), [w[at] for w in words]).view(np.int64)
        rows = [x.tobytes() for x in items[at].astype(">u8")]
        return pa.table({"lang": pa.array([lang] * len(at), pa.string()), "item": pa.array(rows, pa.binary()), "hash": hashes, "whole": whole[at] == 1, "n_docs": sums[0][often], "n": sums[1][often]})

    counted = docs.mapInArrow(count, "lang string, bucket long, items binary, whole binary, n_docs binary, n binary")
    return counted.groupBy("lang", "bucket").applyInArrow(merge, "lang string, item binary, hash long, whole boolean, n_docs long, n long")


def _map(items: DataFrame):
    """A broadcast bitmap in which the place of each item's hash is set; at most 2^MAP_BITS bits, however many items there are."""
    place = F.shiftright("hash", 63 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = items.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return items.sparkSession.sparkContext.broadcast(bits.tobytes())


def buckets_of(spark: SparkSession) -> int:
    """Buckets follow the partitions that the session gives to shuffles, which follow its data."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_terms(docs: DataFrame, threshold: int = DOCUMENTS) -> tuple[DataFrame, list[int]]:
    """docs(lang, source, text) -> lang, item, hash, n_docs, n of the terms in threshold documents of the language or more (an item is a term and zeros), and the levels."""
    docs, buckets = _read(docs), buckets_of(docs.sparkSession)
    found, levels, low, high, survivors = [], [], 0, FIRST_BYTES, None
    while True:
        frequent = materialize(_level(docs, low, high, survivors, buckets, threshold), "frequent-prefixes")
        if survivors is not None:
            survivors.destroy()
        found.append(frequent.filter("whole").drop("whole"))
        levels.append(high)
        alive = frequent.filter("NOT whole")
        if alive.isEmpty():
            break
        survivors, low, high = _map(alive), high, 2 * high
    kept = found[0]
    for more in found[1:]:
        kept = kept.unionByName(more)
    return kept, levels


def share(n, total, terms):
    """1 + floor(SCALE (n + ADD) / (total + ADD terms)) of whole numbers or arrays of them, exactly."""
    if np.max(n, initial=0) >= (1 << 62) // SCALE:
        n = np.asarray(n, object)
    return (1 + SCALE * (n + ADD) // (total + ADD * terms)).astype(np.int64)


def _counts(docs: DataFrame, kept: DataFrame, levels: list[int], slices: int, sides: int) -> DataFrame:
    """lang, slice, side, source, codes, n, total: what each source holds of the kept terms of a slice.

    A code is a term's place among the slice's kept terms by UTF-8. Sums are made twice, first for
    some of the tasks each, so that no group holds the counts of all tasks.
    """
    survivors = _map(kept)
    salts = -(-2 * buckets_of(docs.sparkSession) // (slices * sides))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for turn, (langs, sources, texts) in enumerate(blocks(batches), task):
            group_of, names, owner = {}, [], np.empty(len(texts), np.int64)
            for i, g in enumerate(zip(langs, sources, strict=True)):
                if g not in group_of:
                    group_of[g] = len(names)
                    names.append(g)
                owner[i] = group_of[g]
            seeds = np.array([lang_seed(g[0]) for g in names], np.uint64)
            side = np.array([zlib.crc32(g[1].encode()) % sides for g in names])
            terms, low = Terms(texts), 0
            for high in levels:
                made = tally(terms, low, high, owner, seeds[owner], np.frombuffer(survivors.value, np.uint64), True)
                low = high
                if made is None:
                    continue
                own, words, _, _, n = made
                hashes = hashed(seeds[own], words)
                part = (hashes % np.uint64(slices)).astype(np.int64)
                order, cuts = runs(own, part)
                first = order[cuts[:-1]]
                of = [names[i] for i in own[first]]
                keys = [[g[0] for g in of], part[first], side[own[first]], [g[1] for g in of], np.full(len(first), high), np.full(len(first), turn % salts)]
                yield packed(["lang", "slice", "side", "source", "high", "salt"], keys, order, cuts, {"items": np.stack(words, axis=1).astype(">u8"), "n": n})

    def grouped(part: pa.Table) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """source, high, items as bytes, n: the rows of each source and level, put together."""
        rows: dict[tuple, list] = {}
        for source, high, items, n in zip(*(part.column(c).to_pylist() for c in ("source", "high", "items", "n")), strict=True):
            rows.setdefault((source, high), []).append((items, n))
        for (source, high), pieces in rows.items():
            width = 8 * max(1, high // 8)
            items, at = np.unique(np.frombuffer(b"".join(x for x, _ in pieces), f"S{width}"), return_inverse=True)
            total = np.zeros(len(items), np.int64)
            np.add.at(total, at, np.frombuffer(b"".join(x for _, x in pieces), np.int64))
            yield source, high, items, total

    def combine(part: pa.Table) -> pa.Table:
        made = [(source, high, items.tobytes(), n.tobytes()) for source, high, items, n in grouped(part)]
        same = [pa.array([part.column(c)[0].as_py()] * len(made)) for c in ("lang", "slice", "side")]
        return pa.table([*same, *(pa.array(x) for x in zip(*made, strict=True))], names=["lang", "slice", "side", "source", "high", "items", "n"])

    def place(counts: pa.Table, terms: pa.Table) -> pa.Table:
        code = {x: i for i, x in enumerate(sorted(x.rstrip(b"\0") for x in terms.column("item").to_pylist()))}
        held: dict[str, tuple[list, list]] = {}
        for source, _, items, n in grouped(counts) if counts.num_rows else ():
            for x, k in zip(items.tolist(), n.tolist(), strict=True):
                if (c := code.get(x)) is not None:  # else it only looked like a kept term
                    at = held.setdefault(source, ([], []))
                    at[0].append(c)
                    at[1].append(k)
        key = [counts.column(c)[0].as_py() if held else None for c in ("lang", "slice", "side")]
        rows = [(*key, source, *(np.array(x, np.int64).tobytes() for x in v), sum(v[1])) for source, v in held.items()]
        return pa.Table.from_pylist([dict(zip(PLACED.names, r, strict=True)) for r in rows], PLACED)

    keys = ["lang", "slice", "side"]
    counted = _read(docs).mapInArrow(count, "lang string, slice long, side long, source string, high long, salt long, items binary, n binary")
    summed = counted.groupBy(*keys, "salt").applyInArrow(combine, "lang string, slice long, side long, source string, high long, items binary, n binary")
    here = kept.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))).alias("side"))
    made = summed.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(place, "lang string, slice long, side long, source string, codes binary, n binary, total long")
    made = materialize(made, "term-counts")
    survivors.destroy()
    return made


def _pairs(held: DataFrame, groups: DataFrame, sides: int) -> DataFrame:
    """lang, source, item (another source), value: the sum of |p - q| over all kept terms.

    A tile has a slice of a language's terms, and two sides of its sources. Terms that neither of two groups has count
    by their number alone. The rows of a group are repeated once for each side, as the result has that many parts.
    """
    there = groups.filter("n_terms > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("slice"))
    rows = there.join(held.select(*GROUP, "slice", "codes", "n"), [*GROUP, "slice"], "left")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))).alias("other"))
    tiles = rows.select("lang", "slice", "source", "codes", "n", "total", "n_terms", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"))

    def compare(part: pa.Table) -> pa.Table:
        """For two groups: what their distance over the slice exceeds the distance of the shares of absent terms, summed over the terms that either has."""
        lang, x, y = (part.column(c)[0].as_py() for c in ("lang", "x", "y"))
        part = part.sort_by("source")
        names, side = part.column("source").to_pylist(), part.column("side").to_numpy()
        total, n_terms = part.column("total").to_numpy(), part.column("n_terms")[0].as_py()
        codes, counts = ([np.frombuffer(v or b"", np.int64) for v in part.column(c).to_pylist()] for c in ("codes", "n"))
        least = share(np.zeros(len(names), np.int64), total, n_terms)
        above = np.zeros((len(names), max((int(c.max()) for c in codes if len(c)), default=-1) + 1), np.int64)
        for i, (c, n) in enumerate(zip(codes, counts, strict=True)):
            above[i, c] = share(n, int(total[i]), n_terms) - least[i]
        made: dict[str, list] = {"a": [], "b": [], "extra": []}
        for i in np.flatnonzero(side == x):
            js = np.flatnonzero(side == y)
            js = js[js > i] if x == y else js
            gap = least[i] - least[js]
            extra = (np.abs(above[i] - above[js] + gap[:, None]) - np.abs(gap)[:, None]).sum(axis=1)
            for j, e in zip(js, extra.tolist(), strict=True):
                made["a"].append(min(names[i], names[j]))
                made["b"].append(max(names[i], names[j]))
                made["extra"].append(e)
        return pa.table({"lang": pa.array([lang] * len(made["a"]), pa.string()), "a": pa.array(made["a"], pa.string()), "b": pa.array(made["b"], pa.string()), "extra": pa.array(made["extra"], pa.int64())})

    extra = tiles.groupBy("lang", "slice", "x", "y").applyInArrow(compare, "lang string, a string, b string, extra long").groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))
    least = lambda s: 1 + F.call_function("div", F.lit(SCALE * ADD), F.nullif(F.col(f"{s}.total") + ADD * F.col(f"{s}.n_terms"), F.lit(0)))
    both = groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    both = both.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("a"), F.col("b.source").alias("b"), (F.col("a.n_terms") * F.abs(least("a") - least("b"))).alias("least"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    valued = both.join(extra, ["lang", "a", "b"], "left").select("lang", "a", "b", (zero("least") + zero("extra")).alias("value"))
    turned = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("ends")
    return valued.select("lang", turned, "value").select("lang", "ends.*", "value")


def _above(held: DataFrame, kept: DataFrame, groups: DataFrame, sides: int, ranks: int) -> DataFrame:
    """lang, source, item (a term of the group), value: by how much its share exceeds that in the language; the first ranks of each slice."""

    def best(counts: pa.Table, terms: pa.Table) -> pa.Table:
        made: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
        if counts.num_rows:
            terms = sorted(zip((x.rstrip(b"\0") for x in terms.column("item").to_pylist()), terms.column("n").to_pylist(), strict=True))
            whole = np.array([n for _, n in terms], np.int64)
            for row in counts.to_pylist():
                code, n = np.frombuffer(row["codes"], np.int64), np.frombuffer(row["n"], np.int64)
                value = share(n, row["total"], row["n_terms"]) - share(whole[code], row["lang_total"], row["n_terms"])
                over = np.flatnonzero(value > 0)
                for i in over[np.lexsort((code[over], -value[over]))][:ranks].tolist():
                    for c, x in (("lang", row["lang"]), ("source", row["source"]), ("item", terms[code[i]][0].decode()), ("value", int(value[i]))):
                        made[c].append(x)
        return pa.table({c: pa.array(x, pa.int64() if c == "value" else pa.string()) for c, x in made.items()})

    keys = ["lang", "slice", "side"]
    rows = held.drop("total", "side").join(groups.select(*GROUP, "side", "total", "lang_total", "n_terms"), GROUP)
    here = kept.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))).alias("side"))
    return rows.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(best, "lang string, source string, item string, value long")


def audit(docs: DataFrame, threshold: int = DOCUMENTS, ranks: int = RANKS, tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """docs(lang, source, text) -> lang, source, part, item, value, rank."""
    kept, levels = kept_terms(docs, threshold)
    sources = materialize(_read(docs).select(*GROUP).distinct(), "groups")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("n_terms"))
    most = langs.agg(F.max("n_terms").alias("terms")).crossJoin(sources.groupBy("lang").count().agg(F.max("count").alias("sources"))).first()
    slices, sides = -(-(most["terms"] or 1) // tile_terms), -(-(most["sources"] or 1) // tile_sources)
    kept = kept.withColumn("slice", F.col("hash") % slices)
    held = _counts(docs, kept, levels, slices, sides)
    sums = held.groupBy(*GROUP).agg(F.sum("total").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = sources.join(sums, GROUP, "left").join(langs, "lang", "left").select(
        *GROUP, (F.crc32(F.col("source").cast("binary")) % sides).alias("side"), F.lit(slices).alias("slices"), zero("total"), zero("lang_total"), zero("n_terms")
    )
    groups = materialize(groups, "groups")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(_pairs(held, groups, sides), "pair").unionByName(ranked(_above(held, kept, groups, sides, ranks), "term").filter(F.col("rank") <= ranks))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (
  SELECT row, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (
  SELECT lang, sum(n) AS total, CAST(count(*) AS HUGEINT) AS terms FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, t.term
), sums AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.terms) AS p,
         1 + (1000000000 * (k.n + 5)) // (l.total + 5 * l.terms) AS q
  FROM sums s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sums_of_pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums_of_pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), over AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
