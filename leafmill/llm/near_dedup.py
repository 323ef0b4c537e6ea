"""MinHash near-duplicates, with odd sketches between the bands and the exact check.

Documents are linked if their sets of word shingles have a Jaccard similarity of the threshold
or more; a group is a connected component. The steps:

1. One pass makes each text's set, MinHash samples, band hashes and odd sketch. Documents with
   equal sets become one node.
2. Nodes that share a band hash are a bucket. Its pivot, the member that meets most others, is
   compared with all members; nothing is compared all with all. Pairs pass the odd sketches,
   then the exact check on full sets, and links join components.
3. Where many members of buckets are left outside their pivot's component, further pivots are
   compared with the members outside their own, as long as each turn joins a share of them.
4. What is still apart is searched exactly, by differences to the pivot. Two linked sets x and y
   differ in few items, so D(x) and D(y), the items in which they differ from the pivot, must
   share many: an inequality between the four sizes says how many. So the rarest items of
   each D are keys, as many as any partner must meet one of, and a meeting counts if what
   follows in both orders can still reach the number. Members that differ from the pivot in
   places of their own, as copies of one text do, have no key in common.

The chance that a pair at the very threshold shares no band is 1.3e-7, and that its sketches
reject it is smaller (see bound()). Null and blank texts have an empty set: they stand alone.
A text with fewer words than a shingle is one shingle; texts of any length are read whole. Rows
with equal texts are one group, also if their doc_ids are equal or null; a group's id is its
least doc_id, null if it has none. An empty table gives an empty result. Other columns are carried
along, whatever their names; one named like a column of the result gives way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import each, materialize, table
from leafmill.llm.components import components
from leafmill.llm.decontamination import LOWER, numbers

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 5
SKETCH_BITS = 1024
#: Further pivots are tried while open pairs are more than so many times the bucket rows, so many
#: rounds at most, and while each round joins a tenth of what is apart. They change no result.
REST, ROUNDS = 8, 12
find_words = re.compile(r"[^\x20\x09-\x0D]+").findall
SEEDS = np.random.default_rng(20240229).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of its shingles."""
    words = find_words(text.translate(LOWER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(" ".join(words), seed=1)], np.uint64)
    h = numbers(words)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def samples(items: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set: its least item under each of many orders."""
    least = np.full(SEEDS.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        least = np.minimum(least, ((items[i : i + 2048, None] ^ SEEDS[0]) * SEEDS[1]).min(axis=0))
    return least


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of the samples of each band, and of the band's number."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed((out + row) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """A bitmap in which each sample, with its number, flips one bit."""
    at = mixed(least + np.arange(len(least), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def bound(percent: int) -> int:
    """The most bits in which the sketches of a linked pair differ, five and four deviations out.

    At the threshold the number of samples that differ is binomial; each of them flips two bits,
    and the expected differing bits are n/2 (1 - (1 - 2/n)^flips).
    """
    k, n, j = BANDS * ROWS, SKETCH_BITS, percent / 100
    flips = 2 * (k * (1 - j) + 5 * math.sqrt(k * j * (1 - j)))
    mean = n / 2 * (1 - (1 - 2 / n) ** flips)
    return math.ceil(mean + 4 * math.sqrt(n / 4 * (1 - (1 - 4 / n) ** flips)))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ: the population count of their exclusive or."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two odd sketches tell."""
    n, k = SKETCH_BITS, BANDS * ROWS
    return 1 + n / (4 * k) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * differing(a, b) / n))


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(own, mark, text) -> own, mark, n_shingles, key (of the set), bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, band_rows, sketches = [], [], [], []
            for text in each(batch.column("text")):
                items = shingles(text, shingle)
                sizes.append(len(items))
                least = samples(items) if len(items) else None
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                band_rows.append(bands(least) if len(items) else None)
                sketches.append(odd_sketch(least) if len(items) else None)
            longs = pa.list_(pa.int64())
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_rows, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("mark"), *made], ["own", "mark", "n_shingles", "key", "bands", "sketch"])

    return docs.mapInArrow(sign, f"own {docs.schema['own'].dataType.simpleString()}, mark long, n_shingles long, key binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, items: the sets of nodes(node, key, rep, mark), from the texts of one document each.

    A document is found by its id and its text's hash, so that null and repeated ids meet no other texts.
    """
    same = F.col("own.doc_id").eqNullSafe(F.col("rep.doc_id")) & (docs["mark"] == F.col("rep.mark"))
    found = docs.join(nodes, same).select("node", "key", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(node, s.tobytes()) for node, key, text in zip(*(each(batch.column(x)) for x in ("node", "key", "text")), strict=True) if xxhash.xxh3_128_digest((s := shingles(text, shingle)).tobytes()) == key]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "items"])

    return found.mapInArrow(make, "node long, items binary").dropDuplicates(["node"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with the sizes of their full sets' intersection and union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                union.append(len(x) + len(y) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "common", "whole"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long, common long, whole long")


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _left(members: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Buckets with members of several components: their pairs across, rows, parts, and a pivot with its root."""
    chosen = F.xxhash64("node", F.lit(turn))
    per_root = _with_roots(members, roots).groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", chosen).alias("node"))
    pairs = ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")
    found = per_root.groupBy("bucket").agg(pairs, F.sum("n").alias("rows"), F.count(F.lit(1)).alias("parts"), F.min_by(F.struct("node", "root"), chosen).alias("pivot"))
    return materialize(found.filter("pairs > 0"), "open-buckets")


def _differences(held: DataFrame, sets: DataFrame) -> DataFrame:
    """held(p, node, root, inside) -> also n and np, the sizes of both sets, and items: those in one of them only."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "node", "root", "inside"]
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y"))
            items = [np.setxor1d(a, b, assume_unique=True).view(np.int64) for a, b in zip(x, y, strict=True)]
            made = [pa.array(map(len, x), pa.int64()), pa.array(map(len, y), pa.int64()), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n", "np", "items"])

    both = held.join(sets.select("node", F.col("items").alias("x")), "node").join(sets.select(F.col("node").alias("p"), F.col("items").alias("y")), "p")
    return both.select("p", "node", "root", "inside", "x", "y").mapInArrow(differ, "p long, node long, root long, inside boolean, n long, np long, items array<long>")


def _candidates(star: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that can be linked, among the nodes of each pivot in star(p, node).

    With d the number of items in which a node differs from the pivot, a pair is linked if
    d(x) + d(y) - 2 common <= most (n(x) + n(y)), most = (1 - s) / (1 + s). So for the lesser d,
    all but n (1 - s) / 2s items are common, for the greater all but n (1 - s) / s; and a node of
    the pivot's own component has partners outside it, which are far from the pivot.
    Items that occur in one component only can't be common: they come first, and are no keys.
    """
    ends = _with_roots(star, roots).join(roots.select(F.col("node").alias("p"), F.col("root").alias("of_p")), "p", "left")
    ends = ends.select("p", "node", "root", (F.col("root") == F.coalesce("of_p", "p")).alias("inside"))
    apart = ends.filter(~F.col("inside")).select("p").distinct()
    diffs = materialize(_differences(ends.join(apart, "p", "left_semi"), sets), "differences")
    items = diffs.select("p", "node", "root", F.explode("items").alias("item"))
    shared = items.groupBy("p", "item").agg(F.count(F.lit(1)).alias("rank"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = shared.filter("low <> high").select("p", "item", "rank")
    order = items.join(shared, ["p", "item"]).groupBy("p", "node").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("shared"))
    less, more, d, n = 100 - percent, 100 + percent, F.size("items"), F.col("n")
    own = d - F.size("shared")
    within = F.when(F.col("inside"), F.floor((more * d - less * (F.col("np") - n)) / (2 * more)) + 1).otherwise(d)
    keys = diffs.join(order, ["p", "node"]).select(
        "p", "node", "root", "n", d.alias("d"), own.alias("own"),
        F.least(within, F.floor(less * n / (2 * percent)) + 1).alias("short"), F.least(within, F.floor(less * n / percent) + 1).alias("long"), "shared",
    )
    keys = keys.filter("long > own").select("*", F.posexplode(F.slice("shared", 1, (F.col("long") - F.col("own")).cast("int"))).alias("i", "key")).select(
        "p", F.col("key.item").alias("item"), "node", "root", "n", "d", (F.col("own") + F.col("i")).alias("i"), "short"
    )
    keys = materialize(keys, "keys")
    x, y = keys.filter("i < short").alias("x"), keys.alias("y")
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    (xd, yd), (xn, yn), (xi, yi) = of("d"), of("n"), of("i")
    lesser = (xd < yd) | ((xd == yd) & (F.col("x.node") < F.col("y.node")))
    sizes = (100 * xn >= percent * yn) & (100 * yn >= percent * xn)
    reach = more * (xd + yd - 2 * F.least(xd - xi, yd - yi)) <= less * (xn + yn)
    same = (F.col("x.p") == F.col("y.p")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.root") != F.col("y.root"))
    met = x.join(y, same & lesser & sizes & reach)
    return met.select(F.least(*of("node")).alias("a"), F.greatest(*of("node")).alias("b")).distinct()


def _links(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root of all nodes of members(bucket, node, n) with a link; see steps 2 to 4 above."""
    a, b, most = F.col("a"), F.col("b"), bound(percent)
    near = differing(F.col("p.sketch"), F.col("q.sketch")) <= most
    fits = 100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")
    linked = 100 * F.col("common") >= percent * F.col("whole")
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(sketches.alias("p"), a == F.col("p.node")).join(sketches.alias("q"), b == F.col("q.node"))
        return materialize(_compared(pairs.filter(fits & near).select("a", "b"), sets), "compared")

    def joined(compared: DataFrame, roots: DataFrame | None) -> DataFrame:
        links = compared.filter(linked).select("a", "b")
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return materialize(components(links), "roots")

    weighed = members.join(members.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    pivots = weighed.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("p"))
    star = materialize(members.join(pivots, "bucket").filter("node <> p").select("p", "node").distinct(), "star")
    tested = compare(star.select(*ends("p", "node")))
    roots = joined(tested, None)
    before = math.inf
    for turn in range(ROUNDS):
        open_ = _left(members, roots, turn)
        left = open_.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("pairs", "rows", "parts")]).first()
        if not left["pairs"]:
            return roots
        if left["pairs"] <= REST * left["rows"] or left["parts"] > 0.9 * before:
            break
        before = left["parts"]
        pairs = _with_roots(members.select("bucket", "node"), roots).join(open_.select("bucket", "pivot"), "bucket").filter(F.col("root") != F.col("pivot.root"))
        found = compare(pairs.select(*ends("node", "pivot.node")).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        roots, tested = joined(found, roots), tested.unionByName(found)
    pairs = _candidates(star, roots, sets, percent)
    return joined(compare(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")), roots)


RESULT = ("n_shingles", "key", "root", "component_id", "kept")


def annotate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> all columns but text, n_shingles, key, root, component_id, kept.

    The root tells groups apart: ids can be null or repeated. Texts without words have none.
    """
    own = F.struct(*[x for x in docs.columns if x != "text" and x not in RESULT])
    texts = docs.select(own.alias("own"), F.xxhash64("text").alias("mark"), "text")
    rows = materialize(signed(texts, shingle), "signed")
    rep = F.min(F.struct(F.col("own.doc_id").alias("doc_id"), "mark")).alias("rep")
    nodes = rows.filter("key IS NOT NULL").groupBy("key").agg(rep, F.min("own.doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(banded.join(shared, "bucket"), "members")
    met = members.select("node").distinct()
    near = materialize(nodes.join(met, "node", "left_semi").select("node", "key", "rep", "n", "sketch"), "met")
    sets = materialize(_sets(texts, near.select("node", "key", "rep"), shingle), "sets")
    roots = _links(members, near.select("node", "n", "sketch"), sets, percent)
    groups = _with_roots(nodes.select("key", "least", "node"), roots).select("key", "least", "root")
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "root").select("key", "root", "component_id")
    found = rows.select("own", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("own.doc_id")).otherwise(F.col("component_id"))
    return found.select("own.*", "n_shingles", "key", "root", component.alias("component_id"), F.col("own.doc_id").eqNullSafe(component).alias("kept"))


def keep(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all columns; texts without words all stay.

    Of rows with the same doc_id in a group, one stays.
    """
    mark = F.xxhash64("doc_id", F.md5("text"))
    judged = annotate(docs.select("doc_id", "text", mark.alias("mark")), shingle, percent).filter("kept")
    single = judged.filter("key IS NOT NULL").groupBy("root").agg(F.min("mark").alias("mark"))
    marks = single.select("mark").unionByName(judged.filter("key IS NULL").select("mark")).distinct()
    stay = docs.select(F.struct("*").alias("doc"), mark.alias("mark")).join(marks, "mark", "left_semi")
    blank = F.coalesce(F.trim(F.translate("doc.text", "\t\n\x0b\x0c\r", "     ")), F.lit("")) == ""
    full = stay.filter(~blank).dropDuplicates(["mark"]).select("doc.*")
    return full.unionByName(stay.filter(blank).select("doc.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs, shingle=2).select("doc_id", "n_shingles", "component_id", "kept")
