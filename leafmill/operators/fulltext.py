"""A stored trigram index: posting lists as Parquet, kept up to date bucket by bucket, searched without reading a text.

The index is four tables in one folder, each partitioned by `batch`, the number of the change that wrote it:
- `rows`: what can be found, each with a number of its own, its title and its length in trigrams;
- `postings`: also partitioned by bucket (a hash of the trigram). A list for each trigram and field of a run of rows:
  the rows that hold the trigram, how often, and where, in order: the gaps between places, their bytes apart by weight,
  which compress best so; bytes that are all zero are left out. Each task inverts its rows run by run and writes its
  lists to their buckets, so that postings are never shuffled, sorted or stored twice. The same pass numbers the rows
  and writes their heads, which is all but the bodies, to a bucket of their own: bodies are never stored or shuffled,
  and what is joined to the rows is joined to the heads;
- `gone`: numbers of rows that were changed or removed;
- `live`: for each bucket, which batch wrote to it last and from which on its lists count, and how many rows and
  trigrams there are in all.

A change writes new files only, and `live` last: until then readers see the index as it was. It adds lists to the
buckets of the trigrams that its rows have; those of rows that are gone stay until `compact`, and readers leave them out.

A search reads the query's text as phrases under AND, OR and NOT (see match.py), and then the postings of the phrases'
trigrams alone: a phrase occurs where its trigrams follow each other. The rank is BM25 over all phrases. A query that
can't be read gives one row with its error; one without any trigram finds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import match
from leafmill.operators.search import K1, B
from leafmill.sources.shared import stored

FIELDS = match.FIELDS
KEY = ["kind", "book_id", "segment_id", "note_id"]
#: Characters of the rows that share a posting list (a longer row has lists of its own), and buckets of trigrams.
RUN_CHARS, BUCKETS = 2_000_000, 64
#: Numbers of rows in which a search looks at a time.
BLOCK_ROWS = 1024
LISTS = "bucket int, gram string, field int, rows array<long>, n binary, b0 binary, b1 binary, b2 binary, b3 binary"
LIST_NAMES = [c.split()[0] for c in LISTS.split(", ")]
PLANES = LIST_NAMES[-4:]
#: What a row has besides its body, and the bucket of the heads.
HEAD, HEADS = "row_no long, kind string, book_id string, segment_id long, note_id long, idx int, title string, n_body long", -1
HEAD_NAMES = [c.split()[0] for c in HEAD.split(", ")]
ROWS = "row_no long, kind string, book_id string, segment_id long, note_id long, idx int, title string, n_grams long"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def bucket_of(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def _counts(n: np.ndarray, lists: np.ndarray) -> pa.Array:
    """Numbers over 0 as bytes of 7 bits, the highest marked by a bit; lists: where each list begins among them, and the end."""
    out = np.stack([(n >> 7 * k & 0x7F).astype(np.uint8) for k in range(5)], 1)
    size = 1 + sum((n >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    out[np.arange(len(n)), size - 1] |= 0x80
    ends = np.append(0, np.cumsum(size))[lists]
    return pa.Array.from_buffers(pa.binary(), len(lists) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out[np.arange(5) < size[:, None]])])


def _counted_back(counts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The numbers of _counts(), of all lists."""
    data = np.frombuffer(b"".join(counts.to_pylist()), np.uint8)
    ends = np.flatnonzero(data & 0x80)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    weight = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << 7 * weight, starts) if len(starts) else np.zeros(0, np.int64)


def _plane(of: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each list, null where they are all zero."""
    some = np.diff(np.append(0, np.cumsum(of != 0))[ends]) > 0
    size = np.diff(ends)
    held = of if some.all() else of[ends[0] : ends[-1]][np.repeat(some, size)]
    offsets = np.append(0, np.cumsum(np.where(some, size, 0))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [pa.array(some).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])


def _packed(bucket: pa.Array, gram: pa.Array, field: pa.Array, lists: np.ndarray, row_nos: np.ndarray, starts: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Lists of postings: where each list begins among the postings, their rows, where each begins among the places, and these."""
    gaps = np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    gaps = gaps.astype("<u4")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    rows = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(row_nos.astype(np.int64)))
    ends = np.append(starts, len(at))[lists]
    held = [rows, _counts(np.diff(starts, append=len(at)), lists), *(_plane(p, ends) for p in planes)]
    return pa.RecordBatch.from_arrays([bucket, gram, field, *held], LIST_NAMES)


def _inverted(row_nos: np.ndarray, texts: list[str], field: int, buckets: int) -> pa.RecordBatch | None:
    """The lists of a field of a run of rows, by trigram."""
    folded = [match.folded(t) for t in texts]
    sizes = np.array([len(t) for t in folded], np.int64)
    ends = np.cumsum(sizes)
    chars = np.frombuffer("".join(folded).encode("utf-32-le"), "<u4")
    begins = np.ones(len(chars), bool)
    last = np.concatenate([ends - 1, ends - 2])
    begins[last[last >= 0]] = False  # a trigram lies within its text
    at = np.flatnonzero(begins)
    if not len(at):
        return None
    gram = chars[at].astype(np.int64)
    for k in (1, 2):
        gram <<= 21
        gram |= chars[at + k]
    del chars, begins, last, folded
    order = np.argsort(gram, kind="stable")  # rows and places stay in order
    gram, at = gram[order], at[order]
    del order
    row = np.searchsorted(ends, at, "right")
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    starts = np.flatnonzero(new | np.concatenate([[True], row[1:] != row[:-1]]))
    lists = np.flatnonzero(new[starts])
    codes = gram[starts[lists]]
    joined = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    grams = [joined[i : i + 3] for i in range(0, len(joined), 3)]
    heads = pa.array([bucket_of(g, buckets) for g in grams], pa.int32()), pa.array(grams), pa.array(np.full(len(grams), field, np.int32))
    return _packed(*heads, np.append(lists, len(starts)), row_nos[row[starts]], starts, at - (ends - sizes)[row])


def _lists(rows: DataFrame, buckets: int, fields: tuple[str, ...] = FIELDS, heads: bool = False) -> DataFrame:
    """rows(row_no, title, body, or one of both) -> the lists of the runs of each task's rows; with heads, also a row for each head."""
    names = [f for f in fields if f in rows.columns]
    head_type = pa.struct([(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for c, kind in (x.split() for x in HEAD.split(", "))])

    def headed(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pa.StructArray.from_arrays([batch.column(f.name).cast(f.type) for f in head_type], fields=list(head_type))
        n = batch.num_rows
        none = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, HEADS, np.int32)), *none, held], [*LIST_NAMES, "head"])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if heads:
                yield headed(batch)
            sizes = sum(np.asarray(pc.fill_null(pc.utf8_length(batch.column(c)), 0), np.int64) for c in names)
            run = np.cumsum(sizes) // RUN_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                row_nos = np.asarray(part.column("row_no"), np.int64)
                for name in names:
                    made = _inverted(row_nos, [t or "" for t in part.column(name).to_pylist()], FIELDS.index(name), buckets)
                    if made is not None and heads:
                        made = pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, head_type)], [*LIST_NAMES, "head"])
                    if made is not None:
                        yield made

    if heads:
        return rows.select(*HEAD_NAMES, *[f for f in names if f not in HEAD_NAMES]).mapInArrow(invert, f"{LISTS}, head struct<{HEAD}>")
    return rows.select("row_no", *names).mapInArrow(invert, LISTS)


@contextmanager
def _unsorted(spark: SparkSession, writers: int) -> Iterator[None]:
    """Writes in here keep a file open for each of so many partitions, and don't sort a task's rows by partition first."""
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(writers))
    try:
        yield
    finally:
        spark.conf.set(WRITERS, before)


def _postings(lists: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting: its list, its row, where it begins among the places; and all places."""
    n, rows = _counted_back(lists.column("n")), np.asarray(pc.list_flatten(lists.column("rows")), np.int64)
    starts = np.append(0, np.cumsum(n))
    size = np.asarray(pc.list_value_length(lists.column("rows")), np.int64)
    places = np.diff(starts[np.append(0, np.cumsum(size))])
    gaps = np.zeros(starts[-1], np.int64)
    for k, name in enumerate(PLANES):
        held = lists.column(name)
        if held.null_count < len(held):
            some = np.repeat(np.asarray(pc.is_valid(held)), places)
            gaps[some] |= np.frombuffer(b"".join(x for x in held.to_pylist() if x is not None), np.uint8).astype(np.int64) << 8 * k
    sums = np.append(0, np.cumsum(gaps))
    of = np.repeat(np.arange(lists.num_rows), size)
    return of, rows, starts, sums[1:] - np.repeat(sums[starts[:-1]], n)


def _unlisted(lists: DataFrame) -> DataFrame:
    """bucket, gram, field, row_no, places: a row for each posting."""
    names = ["bucket", "gram", "field", "row_no", "places"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                of, rows, starts, at = _postings(b)
                places = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of)) for c in names[:3]), pa.array(rows), places], names)

    return lists.select(*LIST_NAMES).mapInArrow(unpack, "bucket int, gram string, field int, row_no long, places array<int>")


def _in_blocks(lists: DataFrame) -> DataFrame:
    """The same lists, packed as they were, cut at blocks of row numbers, with block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                of, rows, starts, at = _postings(b)
                if not len(of):
                    continue
                block = rows // BLOCK_ROWS
                heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])]))
                made = _packed(*(b.column(c).take(pa.array(of[heads])) for c in LIST_NAMES[:3]), np.append(heads, len(of)), rows, starts[:-1], at)
                yield pa.RecordBatch.from_arrays([pa.array(block[heads]), *made.columns], ["block", *LIST_NAMES])

    return lists.select(*LIST_NAMES).mapInArrow(cut, f"block long, {LISTS}")


def _met(phrases: list[match.Phrase], lists: pa.Table) -> pa.Table:
    """The lists of a block of rows -> row_no, and for each phrase the places where it begins, of rows that hold any."""
    of, row_nos, starts, places = _postings(lists)
    rows, number = np.unique(row_nos, return_inverse=True)
    keys = np.repeat(number.astype(np.int64) << 32, np.diff(starts)) | places  # row and place as one number
    name = np.array([f"{f}{g}" for f, g in zip(lists.column("field").to_pylist(), lists.column("gram").to_pylist(), strict=True)])[np.repeat(of, np.diff(starts))]
    at: dict[str, np.ndarray] = {}

    def begins(phrase: match.Phrase, field: str) -> np.ndarray:
        if field not in phrase.fields:
            return keys[:0]
        out = None
        for k, gram in enumerate(phrase.grams):
            which = f"{FIELDS.index(field)}{gram}"
            if which not in at:
                at[which] = np.sort(keys[name == which])
            out = at[which] if out is None else np.intersect1d(out, at[which] - k, assume_unique=True)
        return out[out & 0xFFFFFFFF == 0] if phrase.initial else out

    found = [[begins(p, f) for f in FIELDS] for p in phrases]
    held = np.unique(np.concatenate([x >> 32 for fields in found for x in fields]))
    lists_of = lambda x: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(x >> 32, held), len(x)).astype(np.int32)), pa.array((x & 0xFFFFFFFF).astype(np.int32)))
    structs = [pa.StructArray.from_arrays([lists_of(x) for x in fields], list(FIELDS)) for fields in found]
    return pa.Table.from_arrays([pa.array(rows[held]), *structs], ["row_no", *(f"p{k}" for k in range(len(phrases)))])


def _counted(lists: DataFrame) -> DataFrame:
    """gram, field, row_no, n: how often each row holds the trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                b = batch.slice(start, 64)
                of = pa.array(np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("rows")))))
                yield pa.RecordBatch.from_arrays([b.column("gram").take(of), b.column("field").take(of), pc.list_flatten(b.column("rows")), pa.array(_counted_back(b.column("n")))], ["gram", "field", "row_no", "n"])

    return lists.select("gram", "field", "rows", "n").mapInArrow(count, "gram string, field int, row_no long, n long")


class Index:
    """An index in a folder; rows are those of search.index()."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.batch, self.n_rows, self.n_grams, self.buckets_at, self.buckets_from = -1, 0, 0, {}, {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The state that the last whole change left."""
        live = spark.read.parquet(f"{path.rstrip('/')}/live")
        rows = live.filter(F.col("batch") == live.agg(F.max("batch")).first()[0]).collect()  # a row for each bucket
        out = cls(spark, path, len(rows))
        out.batch, out.n_rows, out.n_grams = rows[0]["batch"], rows[0]["n_rows"], rows[0]["n_grams"]
        out.buckets_at, out.buckets_from = {r["bucket"]: r["at"] for r in rows}, {r["bucket"]: r["since"] for r in rows}
        return out

    @classmethod
    def build(cls, rows: DataFrame, path: str, buckets: int = BUCKETS, placed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """placed: gives each row, without its body, its idx and title, where those need a join; see put()."""
        out = cls(rows.sparkSession, path, buckets)
        return out._changed(rows, None, placed)

    def _write(self, df: DataFrame, name: str, *partitions: str) -> None:
        out = df.withColumn("batch", F.lit(self.batch + 1)).write.mode("append").option("parquet.writer.version", "v2").option("compression", "zstd").option("parquet.enable.dictionary", str(name != "postings").lower())
        out.partitionBy("batch", *partitions).parquet(f"{self.path}/{name}")

    def _read(self, name: str, kind: str) -> DataFrame:
        if self.batch < 0:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}").filter(F.col("batch") <= self.batch)

    @property
    def gone(self) -> DataFrame:
        return self._read("gone", "row_no long, batch int").select("row_no")

    @property
    def rows(self) -> DataFrame:
        """row_no, the rows' keys, idx, title, n_grams of all that is in the index."""
        return self._read("rows", f"{ROWS}, batch int").drop("batch").join(self.gone, "row_no", "left_anti")

    def lists(self, grams: list[str] | None = None) -> DataFrame:
        """Posting lists of the trigrams, or all: only the files of their buckets are opened."""
        kind = f"{LISTS.removeprefix('bucket int, ')}, batch int, bucket int"
        of = set(range(self.buckets)) if grams is None else {bucket_of(g, self.buckets) for g in grams}
        by_batch: dict[int, list[int]] = {}
        for b in sorted(of & set(self.buckets_from)):
            by_batch.setdefault(self.buckets_from[b], []).append(b)
        there = F.lit(False)
        for batch, buckets in by_batch.items():
            there |= (F.col("batch") >= batch) & F.col("bucket").isin(buckets)
        found = self._read("postings", kind).filter(there)
        return (found if grams is None else found.filter(F.col("gram").isin(sorted(set(grams))))).drop("batch")

    def contents(self) -> DataFrame:
        """row_no, field, gram, n: what the lists hold of the rows that are in the index."""
        return _counted(self.lists()).join(self.gone, "row_no", "left_anti").select("row_no", "field", "gram", "n")

    def lengths(self) -> DataFrame:
        """row_no, n_grams: how many trigrams the lists hold of each row, those that are gone too."""
        return _counted(self.lists()).groupBy("row_no").agg(F.sum("n").alias("n_grams"))

    def _changed(self, rows: DataFrame, keys: DataFrame | None, placed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """The index after rows took the place of the rows with their keys, and after those with keys left."""
        length = lambda c: F.greatest(F.length(c) - 2, F.lit(0)).cast("long")
        first = (self._read("rows", "row_no long, batch int").agg(F.max("row_no")).first()[0] if self.batch >= 0 else None)
        start = 0 if first is None else first + 1
        fresh = rows.withColumn("row_no", F.monotonically_increasing_id() + start)  # fixed once it is stored, in the lists and the head alike
        fresh = fresh.select("row_no", *KEY, "idx", *FIELDS, length("body").alias("n_body"))
        self._store(_lists(fresh, self.buckets, FIELDS if placed is None else ("body",), heads=True))
        fresh = self.spark.read.schema(f"head struct<{HEAD}>, batch int, bucket int").parquet(f"{self.path}/postings").filter((F.col("batch") == self.batch + 1) & (F.col("bucket") == HEADS)).select("head.*")
        dropped = None
        if self.batch >= 0:
            left = fresh.select(*KEY) if keys is None else fresh.select(*KEY).unionByName(keys.select(*KEY))
            left = left.distinct().select(*[F.col(k).alias(f"{k}_of") for k in KEY])
            same = F.lit(True)
            for k in KEY:
                same &= F.col(k).eqNullSafe(F.col(f"{k}_of"))
            dropped = stored(self.rows.join(left, same, "left_semi").select("row_no", "n_grams"), "index-gone")
        heads = fresh if placed is None else placed(fresh).sort("row_no")  # lists of titles, too, lie in order
        self._write(heads.select("row_no", *KEY, "idx", "title", (length("title") + F.col("n_body")).alias("n_grams")), "rows")
        self._write((dropped if dropped is not None else fresh.select("row_no").limit(0)).select("row_no"), "gone")
        added = self.spark.read.schema(f"{ROWS}, batch int").parquet(f"{self.path}/rows").filter(F.col("batch") == self.batch + 1)
        sums = lambda df: tuple(x or 0 for x in df.agg(F.count(F.lit(1)), F.sum("n_grams")).first())
        (n, grams), (n_out, grams_out) = sums(added), sums(dropped) if dropped is not None else (0, 0)
        if placed is not None:
            self._store(_lists(added.select("row_no", "title"), self.buckets))
        return self._written(self.n_rows + n - n_out, self.n_grams + grams - grams_out, self.batch < 0)

    def _store(self, lists: DataFrame) -> None:
        """Lists, and heads, in their buckets; no reader sees them before _written()."""
        with _unsorted(self.spark, self.buckets + 1):
            self._write(lists, "postings", "bucket")

    def _written(self, n_rows: int, n_grams: int, whole: bool) -> Index:
        """The index with the lists that were stored besides those it has, or as the whole."""
        path = f"{self.path}/postings"
        touched = self.spark.read.schema("batch int, bucket int").parquet(path).filter((F.col("batch") == self.batch + 1) & (F.col("bucket") != HEADS)).distinct().collect()  # numbers below the number of buckets
        new = set(range(self.buckets)) if whole else {r["bucket"] for r in touched}
        at = self.buckets_at | dict.fromkeys(new, self.batch + 1)
        since = dict.fromkeys(at, self.batch + 1) if whole else self.buckets_from
        state = [(b, at[b], since[b], n_rows, n_grams) for b in sorted(at)]
        self._write(self.spark.createDataFrame(state, "bucket int, at int, since int, n_rows long, n_grams long").coalesce(1), "live")
        return Index.open(self.spark, self.path)

    def compact(self) -> Index:
        """The same index in one batch of lists, without those of rows that are gone; for now and then, as it deals all postings out anew."""
        held = _unlisted(self.lists()).join(self.gone, "row_no", "left_anti")
        run = F.floor(F.col("row_no") / 4096).alias("run")  # bounds a list
        made = held.groupBy("bucket", "gram", "field", run).agg(F.array_sort(F.collect_list(F.struct("row_no", "places"))).alias("held"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    b = batch.slice(start, 64)
                    lists = np.append(0, np.cumsum(np.asarray(pc.list_value_length(b.column("rows")), np.int64)))
                    places = b.column("places").flatten()
                    starts = np.append(0, np.cumsum(np.asarray(pc.list_value_length(places), np.int64)))[:-1]
                    yield _packed(*(b.column(c) for c in LIST_NAMES[:3]), lists, np.asarray(b.column("rows").flatten()), starts, np.asarray(places.flatten(), np.int64))

        lists = made.select("bucket", "gram", "field", F.col("held.row_no").alias("rows"), F.col("held.places").alias("places")).mapInArrow(pack, LISTS)
        self._store(lists)
        return self._written(self.n_rows, self.n_grams, True)

    def put(self, rows: DataFrame, placed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
        """Adds rows, or replaces those with the same keys.

        placed gets the rows without bodies, and returns each of them, once, with its idx and title: what needs joins and
        windows is thus dealt out without the bodies.
        """
        return self._changed(rows, None, placed)

    def remove(self, keys: DataFrame) -> Index:
        """Takes out the rows with these keys; what isn't there is no error."""
        none = self.spark.createDataFrame([], "kind string, book_id string, segment_id long, note_id long, idx int, title string, body string")
        return self._changed(none, keys)

    def occurrences(self, phrases: list[match.Phrase]) -> DataFrame:
        """row_no, and for each phrase the places where it begins, in each field: p0, p1, ..."""
        wanted = sorted({(FIELDS.index(f), g) for p in phrases for f in p.fields for g in p.grams})
        lists = self.lists([g for _, g in wanted])
        asked = F.lit(False)
        for field in range(len(FIELDS)):
            asked |= (F.col("field") == field) & F.col("gram").isin([g for f, g in wanted if f == field])
        kind = ", ".join(["row_no long", *(f"p{k} struct<{', '.join(f'{f}: array<int>' for f in FIELDS)}>" for k in range(len(phrases)))])
        met = _in_blocks(lists.filter(asked)).groupBy("block").applyInArrow(lambda lists: _met(phrases, lists), kind)
        return met.join(self.gone, "row_no", "left_anti")

    def search(self, query: str, limit: int | None = 30, snippet_of: str | None = "title") -> DataFrame:
        """The hits of a query, best first: keys, idx, title, rank, snippet (of the title) and error."""
        kind = "kind string, book_id string, segment_id long, note_id long, idx int, title string, rank double, snippet string, error string"
        try:
            tree, phrases = match.parse(query)
        except match.Unreadable as problem:
            return self.spark.createDataFrame([(*[None] * 8, str(problem))], kind)
        if not phrases:
            return self.spark.createDataFrame([], kind)
        counts = [sum((F.size(f"p{k}.{f}") for f in FIELDS), F.lit(0)) for k in range(len(phrases))]
        counted = self.occurrences(phrases).select("*", *[c.alias(f"f{k}") for k, c in enumerate(counts)])
        stats = counted.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(phrases))])
        hits = counted.filter(match.holds(tree, [F.col(f"f{k}") > 0 for k in range(len(phrases))])).join(self.rows, "row_no").crossJoin(F.broadcast(stats))  # a single row
        rank, mean = F.lit(0.0), self.n_grams / max(1, self.n_rows)
        for k in range(len(phrases)):
            f, n = F.col(f"f{k}"), F.col(f"n{k}")
            idf = F.log((self.n_rows - n + 0.5) / (n + 0.5))
            idf = F.when(idf <= 0, 1e-6).otherwise(idf)
            rank = rank - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("n_grams") / (mean or 1)))
        ranked = hits.withColumn("rank", rank)
        if limit is not None:
            ranked = ranked.orderBy("rank", *KEY).limit(limit)
        marked = match.snippet(F.col("title"), [(F.col(f"p{k}.title"), len(p.grams)) for k, p in enumerate(phrases)])
        return ranked.select(*KEY, "idx", "title", "rank", marked.alias("snippet"), F.lit(None).cast("string").alias("error"))
