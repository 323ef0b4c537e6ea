"""The stored index is written in one pass over its rows, and keeps no bodies."""

import numpy as np
import pyarrow as pa

from leafmill.operators import fulltext
from leafmill.sources.shared import folder

KIND = "kind string, book_id string, segment_id long, note_id long, idx int, title string, body string"


def test_bodies_are_read_once_and_never_stored(spark, monkeypatch):
    kept, real = [], fulltext.stored
    monkeypatch.setattr(fulltext, "stored", lambda df, name: kept.append(df.columns) or real(df, name))
    rows = spark.createDataFrame([("segment", "b", i % 7 or None, None, i, f"title {i}", "many words " * i) for i in range(40)], KIND).repartition(3)
    index = fulltext.Index.build(rows, folder(spark, "index"), 8)
    index = index.put(spark.createDataFrame([("segment", "b", 3, None, 1, "title x", "other words")], KIND))
    assert not [c for c in kept if "body" in c]
    # each row has one number, in its head and in its lists
    held = {r.row_no for r in index.rows.collect()}
    assert len(held) == index.n_rows and held == {r.row_no for r in index.lengths().join(index.gone, "row_no", "left_anti").collect()}
    told = {r.row_no: r.n_grams for r in index.rows.collect()}
    assert told == {r.row_no: r.n_grams for r in index.lengths().collect() if r.row_no in held}
    # an empty change, and one of texts without a trigram, leave a whole index
    index = index.put(rows.limit(0)).put(spark.createDataFrame([("note", "b", 3, 1, 1, "", None), ("note", "b", 3, 2, 1, "a", "b")], KIND))
    assert index.n_rows == len(held) + 2 == index.rows.count()


def test_counts_and_planes_of_any_size_come_back():
    n = np.array([1, 127, 128, 16383, 16384, 2_000_000, 1, 2**31 - 1])
    counts = fulltext._counts(n, np.array([0, 3, 3, 8]))
    assert fulltext._counted_back(counts).tolist() == n.tolist() and fulltext._counted_back(pa.chunked_array([counts.slice(1), counts.slice(0, 1)])).tolist() == [*n[3:], *n[:3]]
    assert fulltext._counted_back(counts.slice(0, 0)).tolist() == []
    head = [pa.array([0, 1, 2], pa.int32()), pa.array(["abc", "abd", "abe"]), pa.array([1, 1, 1], pa.int32())]
    at = np.array([0, 5, 3, 70_000, 20_000_000, 1, 2])  # rows 4, 9 and 9, 12 and 7
    made = fulltext._packed(*head, np.array([0, 2, 4, 5]), np.array([4, 9, 9, 12, 7]), np.array([0, 2, 3, 5, 6]), at)
    assert [made.column(b).null_count for b in fulltext.PLANES] == [0, 2, 2, 2]
    of, rows, starts, places = fulltext._postings(made)
    assert of.tolist() == [0, 0, 1, 1, 2] and rows.tolist() == [4, 9, 9, 12, 7] and starts.tolist() == [0, 2, 3, 5, 6, 7] and places.tolist() == at.tolist()
