"""Python in tasks holds a few rows of a batch at a time, and gives back all of them."""

import json

import pyarrow as pa
import pytest

from leafmill.functions import batches
from leafmill.operators import chunking, model_output, news
from leafmill.plans import files
from leafmill.sources import readers

N = 1000


class Plan:
    """Takes the place of a DataFrame to get at the function of its batches."""

    dtypes = [("id", "bigint"), ("t", "string")]

    def select(self, *names):
        return self

    def mapInArrow(self, each, schema):  # noqa: N802
        return each


def test_pieces_are_bounded_by_rows_and_bytes_and_lose_nothing():
    batch = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array([None, "", "x" * 9, "y" * 30] * (N // 4))], ["id", "t"])
    got = list(batches.pieces(batch, 7, 40))
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist()
    assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(len(x or "") for x in p.column("t").to_pylist()) <= 40) for p in got)
    assert list(batches.pieces(batch.slice(0, 0))) == [] and [p.num_rows for p in batches.pieces(batch.slice(3, 2), 9, 1)] == [1, 1]


@pytest.mark.parametrize("each", [model_output._normals, model_output._repaired, news._all_origins])
def test_functions_of_columns_give_their_rows_in_pieces(each):
    texts = pa.array([json.dumps({"sentences": [str(i)], "bullets": []}) for i in range(N)])
    got = list(each(iter([texts if each is model_output._repaired else (texts, texts)])))
    assert max(map(len, got)) <= batches.ROWS and sum(map(len, got)) == N


def test_functions_of_batches_give_their_rows_in_pieces():
    docs = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array([f"text {i}" for i in range(N)])], ["id", "t"])
    cut = list(chunking.chunk(Plan(), "id", "t")(iter([docs])))
    made = list(files._made(Plan(), "txt", files._encoded)(iter([docs.rename_columns(["doc_id", "text"])])))
    read = list(readers.texts(Plan())(iter(made[:1] + [pa.Table.from_batches(made).combine_chunks().to_batches()[0]])))
    for got, n in ((cut, N), (made, N), (read, N + made[0].num_rows)):
        assert max(b.num_rows for b in got) <= batches.ROWS and sum(b.num_rows for b in got) == n
