"""Queries give the rows of their SQL for texts that are missing, empty, blank or hold marks of their own output, and for missing and repeated ids."""

import duckdb
import pytest

from leafmill.operators import display
from leafmill.plans.registry import ORACLES, QUERIES

TEXTS = [None, "", "   ", "\n\n", "\t", "\ttab", " two\r\nlines\r\n", "a\x85b c", "said — 依据：x and more", "said - 依据：y", "— 依据：", "：colon", "**b**：c", "## 总结", "]", "]} \"x\", [ and more", "b1", "b1：", "first\n- b2：second\n- b3：third", "结构化要点:\n- b1：x\n- b2：a body that says enough\ny"]


@pytest.mark.parametrize("name", ["cards_structured", "summary_texts"])
def test_rows_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in range(168 * k, 168 * k + 168)]  # each with all remainders
    rows += [(i, t) for k, t in enumerate(TEXTS) for i in (None, k, 400)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    found = QUERIES[name](spark, str(tmp_path))
    sql = duckdb.connect()
    sql.sql(f"create view documents as select * from '{path}/*.parquet'")
    want = sql.sql(ORACLES[name])
    columns = [f'"{c}"' for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_the_last_mark_begins_the_citation(spark):
    rows = {"x 　 — 依据：y": "x", "x — 依据：y - 依据：z": "x — 依据：y", "— 依据：y": "", "no mark —依据：": "no mark —依据：", "two\nlines — 依据：y\nz": "two\nlines"}
    got = spark.createDataFrame([(k,) for k in rows], "x string").select("x", display.without_citation("x").alias("y")).collect()
    assert {r.x: r.y for r in got} == rows
