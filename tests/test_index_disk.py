"""The stored index deals out no bodies while it is built."""

from pyspark.sql import functions as F

from leafmill.operators import fulltext
from leafmill.plans import found
from leafmill.sources.shared import folder


def test_bodies_are_stored_without_an_exchange(spark, tmp_path):
    docs = [(i, f"text {i} about a fox", f"src{i % 3}") for i in range(40)] + [(3, "a second three", "src0"), (None, "no number", "src1"), (50, "no book", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(5, 1, "user", "a fox note")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    d = str(tmp_path)
    plan = found._rows(spark, d).filter("kind = 'segment'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index = fulltext.Index.build(found._rows(spark, d), folder(spark, "index"), 8, found._placed(spark, d))
    rows = [r for r in index.rows.collect() if r.kind == "segment"]
    assert sorted((r.book_id, r.idx) for r in rows) == sorted((f"src{k}", i) for k, n in ((0, 15), (1, 14), (2, 13)) for i in range(n))
    assert all(r.title.lower() == f"book {r.book_id} · 段 {r.idx + 1}" for r in rows) and len(index.rows.collect()) == index.n_rows == 42 + 4 + 1
    hits = index.search("title:src1 body:fox", limit=None).collect()
    found_of = lambda q: {(r.kind, r.segment_id) for r in index.search(q, limit=None).collect()}
    assert ("note", 5) in found_of('"fox note"') and found_of('^"text 7 about"') == set() and found_of('"text 7 about"') == {("segment", 7)}
    assert {(r.kind, r.segment_id) for r in hits} == {("segment", i) for i in range(40) if i % 3 == 1}


def test_a_search_deals_out_packed_lists(spark, monkeypatch):
    """No row for each posting; blocks of few rows, and changes, give the same hits."""
    kind = "kind string, book_id string, segment_id long, note_id long, idx int, title string, body string"
    rows = spark.createDataFrame([("segment", "b", i, None, i, "a fox" if i % 2 else "fox jumps", f"fox {i} " * (i % 5)) for i in range(300)], kind).repartition(3)
    index = fulltext.Index.build(rows, folder(spark, "index"), 8).remove(rows.filter("segment_id = 4"))
    plan = index.search('"fox jumps" OR body:fox', limit=None)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan
    found = lambda q: sorted((r.segment_id, round(r["rank"], 9)) for r in index.search(q, limit=None).collect())
    asked = ['"fox jumps" OR body:fox', "title:fox NOT body:fox", '^"fox jumps"']
    whole = [found(q) for q in asked]
    assert [len(x) for x in whole] == [sum(1 for i in range(300) if i != 4 and (i % 2 == 0 or i % 5)), sum(1 for i in range(300) if i % 5 == 0), 149]
    monkeypatch.setattr(fulltext, "BLOCK_ROWS", 7)
    assert [found(q) for q in asked] == whole
