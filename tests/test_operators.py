"""Operators whose cases the tables don't hold: Chinese texts, broken JSON, files, edges."""

import io
import json
import math
import os
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import language, text
from leafmill.operators import chunking, display, export, jobs, library, markdown, model_output, news, ordering, queue, search, settings
from leafmill.plans import views
from leafmill.sources import readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_strip_takes_wide_space(spark):
    assert one(spark, text.strip(F.col("a")), a="　 x y　\n") == "x y"


@pytest.mark.parametrize(("s", "code"), [("这是一本关于历史的书，内容十分丰富，值得一读再读三读", "zh"), ("これはひらがなとカタカナのぶんしょうですよ、とてもながい", "ja"), ("A plain English sentence here", "en"), ("short", None), (None, None)])
def test_language(spark, s, code):
    assert one(spark, language.infer(F.col("a")), a=s) == code


def test_language_codes(spark):
    assert one(spark, language.normalise(F.col("a")), a="zh_CN") == "zh"
    assert one(spark, language.normalise(F.col("a")), a="cmn-Hans") == "zh"
    assert one(spark, language.normalise(F.col("a")), a=" ") is None


SUMMARY = "📌 一句话摘要 这是摘要。 📝 详细摘要 细节如下。 💡 主要观点 观点一很短。" + "这是对观点一的长长的说明，" * 4 + "共一句。 观点二。 💬 文章金句 金句在此。 📊 文章信息 AI 初评: 88 来源: 某站 作者: 张三 字数: 1200 阅读推文"


def test_feed_summary(spark):
    p = one(spark, news.parse_summary(F.col("a")), a=SUMMARY)
    assert (p.one_liner, p.detail, p.quotes) == ("这是摘要。", "细节如下。", ["金句在此。"])
    assert p.viewpoints == ["观点一很短。", "观点二。"] and p.viewpoint_notes[0].startswith("这是对") and p.viewpoint_notes[1] == ""
    assert p.meta == {"ai_score": "88", "source": "某站", "author": "张三", "word_count": "1200"}
    assert one(spark, news.score_hint(news.parse_summary(F.col("a"))), a=SUMMARY) == 88.0


def test_plain_summary_and_null(spark):
    p = one(spark, news.parse_summary(F.col("a")), a="第一句。第二句！第三句")
    assert (p.one_liner, p.detail, p.viewpoints) == ("第一句。", "第二句！第三句", ["第二句！", "第三句。"])
    assert one(spark, news.parse_summary(F.col("a")), a=None).one_liner == ""


def test_feed_file(spark, tmp_path):
    item = "<item><title>T</title><link>https://a.b/c</link><description><![CDATA[<p>Hi.</p>]]></description><pubDate>Mon, 04 Mar 2024 05:06:07 +0000</pubDate></item>"
    (tmp_path / "f.xml").write_text(f"<rss><channel>{item}<item><title>no link</title></item></channel></rss>")
    rows = news.feed_rows(readers.feed_items(spark, str(tmp_path)), "s").collect()
    assert [(r.url, r.title, r.published_at, r.rss_summary) for r in rows] == [("https://a.b/c", "T", "2024-03-04T05:06:07Z", "Hi.")]


@pytest.mark.parametrize("body", ["段落内容。" * 4000, "第一章 开篇\n" + "段落内容。\n" * 2000 + "第二章\n" + "x" * 9000, "one sentence here. " * 900, "## [§A]\n" + "a" * 7000 + "\n## [p.2]\n" + "b" * 7000, "x" * 30000])
def test_chunks_are_lossless(body):
    body = body.strip()
    found = chunking.spans(body)
    assert found[0][0] == 0 and found[-1][1] == len(body)
    assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert max(e - s for s, e in found) <= chunking.Budget().most


def test_chunk_names(spark):
    body = "## [§One]\n" + "a. " * 3000 + "\n## [p.7]\n" + "b. " * 3000
    rows = chunking.chunk(spark.createDataFrame([(1, body), (2, None), (3, " ")], "id long, t string"), "id", "t").collect()
    assert {r.id for r in rows} == {1} and rows[0].chapter == "§One" and rows[-1].chapter == "§One"
    assert any(r.page_range == "p.7" for r in rows)


@pytest.mark.parametrize(("raw", "value"), [
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('{"a": ["x" "y"],}', {"a": ["x", "y"]}),
    ('{"a": 1}, {"b": 2}', {"a": 1, "b": 2}),
    ('Sure! {"a": "he said "no" twice"} Bye.', {"a": 'he said "no" twice'}),
    ('{"bullets": [[{"label": "l", "body": "b"}]],}', {"bullets": [{"label": "l", "body": "b"}]}),
    ("prose", None), ("", None), (None, None),
])
def test_json_repair(spark, raw, value):
    assert model_output.parse(raw) == value
    found = one(spark, model_output.repaired_json(F.col("a")), a=raw)
    assert (found and json.loads(found)) == value


def test_chat_answer(spark):
    assert one(spark, model_output.chat_answer(F.col("a")), a='{"answer": "yes", "refused": true}').refused is True
    assert one(spark, model_output.chat_answer(F.col("a")), a="just words").answer == "just words"


@pytest.mark.parametrize("query", ["brown", "the quick", "onon", "xy brown"])
def test_bm25_is_that_of_sqlite(spark, query):
    bodies = ["the quick brown fox", "Brown bears and the brown cow", "ononon and on", "nothing", "the quick onon"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, body, tokenize='trigram')")
    db.executemany("insert into f(rowid, title, body) values (?, ?, ?)", [(i, f"t{i} title", b) for i, b in enumerate(bodies)])
    words = " ".join(f'"{w}"' for w in query.split() if len(w) > 2)
    expected = {i: r for i, r in db.execute("select rowid, rank from f where f match ?", (words,))}
    rows = spark.createDataFrame([(i, f"t{i} title", b) for i, b in enumerate(bodies)], "segment_id long, title string, body string")
    found = {r.segment_id: r["rank"] for r in search.bm25(rows, query).collect()}
    assert found.keys() == expected.keys() and all(found[i] == pytest.approx(expected[i], rel=1e-9) for i in found)
    assert search.search(rows, "ab").count() == 0


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:p"><manifest><item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/n.xhtml", "<html><body>nav</body></html>")
        z.writestr("o/a.xhtml", "<html><head><title>First &amp; one</title></head><body><p>A<br/>b</p><script>x</script></body></html>")
        z.writestr("o/b.xhtml", "<html><body><p>Second</p></body></html>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "b.epub").write_bytes(epub())
    (tmp_path / "c.epub").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"one\x00\x00three")
    (tmp_path / "e.xyz").write_bytes(b"?")
    found = readers.texts(readers.files(spark, str(tmp_path)), {"pdf": lambda c: c.decode().split("\x00")}).collect()
    by = {r.path[-5:]: r for r in found}
    assert by["a.txt"].text == "中文内容"
    assert by[".epub"[-5:]].path  # both books are there
    texts = {r.path.rsplit("/", 1)[1]: r for r in found}
    assert texts["b.epub"].text == "## [§First & one]\nA\nb\n\n## [§b]\nSecond"
    assert texts["c.epub"].error and texts["c.epub"].text is None
    assert texts["d.pdf"].text == "## [p.1]\none\n\n## [p.2 无文本]\n\n## [p.3]\nthree" and (texts["d.pdf"].pages, texts["d.pdf"].pages_with_text) == (3, 2)
    assert texts["e.xyz"].error == "unknown format"


def test_ocr(spark):
    pages = spark.createDataFrame([("f", 1, "x"), ("f", 2, " "), ("f", 3, None)], "path string, page int, text string")
    ocr = spark.createDataFrame([("f", 2, "read"), ("f", 1, "no")], "path string, page int, ocr_text string")
    assert {(r.page, r.text) for r in readers.with_ocr(pages, ocr).collect()} == {(1, "x"), (2, "read"), (3, None)}
    found = spark.createDataFrame([("f", 1, [" a", " "], [0.8]), ("f", 2, [], []), ("f", 3, ["b", "c"], [0.9, 0.7, 0.1]), ("f", 4, [" "], [1.0])], "path string, page int, texts array<string>, scores array<double>")
    read = readers.ocr_pages(found)
    assert {(r.page, r.text, round(r.confidence, 6), r.doubtful) for r in read.collect()} == {(1, "a", 0.4, True), (2, "", 0.0, False), (3, "b\nc", 0.8, False), (4, "", 0.0, False)}
    assert [tuple(r) for r in readers.ocr_documents(read, "e").collect()] == [("f", "e", 0.3, 4, 2, [1])]
    assert readers.ocr_pages(found, spark.createDataFrame([("f", 3)], "path string, page int")).count() == 1
    assert one(spark, readers.page_section(F.lit(2), F.col("a")), a=" x ") == "## [p.2]\nx" and one(spark, readers.page_section(F.lit(2), F.col("a")), a=" ") == ""


def test_unknown_filter_and_sort_fall_back(spark):
    rows = spark.createDataFrame([("b", "x", "unread", "其他", False, None, "1", "1"), ("a", "y", "reading", "科技", True, "2", "1", "1")], "book_id string, title string, status string, category string, is_favorite boolean, last_opened_at string, created_at string, updated_at string")
    assert [r.book_id for r in library.listed(rows, "what", "ever").orderBy("place").collect()] == ["a", "b"]


def test_retries(spark):
    x = spark.createDataFrame([(0,), (1,), (2,)], "n int").select(jobs.after_retries(F.col("n")).alias("s"))
    assert [r.s for r in x.collect()] == ["ready", "pending", "failed"]


def test_stream_gives_the_batch_states(spark, tmp_path):
    from leafmill.streaming import jobs as streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_id", "ts", "user_id", "event_type").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_states(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("states").groupBy("user_id").agg(F.max_by(F.struct("status", "errors", "n_events"), "n_events").alias("x"))
    got = {r.user_id: tuple(r.x) for r in last.collect()}
    assert got == {r.user_id: (r.status, r.errors, r.n_events) for r in streams.batch_states(events).collect()}


@pytest.mark.parametrize("run_rows", [1, 7, 1000])
def test_numbering_in_runs(spark, run_rows):
    rows = [("hot", i) for i in sorted({i * i % 101 - 50 for i in range(60)})] + [("b", 5), ("b", -10**12), ("b", 10**12), ("b", None), (None, 3), (None, None), (None, 1)]
    docs = spark.createDataFrame(rows, "source string, doc_id long").repartition(3)
    for got in (ordering.by_runs(docs, "source", "doc_id", F.floor(F.col("doc_id") / run_rows)).collect(), ordering.by_ranges(docs, ["source"], ["doc_id"]).collect()):
        for group in ("hot", "b", None):
            keys = sorted({k for g, k in rows if g == group}, key=lambda k: (k is not None, k or 0))
            assert [(r.idx, r.doc_id) for r in sorted((r for r in got if r.source == group), key=lambda r: r.idx)] == list(enumerate(keys))
        assert len(got) == len(rows)
    empty = spark.createDataFrame([], "source string, doc_id long")
    assert ordering.by_runs(empty, "source", "doc_id", F.col("doc_id")).count() == 0 and ordering.by_ranges(empty, ["source"], ["doc_id"]).count() == 0
    sums = ordering.running_sum(docs, "source", "doc_id", F.floor(F.col("doc_id") / run_rows), F.col("doc_id") % 3, "total").filter("source = 'hot'").orderBy("doc_id").collect()
    assert [r.total for r in sums] == [sum(int(math.fmod(y.doc_id, 3)) for y in sums[: k + 1]) for k in range(len(sums))]


def test_numbering_needs_no_driver_and_no_chain(spark):
    """A group of nine tenths of the rows lies in many runs, and the plan has no condition for each of them."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").otherwise("b").alias("source"))
    plan = ordering.by_runs(docs, "source", "doc_id", F.floor(F.col("doc_id") / 500))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("CASE WHEN") <= 2 and plan.filter("source = 'hot'").agg(F.max("idx")).first()[0] == 17999


def test_no_task_holds_a_whole_book(spark, monkeypatch):
    data = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")
    whole = {r.segment_id: r.idx for r in views.segments(spark, data).collect()}
    monkeypatch.setattr(views, "RUN_ROWS", 20, raising=False)
    segments, books = views.segments(spark, data), views.books(spark, data)
    assert {r.segment_id: r.idx for r in segments.collect()} == whole
    assert re.search(r"row_number\(\) windowspecdefinition\(source#\d+, run_#\d+", segments._jdf.queryExecution().optimizedPlan().toString())
    blocks = export.blocks(books, library.segment_list(segments, "export"), "x", "2024-01-01")
    assert "collect_list" not in blocks._jdf.queryExecution().optimizedPlan().toString()


def test_export_of_a_book(spark, tmp_path):
    summary = {"sentences": ["一句摘要。"], "bullets": [{"label": "要点", "body": "单条要点说明。"}], "notes": ["需注意局限性。"], "follow_ups": ["可追问的问题？"]}
    books = spark.createDataFrame([("b", "T", None, "txt", 2)], "book_id string, title string, author string, format string, segment_count int")
    rows = [("b", 1, None, "not json", None), ("b", 0, "〔§一 · 段 1〕", json.dumps(summary), "Translated."), ("b", 2, "", None, "")]
    segments = spark.createDataFrame(rows, "book_id string, idx int, anchor_label string, summary_json string, translation string")
    notes = spark.createDataFrame([("b", 1, "my note")], "book_id string, note_id long, content string")
    found = export.blocks(books, segments, "X", "2024-01-01", notes)
    text_ = "\n".join(r.block for r in found.collect())
    assert text_.strip().split("\n") == [
        "# 《T》摘要版", "> 由 X 生成 · 2024-01-01", "", "## 元信息", "- 作者: —", "- 格式: txt", "- 段数: 2", "", "## 段摘要",
        "### 段 1 · §一 · 段 1", "一句摘要。", "- 要点：单条要点说明。", "", "#### 需要注意", "- 需注意局限性。", "", "#### 你可以接着问", "1. 可追问的问题？", "", "#### 译文 · 段 1", "Translated.", "",
        "### 段 2 · 段 2", "not json", "", "### 段 3 · 段 3", "_摘要未生成_", "", "## 我的笔记", "", "- my note",
    ]
    export.write(found, str(tmp_path / "out"))
    assert "### 段 2" in "".join(p.read_text() for p in (tmp_path / "out" / "book_id=b").glob("*.txt"))


FULL = "这是第一条要点的充实说明，包含足够细节，长度也够二十个字。"


@pytest.mark.parametrize(("data", "bullets"), [
    ({"bullets": [{"label": "学而不倦", "content": "终身学习。"}, "plain string with enough length here", {"label": "tag", "text": "via text key"}]}, [("学而不倦", "终身学习。"), ("plain", "plain string with enough length here"), ("tag", "via text key")]),
    ({"bullets": [["a：1 with text", "b：2 with text", "c：3 with text"]]}, [("a", "1 with text"), ("b", "2 with text"), ("c", "3 with text")]),
    ({"bullets": ["寒门出身", "- **粗体**：说明", {"x": 1}, {"label": "only"}]}, [("寒门出身", "寒门出身"), ("粗体", "说明"), ("要点", "{'x': 1}"), ("only", "only")]),
    ({"bullets": ["ab。c，d and then much more"]}, [("ab。c", "ab。c，d and then much more")]),
])
def test_bullets_of_all_shapes(spark, data, bullets):
    s = one(spark, model_output.summary(F.col("a"), F.lit("§1")), a=json.dumps({"sentences": ["一句概述。"]} | data, ensure_ascii=False))
    assert [(b.label, b.body) for b in s.bullets] == bullets and s.anchor == "§1" and s.label == "一句概述"


@pytest.mark.parametrize(("n", "m", "label", "problem"), [(1, 3, "标签", None), (3, 7, "标签", None), (5, 9, "标签", "schema"), (0, 3, "标签", "schema"), (1, 2, "标签", "schema"), (4, 3, "标签", "schema"), (1, 3, "x" * 30, None)])
def test_limits_of_a_summary(spark, n, m, label, problem):
    raw = json.dumps({"sentences": ["一句。"] * n, "bullets": [{"label": "l", "body": FULL}] * m, "label": label, "锚点": "§1", "notes": ["a", "", "b", "c", "d"]}, ensure_ascii=False)
    assert one(spark, model_output.problem(model_output.summary(F.col("a"))), a=raw) == problem
    s = one(spark, model_output.summary(F.col("a")), a=raw)
    assert (len(s.sentences), len(s.bullets), s.notes, s.anchor, len(s.label)) == (n, m, ["a", "b", "c"], "§1", min(len(label), 20))


def test_short_bodies_are_asked_for_again(spark):
    raw = json.dumps({"sentences": ["a"], "bullets": [{"label": "l", "body": "一二三四五六七八九十十二"}] * 3, "label": "t", "anchor": "1"}, ensure_ascii=False)
    for least, problem in ((12, None), (20, "too short")):
        assert one(spark, model_output.problem(model_output.summary(F.col("a")), least), a=raw) == problem
    assert one(spark, model_output.problem(model_output.summary(F.col("a"))), a="prose") == "no JSON"
    text_ = one(spark, model_output.summary_text(model_output.summary(F.col("a"))), a=raw)
    assert text_.split("\n")[:3] == ["总结: a", "结构化要点:", "- l：一二三四五六七八九十十二"]


@pytest.mark.parametrize(("raw", "value"), [
    ('{"s": ["x"], "b": ["a：1", "c：2，" "d：3"]}, {"label": "# l", "anchor": "§1"}', {"s": ["x"], "b": ["a：1", "c：2，", "d：3"], "label": "# l", "anchor": "§1"}),
    ('{"s":["x"],"bullets":[["a：1","b：2"],"锚点":"§1"},{"label":"l"}]}', {"s": ["x"], "bullets": ["a：1", "b：2"], "anchor": "§1", "label": "l"}),
    ('{"bullets":[{"label":"a","body":"1"},{"label":"b","body":"2"],"label":"l"}', {"bullets": [{"label": "a", "body": "1"}, {"label": "b", "body": "2"}], "label": "l"}),
    ('{"bullets":[{"label":"a","body":"1"],{"label":"b","body":"2"}],"label":"l"}', {"bullets": [{"label": "a", "body": "1"}, {"label": "b", "body": "2"}], "label": "l"}),
    ('{"bullets":[{"label":"a","body":“子曰”多见。"},{"label":"b","body":两段对话。"}]}', {"bullets": [{"label": "a", "body": "「子曰」多见。"}, {"label": "b", "body": "两段对话。"}]}),
    ('{"bullets":[{"label":"a","body":"x "1" y","label":"b","body":"2"}],"label":"l"}', {"bullets": [{"label": "a", "body": 'x "1" y'}, {"label": "b", "body": "2"}], "label": "l"}),
    ('说明。\n{"a": [1, -2.5e1, true, null]}\n后面。', {"a": [1, -25.0, True, None]}),
    ('{"f":["][junk],"label":"x"}', {"f": [], "label": "x"}),
    ('{"a": 1} and {"b": 2}', {"a": 1}), ('{"a": "open', None), ("[1, 2]", [1, 2]),
])
def test_what_a_model_meant(raw, value):
    assert model_output.parse(raw) == value


@pytest.mark.parametrize(("published", "synced", "score"), [
    ("2024-03-19T12:00:00Z", None, 3.0), (None, "2024-03-18T00:00:00", 1.5), ("bad", "worse", 0.0), (None, None, 0.0), ("2024-03-15", "", 0.5), ("2024-03-01", "2024-03-20", 0.0), ("2024-03-25T00:00:00+08:00", None, 3.0), ("", "2024-03-19T00:00:00", 3.0),
])
def test_freshness_in_any_time_zone(spark, published, synced, score):
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert one(spark, news.freshness(F.col("a"), F.col("b"), F.lit("2024-03-20T00:00:00Z")), a=published, b=synced) == score
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_long_feed_summaries_lose_nothing(spark):
    p = one(spark, news.parse_summary(F.col("a")), a="一句话摘要 开头。 " + "文章金句 金句在此。 " * 1200 + "详细摘要 末尾细节。")
    assert p.detail == "末尾细节。" and p.one_liner == "开头。"
    assert len(one(spark, news.parse_summary(F.col("a")), a="句。" * 120_000).detail) == 2 * 119_999


def test_atom_and_pages_that_fail(spark, tmp_path):
    entry = '<entry><title>T</title><link rel="self" href="https://a.b/self"/><link href="https://a.b/c"/><summary>S.</summary><author><name>N</name></author><updated>2024-03-04T05:06:07+00:00</updated></entry>'
    (tmp_path / "f.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}</feed>')
    (r,) = news.feed_rows(readers.feed_items(spark, str(tmp_path)), "s").collect()
    assert (r.url, r.title, r.author, r.published_at, r.rss_summary) == ("https://a.b/c", "T", "N", "2024-03-04T05:06:07", "S.")
    (tmp_path / "f.pdf").write_bytes(b"x")
    (p,) = readers.texts(readers.files(spark, str(tmp_path / "f.pdf")), {"pdf": lambda c: ["one", " ", None, "four"]}).collect()
    assert (p.pages, p.pages_with_text, p.pages_empty, p.pages_failed, p.coverage) == (4, 2, [2], [3], 0.5)


def test_navigation_and_chapter_titles():
    item = lambda **x: x
    assert all(readers.is_navigation(i) for i in (item(id="nav"), item(href="x/toc.xhtml"), item(href="NAV.xhtml"), item(properties="a nav")))
    assert not readers.is_navigation(item(id="navy", href="canvas.html"))
    assert readers.chapter_title("<title> A &amp; b </title>", "x.html") == "A & b" and readers.chapter_title("<p>", "o/my_first_page.xhtml") == "my first page"
    assert readers.plain("<p>a<br>b</p><h2>c</h2>d<script>x<y</script>&lt;e&gt;") == "a\nb\n\n c\n\nd  <e>"


def test_pausing_and_resuming_in_order(spark):
    log = [(1, "a", 0, "enqueue"), (2, "a", 0, "enqueue"), (3, "b", 0, "start"), (4, "c", 1, "error"), (5, "c", 1, "error"), (6, "c", 1, "error")]
    table = lambda rows: spark.createDataFrame(rows, "seq long, book_id string, idx int, command string")
    at = lambda rows: {(r.book_id, r.idx): (r.status, r.place) for r in queue.places(table(rows)).collect()}
    assert at(log) == {("a", 0): ("pending", "queued"), ("b", 0): ("running", "active"), ("c", 1): ("failed", "none")}
    paused = [*log, (7, None, None, "pause_all")]
    assert at(paused) == {("a", 0): ("pending", "backlog"), ("b", 0): ("pending", "backlog"), ("c", 1): ("failed", "none")}
    assert at([*paused, (8, "a", None, "resume")])["b", 0] == ("running", "active")  # one book resumed ends the pause of all
    own = [*log, (7, "a", None, "pause"), (8, "b", None, "resume")]
    assert at(own)["a", 0][1] == "backlog" and at([*own, (9, None, None, "resume_all")])["a", 0][1] == "queued"
    assert at([*log, (7, "c", 1, "retry")])["c", 1] == ("pending", "queued") and at([*log, (7, "c", 1, "retry"), (8, "c", 1, "error")])["c", 1] == ("pending", "queued")
    again = queue.regenerate_commands(spark.createDataFrame([("c", 1), ("c", 2)], "book_id string, idx int"), spark.createDataFrame([("c",)], "book_id string"), 6)
    found = {(r.book_id, r.idx): r.status for r in queue.jobs(table(log).unionByName(again)).collect()}
    assert found["c", 1] == found["c", 2] == "pending"


def test_lists_follow_their_rules(spark):
    tasks = spark.createDataFrame([(1, "running", "x"), (2, "failed", "y")], "id int, status string, kind string")
    assert [r.shown for r in queue.partitions(tasks).orderBy("id").collect()] == ["running", "recent"]
    assert queue.selected(tasks, kind="y").count() == 1 and queue.selected(tasks).count() == 2
    assert one(spark, queue.budget_seconds(F.lit(3)), a="") == 540
    order = spark.createDataFrame([("summarize", ["a"]), ("translate", None), ("chat", ["b"])], "profile string, ids array<string>")
    assert {(r.profile, *r.ids) for r in settings.with_fallback(order).collect()} == {("summarize", "a"), ("translate", "a"), ("chat", "b")}
    assert tuple(one(spark, settings.budget(F.lit("ollama"), F.lit(0)), a="")) == (2500, 3000, 1500)
    assert one(spark, settings.default_feed(F.col("a"), "c", "e"), a="zh-CN") == "c" and one(spark, text.has_cjk(F.col("a")), a="a 书") and one(spark, text.is_local(F.col("a")), a="http://127.0.0.1:80/v1")
    models = spark.createDataFrame([("m", "a:latest"), ("m", "b")], "machine string, name string").withColumn("pos", F.lit(1))
    assert settings.installed_match(spark.createDataFrame([("m", "a")], "machine string, model string"), models).first().name == "a:latest"
    probes = spark.createDataFrame([("p", True, "ok")], "resource string, ok boolean, detail string")
    both = settings.reachable(probes.select("resource"), spark.createDataFrame([("r", 2)], "resource string, in_use long"), probes).orderBy("resource").collect()
    assert [(r.resource, r.in_use, r.ok, r.known) for r in both] == [("p", 0, True, True), ("r", 2, None, False)]
    p = news.parse_summary(F.col("a"))
    assert one(spark, news.expected_words(p), a=SUMMARY) == 1200 and one(spark, news.origin_hint(p), a=SUMMARY) is None
    assert one(spark, news.article_context(F.lit(" "), F.col("a"), F.lit("card")), a="told") == "told"
    assert one(spark, display.without_citation(F.col("a")), a="x — 依据：y") == "x"


def test_report_and_offsets_of_chunks(spark):
    """Offsets of all segments give the text back, and the report shows the first two."""
    docs = spark.read.parquet(os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001") + "/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").strip() for r in docs.collect()}
    found = {}
    for r in chunking.chunk(docs, "doc_id", "text").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert found.keys() == {i for i, t in texts.items() if t}
    for i, rows in found.items():
        rows.sort(key=lambda r: r.idx)
        assert [r.idx for r in rows] == list(range(len(rows))) and "".join(texts[i][r.start_offset : r.end_offset] for r in rows) == texts[i]
        assert all(r.raw_text == texts[i][r.start_offset : r.end_offset] for r in rows)
    shown = chunking.report(chunking.chunk(docs, "doc_id", "text"), "doc_id").collect()
    assert len(shown) == sum(min(2, len(rows)) for rows in found.values()) and not any(r.overlap for r in shown)
    assert all(r.preview == found[r.doc_id][r.idx].raw_text[:200].replace("\n", " ") for r in shown)
    gap = spark.createDataFrame([(1, 0, 3, "abc"), (1, 4, 6, "ef"), (2, 0, 3, "abc"), (2, 2, 5, "cde"), (3, 0, 2, "ab"), (3, 2, 4, "cd")], "id int, start_offset int, end_offset int, raw_text string")
    whole = spark.createDataFrame([(1, "abcdef"), (2, "abcde"), (3, "abcd")], "id int, t string")
    assert {r.id: r.lossless for r in chunking.coverage(gap, "id", whole, "t").collect()} == {1: False, 2: False, 3: True}


def test_origins():
    page = '<a href="/own">x</a>' + '<a href="http://a.test/p">a</a><a href="http://b.test/p">b</a><a href="http://c.test/p">c</a><a href="http://d.test/p">d</a>' + '<a href="http://www.x.com/p">t</a>'
    assert news._origins(page, "http://own.test/") == ["http://a.test/p", "http://b.test/p", "http://c.test/p"]
    assert news._origins(page + " " * 200 + 'Source URL <a href="//e.test/q">e</a>', "http://own.test/") == ["http://e.test/q"]
    assert news._origins(None, None) == [] and news._origins('<a href="http://[bad/p">', "http://own.test/") == []


def test_summaries_of_short_and_long_documents(spark):
    docs = spark.createDataFrame([(1, "# One\nFirst thing said here. More.\n# Two\nSecond."), (2, "## [§甲]\n" + "长句子。" * 4000), (3, " "), (4, None)], "id int, t string")
    found = {r.id: r for r in markdown.document_summaries(docs, "id", "t", chunking.chunk(docs, "id", "t")).collect()}
    assert found.keys() == {1, 2} and not found[1].by_segments and found[2].by_segments
    lines = found[2].markdown.split("\n")
    n = min(6, chunking.chunk(docs, "id", "t").filter("id = 2").count())
    assert lines[0] == "## 总结（最多三句话）" and sum(x.startswith("- **§甲**：") for x in lines) == n and lines[-2:] == ["1. 哪一段最值得展开？", "2. 有哪些需要注意的限制？"]
    assert "First thing said here. More. Second. — 依据：原文 〔§(全文)〕" in found[1].markdown  # places instead of headings: one section
