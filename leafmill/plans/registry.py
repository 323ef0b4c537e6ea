"""The library and news queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import language, text
from leafmill.operators import chat, chunking, export, jobs, library, markdown, model_output, news, search, settings
from leafmill.plans import views as v
from leafmill.plans.register import ORACLES, QUERIES, query
from leafmill.streaming import jobs as streams

NOW = "2024-03-20T00:00:00Z"


PROGRESS = "SELECT book_id, count(*) AS total, count(*) FILTER (summary_status = 'ready') AS ready FROM segments GROUP BY book_id"


@query(f"SELECT b.book_id, b.title, b.status, p.total, p.ready, CASE WHEN p.total > 0 AND p.ready >= p.total THEN 'summarized' WHEN b.status = 'processing' THEN 'running' ELSE 'idle' END AS state FROM books b JOIN ({PROGRESS}) p ON b.book_id = p.book_id")
def library_progress(spark: SparkSession, d: str) -> DataFrame:
    b = library.with_progress(v.books(spark, d), v.segments(spark, d))
    state = library.state(F.col("total"), F.col("ready"), F.col("status") == "processing", F.lit(False), F.lit(False))
    return b.select("book_id", "title", "status", "total", "ready", state.alias("state"))


@query(f", s AS (SELECT CASE WHEN p.ready >= p.total THEN 'summarized' WHEN b.status = 'reading' THEN 'running' WHEN b.status = 'error' THEN 'paused' ELSE 'idle' END AS state FROM books b JOIN ({PROGRESS}) p ON b.book_id = p.book_id WHERE b.status <> 'processing') SELECT k.state, count(s.state) AS n FROM (VALUES ('running'), ('queued'), ('paused'), ('idle'), ('summarized')) k(state) LEFT JOIN s ON k.state = s.state GROUP BY k.state")
def library_state_histogram(spark, d):
    b = library.with_progress(v.books(spark, d), v.segments(spark, d))
    state = library.state(F.col("total"), F.col("ready"), F.col("status") == "reading", F.col("status") == "error", F.lit(False))
    return library.state_histogram(b.select("status", state.alias("state")))


def _listing(sort: str, order: str):
    @query(f"SELECT book_id, title, CAST(row_number() OVER (ORDER BY {order}, book_id) AS INTEGER) AS place FROM books")
    def listing(spark, d):
        return library.listed(v.books(spark, d), sort=sort).select("book_id", "title", "place")

    QUERIES[f"library_sort_{sort}"], ORACLES[f"library_sort_{sort}"] = QUERIES.pop("listing"), ORACLES.pop("listing")


RECENT = "last_opened_at DESC NULLS LAST, updated_at DESC NULLS LAST"
for _sort, _order in (("recent", RECENT), ("added", "created_at DESC NULLS LAST"), ("title", "lower(title)"), ("favorite", "is_favorite DESC, " + RECENT)):
    _listing(_sort, _order)


@query(f"SELECT book_id, status, CAST(row_number() OVER (ORDER BY CASE status WHEN 'reading' THEN 0 WHEN 'unread' THEN 1 ELSE 2 END, {RECENT}, book_id) AS INTEGER) AS place FROM books")
def library_activity_first(spark, d):
    rank = F.when(F.col("status") == "reading", "running").when(F.col("status") == "unread", "queued")
    return library.listed(v.books(spark, d), first=library.activity_rank(F.coalesce(rank, F.lit("rest")))).select("book_id", "status", "place")


@query("SELECT book_id, category FROM books WHERE category = '科技'")
def library_by_category(spark, d):
    return library.filtered(v.books(spark, d), "科技").select("book_id", "category")


@query("SELECT segment_id, book_id, idx, label, anchor_label, char_count, summary_status, retry_count FROM segments")
def segments_slim(spark, d):
    return library.segment_list(v.segments(spark, d))


@query("SELECT segment_id, book_id, idx, label, raw_text FROM segments WHERE idx = 3")
def segment_by_number(spark, d):
    return library.segment_list(v.segments(spark, d), "full").filter("idx = 3").select("segment_id", "book_id", "idx", "label", "raw_text")


@query("SELECT segment_id, book_id, idx, summary_status FROM segments WHERE summary_status IN ('pending', 'failed', 'error')")
def segments_to_do(spark, d):
    return library.segment_list(v.segments(spark, d), "meta").filter(F.col("summary_status").isin("pending", "failed", "error")).select("segment_id", "book_id", "idx", "summary_status")


@query("SELECT book_id, 'summarized' AS status FROM (SELECT book_id || '/' || (idx % 40) AS book_id, summary_status FROM segments) GROUP BY book_id HAVING bool_and(summary_status = 'ready')")
def books_all_ready(spark, d):
    """Books cut into forty volumes each, so that some have nothing but ready segments."""
    volumes = v.segments(spark, d).select(F.concat("book_id", F.lit("/"), F.col("idx") % 40).alias("book_id"), "summary_status")
    return library.all_ready(volumes)


@query("SELECT n.note_id, n.segment_id, s.book_id, b.title AS book_title, coalesce(nullif(s.label, ''), s.anchor_label, '段 ' || (s.idx + 1)) AS segment_label, n.content, n.created_at FROM notes n JOIN segments s ON n.segment_id = s.segment_id JOIN books b ON s.book_id = b.book_id")
def notes_enriched(spark, d):
    return library.notes_enriched(v.notes(spark, d), v.segments(spark, d), v.books(spark, d))


@query("SELECT n.* FROM notes n WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.segment_id = n.segment_id AND s.summary_status = 'ready')")
def notes_without_segment(spark, d):
    return library.orphans(v.notes(spark, d), v.segments(spark, d).filter("summary_status = 'ready'"))


@query("SELECT segment_id, book_id FROM segments WHERE book_id NOT IN (SELECT book_id FROM books WHERE status = 'error')")
def segments_after_cascade(spark, d):
    return library.cascade(v.segments(spark, d).select("segment_id", "book_id"), v.books(spark, d).filter("status = 'error'"), "book_id")


@query("SELECT doc_id, sha256(text) AS file_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS original, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_new FROM documents", with_views=False)
def import_by_content(spark, d):
    return library.first_of_each_hash(v.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "file_hash", "original", "is_new")


@query("""SELECT article_id, arg_max(title, page_id) || ' v2' AS title, arg_min(source_id, CASE WHEN page_id % 2 = 0 THEN page_id - 1000000000 ELSE page_id END) || CASE WHEN bool_or(page_id % 2 = 0) THEN '' ELSE '/new' END AS source_id,
arg_min(url, CASE WHEN page_id % 2 = 0 THEN page_id - 1000000000 ELSE page_id END) AS url, NOT bool_or(page_id % 2 = 0) AS is_new FROM articles GROUP BY article_id""")
def articles_upserted(spark, d):
    """Even pages are stored; all of them arrive again with new titles, and the odd ones for the first time."""
    a = v.articles(spark, d)
    old = a.filter("page_id % 2 = 0").groupBy("article_id").agg(F.min_by(F.struct("title", "source_id", "url"), "page_id").alias("x")).select("article_id", "x.*")
    new = a.select("article_id", F.concat("title", F.lit(" v2")).alias("title"), F.concat("source_id", F.lit("/new")).alias("source_id"), "url", F.col("page_id").alias("seq"))
    return library.upsert(old, new, "article_id", ["title"], ["source_id", "url"])


@query("SELECT url, coalesce(title, 'New') AS title, CASE WHEN length(url) % 4 = 0 THEN 'insert' WHEN title IS NULL THEN 'update' ELSE 'keep' END AS action FROM sources")
def presets_reconciled(spark, d):
    """All sources as presets, of which a quarter aren't stored."""
    s = v.sources(spark, d)
    return library.reconcile(s.select("url", F.coalesce("title", F.lit("New")).alias("title")), s.filter("length(url) % 4 <> 0").select("url", "title"))


@query("SELECT n.book_id, n.title, CAST(row_number() OVER (ORDER BY o.pos ASC NULLS LAST, n.pos, n.book_id) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY title DESC, book_id) AS pos FROM books WHERE status <> 'error') n LEFT JOIN (SELECT book_id, row_number() OVER (ORDER BY book_id) AS pos FROM books WHERE is_favorite) o ON n.book_id = o.book_id")
def books_merged_in_order(spark, d):
    from pyspark.sql import Window

    b = v.books(spark, d).select("book_id", "title", "status", "is_favorite")
    new = b.filter("status <> 'error'").select("book_id", "title", F.row_number().over(Window.orderBy(F.desc("title"), "book_id")).alias("pos"))
    old = b.filter("is_favorite").select("book_id", F.row_number().over(Window.orderBy("book_id")).alias("pos"))
    return library.merge_in_order(old, new, "book_id")


@query("SELECT source_id, CASE length(source_id) % 3 WHEN 0 THEN upper(source_id) WHEN 1 THEN 'own' ELSE upper(source_id) END AS title, url FROM sources UNION ALL SELECT 'x' || source_id, CASE length(source_id) % 3 WHEN 1 THEN 'own' END, NULL FROM sources")
def settings_overlaid(spark, d):
    """All sources as defaults; own settings of all, blank or masked for some, and some that have no default."""
    s = v.sources(spark, d)
    n = F.length("source_id") % 3
    title = F.when(n == 0, " ").when(n == 1, "own").otherwise(text.MASK)
    own = s.select("source_id", title.alias("title"), F.lit(None).cast("string").alias("url"))
    own = own.unionByName(own.withColumn("source_id", F.concat(F.lit("x"), "source_id")))
    return library.overlay(s.select("source_id", F.upper("source_id").alias("title"), "url"), own, "source_id", ["title", "url"])


@query("SELECT segment_id, CASE WHEN segment_id % 4 = 0 OR char_count IS NULL OR char_count = 0 THEN length(raw_text) ELSE char_count END AS char_count FROM segments")
def char_counts_filled(spark, d):
    s = v.segments(spark, d).withColumn("char_count", F.when(F.col("segment_id") % 4 != 0, F.col("char_count")))
    return library.fill_char_counts(s).select("segment_id", "char_count")


@query("SELECT s.segment_id, CASE WHEN s.segment_id % 5 = 0 AND s.segment_id % 10 <> 0 THEN 'new' ELSE s.anchor_label END AS anchor_label, CASE WHEN s.segment_id % 5 = 0 THEN 'ready' ELSE s.summary_status END AS summary_status, CASE WHEN s.segment_id % 5 = 0 THEN 0 ELSE s.retry_count END AS retry_count FROM segments s")
def summaries_updated(spark, d):
    s = v.segments(spark, d).select("segment_id", "anchor_label", "summary_status", "retry_count")
    new = s.filter("segment_id % 5 = 0").select("segment_id", F.lit("ready").alias("new_status"), F.when(F.col("segment_id") % 10 != 0, "new").alias("new_anchor"))
    return library.update_summary(s, new)


@query("SELECT book_id, CASE WHEN is_favorite AND status = 'unread' THEN 'reading' ELSE status END AS status, CASE WHEN is_favorite THEN '2024-02-01T00:00:00Z' ELSE last_opened_at END AS last_opened_at FROM books")
def books_opened(spark, d):
    b = v.books(spark, d)
    return library.opened(b, b.filter("is_favorite"), "2024-02-01T00:00:00Z").select("book_id", "status", "last_opened_at")


@query("SELECT s.book_id, s.segment_id, s.idx, c.above, c.below FROM segments s JOIN (SELECT book_id, count(*) FILTER (idx < 5) AS above, count(*) FILTER (idx > 15) AS below FROM segments GROUP BY book_id) c ON s.book_id = c.book_id WHERE s.idx BETWEEN 5 AND 15")
def reading_window(spark, d):
    return library.window_around(v.segments(spark, d), 10, 5)


#: The blocks of an export in SQL: what a segment's block says is made of the view's own pieces.
HEADER = "SELECT b.book_id, 0 AS part, CAST(0 AS BIGINT) AS idx, '# 《' || title || '》摘要版' || chr(10) || '> 由 Leafmill 生成 · 2024-03-20' || chr(10) || chr(10) || '## 元信息' || chr(10) || '- 作者: ' || coalesce(author, '—') || chr(10) || '- 格式: ' || format || chr(10) || '- 段数: ' || segment_count || chr(10) || chr(10) || '## 段摘要' AS block FROM books b"
BLOCK = "'### 段 ' || (idx + 1) || ' · ' || coalesce(anchor_label, '段 ' || (idx + 1)) || chr(10) || CASE WHEN summary_json IS NULL THEN '_摘要未生成_' WHEN summary_json = 'no summary' THEN summary_json ELSE 'Sentence ' || segment_id || '。' || chr(10) || 'Second' || chr(10) || '- 甲：body of ' || segment_id || chr(10) || '- 乙：second' || chr(10) || '- 丙：third' || chr(10) || chr(10) || '#### 需要注意' || chr(10) || '- note ' || (segment_id % 7) || chr(10) || chr(10) || '#### 你可以接着问' || chr(10) || '1. why?' || chr(10) || '2. how?' END || chr(10) || CASE WHEN translation <> '' THEN chr(10) || '#### 译文 · 段 ' || (idx + 1) || chr(10) || translation || chr(10) ELSE '' END"
EXPORT = f"{HEADER} UNION ALL SELECT book_id, 1, CAST(idx AS BIGINT), {BLOCK} FROM segments"


@query(EXPORT)
def export_markdown(spark, d):
    return export.blocks(v.books(spark, d), library.segment_list(v.segments(spark, d), "export"), "Leafmill", NOW[:10])


@query(EXPORT + " UNION ALL SELECT DISTINCT s.book_id, 2, CAST(-1 AS BIGINT), '## 我的笔记' || chr(10) FROM notes n JOIN segments s ON n.segment_id = s.segment_id UNION ALL SELECT s.book_id, 2, CAST(n.note_id AS BIGINT), '- ' || coalesce(n.content, '') FROM notes n JOIN segments s ON n.segment_id = s.segment_id")
def export_markdown_blocks(spark, d):
    """The export with the reader's notes."""
    s = v.segments(spark, d)
    notes = v.notes(spark, d).join(s.select("segment_id", "book_id"), "segment_id").select("book_id", "note_id", "content")
    return export.blocks(v.books(spark, d), library.segment_list(s, "export"), "Leafmill", NOW[:10], notes)


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6", with_views=False)
def chat_last_messages(spark, d):
    return chat.last_messages(v.table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "back")


@query("SELECT conv_id % 10 AS book, max(conv_id) AS conv_id FROM conversations WHERE turn = 0 GROUP BY 1", with_views=False)
def chat_latest_session(spark, d):
    s = v.table(spark, d, "conversations").filter("turn = 0").select((F.col("conv_id") % 10).alias("book"), "conv_id", "turn")
    return chat.latest_session(s, "book", "conv_id", "turn")


@query("SELECT book_id, 7 AS current, segment_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY abs(idx - 7), idx) AS place FROM segments) WHERE place <= 3 AND idx <> 7")
def context_neighbours(spark, d):
    return chat.neighbours(v.segments(spark, d), v.books(spark, d).select("book_id", F.lit(7).alias("current")))


@query(
    """, n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY abs(idx - 7), idx) AS place,
      CASE WHEN summary_json LIKE '{%' THEN array_to_string(['总结: Sentence ' || segment_id || '。  Second  ', '结构化要点:', '- 甲：body of ' || segment_id, '- 乙：second', '- 丙：third', '需要注意:', '- note ' || (segment_id % 7), '你可以接着问:', '- why?', '- how?'], chr(10)) ELSE '摘要: ' || summary_json END AS told FROM segments)
    SELECT b.book_id, array_to_string(list_filter(['# ' || b.title, '## L0 书级', '总段数: ' || count(*), '## L1 段摘要导航',
      string_agg('- [段 ' || (n.idx + 1) || '] ' || coalesce(nullif(label, ''), '段 ' || (n.idx + 1)) || ' (' || summary_status || ')', chr(10) || chr(10) ORDER BY n.idx) FILTER (n.idx < 50),
      '## L2 当前段原文', max(CASE WHEN n.idx = 7 THEN substr(n.raw_text, 1, 3000) END), max(CASE WHEN n.idx = 7 THEN told END), '## L2 相关段摘录',
      string_agg('### 段 ' || (n.idx + 1) || chr(10) || substr(n.raw_text, 1, 400), chr(10) || chr(10) ORDER BY n.place) FILTER (n.place <= 3 AND n.idx <> 7)], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS context
    FROM books b JOIN n ON b.book_id = n.book_id GROUP BY b.book_id, b.title"""
)
def context_assembled(spark, d):
    b = v.books(spark, d)
    return chat.context(b, v.segments(spark, d), b.select("book_id", F.lit(7).alias("current")))


@query("SELECT event_id AS call_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN user_id + 100 END, user_id + user_id % 50) AS total_tokens, round_even((user_id % 50) / CAST(greatest(event_id % 5000, 1) AS DOUBLE) * 1000, 1) AS tokens_per_s FROM events", with_views=False)
def model_usage(spark, d):
    e = v.table(spark, d, "events")
    calls = e.select(F.col("event_id").alias("call_id"), F.col("user_id").alias("prompt_tokens"), (F.col("user_id") % 50).alias("completion_tokens"), F.when(F.col("event_id") % 3 != 0, F.col("user_id") + 100).alias("total_tokens"), (F.col("event_id") % 5000).alias("duration_ms"))
    return chat.usage(calls)


INDEX = ", rows AS (SELECT 'segment' AS kind, s.segment_id, CAST(NULL AS BIGINT) AS note_id, s.book_id, s.idx, b.title || ' · 段 ' || (s.idx + 1) AS title, coalesce(s.label, '') || chr(10) || coalesce(s.summary_json, '') || chr(10) || substr(coalesce(s.raw_text, ''), 1, 4000) || chr(10) || coalesce(s.translation, '') AS body FROM segments s JOIN books b ON s.book_id = b.book_id UNION ALL SELECT 'book', NULL, NULL, book_id, NULL, title, coalesce(author, '') FROM books UNION ALL SELECT 'note', n.segment_id, n.note_id, s.book_id, s.idx, '笔记 · ' || b.title, coalesce(n.quote, '') || chr(10) || coalesce(n.content, '') FROM notes n JOIN segments s ON n.segment_id = s.segment_id JOIN books b ON s.book_id = b.book_id)"
BM25 = INDEX + ", c AS (SELECT *, greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0) AS len, lower(title || chr(10) || body) AS x FROM rows), f AS (SELECT *, (length(x) - length(replace(x, 'thing', ''))) / 5 AS f0, (length(x) - length(replace(x, 'anthe', ''))) / 5 AS f1 FROM c), t AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f)"
BM25 += ", i AS (SELECT *, ln((n - n0 + 0.5) / (n0 + 0.5)) AS l0, ln((n - n1 + 0.5) / (n1 + 0.5)) AS l1 FROM t), r AS (SELECT kind, segment_id, note_id, book_id, idx, title, round(-(CASE WHEN l0 <= 0 THEN 1e-6 ELSE l0 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / mean)) - (CASE WHEN l1 <= 0 THEN 1e-6 ELSE l1 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / mean)), 9) AS rank FROM f, i WHERE f0 > 0 AND f1 > 0)"


def _index(spark, d):
    return search.index(v.segments(spark, d), v.books(spark, d), v.notes(spark, d))


@query(BM25 + " SELECT * FROM r")
def search_scores(spark, d):
    hits = search.bm25(_index(spark, d), "thing anthe")
    return hits.select("kind", "segment_id", "note_id", "book_id", "idx", "title", F.round("rank", 9).alias("rank"))


@query(BM25 + " SELECT kind, segment_id, title FROM r ORDER BY rank, kind, book_id, segment_id, note_id LIMIT 30")
def search_top(spark, d):
    return search.search(_index(spark, d), "thing an anthe").select("kind", "segment_id", "title")


@query(INDEX + " SELECT kind, book_id, note_id, title FROM rows WHERE contains(lower(title || chr(10) || body), 'author') AND contains(lower(title || chr(10) || body), 'book')")
def search_books_and_notes(spark, d):
    """What an author's name and a title's word find, in the order in which a reader sees it."""
    return search.by_kind(search.bm25(_index(spark, d), "Author book")).select("kind", "book_id", "note_id", "title")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'academic' WHEN event_type = 'click' THEN 'code' WHEN event_type = 'error' THEN 'books' ELSE 'general' END AS domain, event_type <> 'click' AND event_id % 2 = 0 AS enough FROM events", with_views=False)
def question_routing(spark, d):
    q = F.when(F.col("event_type") == "view", "a Paper on it").when(F.col("event_type") == "click", "who is the github repo author").when(F.col("event_type") == "error", "which ISBN").otherwise("tell me")
    context = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 300)).otherwise("")
    return v.table(spark, d, "events").select("event_id", search.domain(q).alias("domain"), search.evidence_is_enough(q, context).alias("enough"))


@query("SELECT conv_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2", with_views=False)
def web_results_top(spark, d):
    c = v.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("role").alias("url"), "text")
    return search.top_results(c, 2).select(F.col("query_id").alias("conv_id"), F.col("pos").alias("turn"), "text", "place")


#: Articles some of which have no date that can be read.
UNDATED = "SELECT * REPLACE (CASE WHEN page_id % 5 = 0 THEN 'soon' ELSE published_at END AS published_at, CASE WHEN page_id % 10 = 0 THEN 'zz never' ELSE synced_at END AS synced_at) FROM articles"


@query(f""", u AS ({UNDATED}), p AS (SELECT * FROM u ORDER BY synced_at DESC, article_id LIMIT 150), t AS (SELECT *, TRY_CAST(replace(replace(published_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS t1, TRY_CAST(replace(replace(synced_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS t2 FROM p),
a AS (SELECT *, (epoch(TIMESTAMP '2024-03-20 00:00:00') - epoch(coalesce(t1, t2))) / 3600 AS h FROM t),
s AS (SELECT *, (CASE WHEN h IS NULL THEN 0.0 WHEN h <= 24 THEN 3.0 WHEN h <= 72 THEN 1.5 WHEN h <= 168 THEN 0.5 ELSE 0.0 END)::DOUBLE + coalesce(score_hint / 50, 0) AS score,
 CASE WHEN h <= 168 AND score_hint IS NOT NULL THEN '新鲜|质量提示:' || CAST(floor(score_hint) AS INTEGER) WHEN h <= 168 THEN '新鲜' WHEN score_hint IS NOT NULL THEN '质量提示:' || CAST(floor(score_hint) AS INTEGER) ELSE '默认候选' END AS reasons FROM a),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, coalesce(published_at, '') DESC, title DESC, article_id) AS INTEGER) AS place FROM s)
SELECT r.article_id, r.title, r.score, r.reasons, r.place, coalesce(o.title, o.url) AS source_title FROM r LEFT JOIN sources o ON r.source_id = o.source_id WHERE place <= 25""")
def news_brief(spark, d):
    p = F.col("page_id")
    a = v.articles(spark, d).withColumns({"published_at": F.when(p % 5 == 0, "soon").otherwise(F.col("published_at")), "synced_at": F.when(p % 10 == 0, "zz never").otherwise(F.col("synced_at"))})
    return news.brief(a, v.sources(spark, d), NOW).select("article_id", "title", "score", F.array_join("reasons", "|").alias("reasons"), "place", "source_title")


@query(", c AS (SELECT article_id, page_id AS attempt, 500 + page_id * 37 % 400 AS n, page_id % 4 = 0 AS good FROM articles) SELECT segment_id AS article_id, segment_id AS attempt, 'direct' AS strategy, CAST(length(trim(raw_text)) AS INTEGER) AS chars, length(trim(raw_text)) >= greatest(500, floor(char_count * 3 / 10)) AS good FROM segments WHERE false UNION ALL SELECT book, arg_min(idx, o), arg_min(CASE WHEN idx % 2 = 0 THEN 'direct' ELSE 'proxy' END, o), CAST(arg_min(n, o) AS INTEGER), arg_min(good, o) FROM (SELECT segment_id // 4 AS book, segment_id % 4 AS idx, length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) AS n, length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) >= 900 AS good, CASE WHEN length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) >= 900 THEN segment_id % 4 ELSE 1000000000 - length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) * 10 + segment_id % 4 END AS o FROM segments) GROUP BY book")
def article_bodies_chosen(spark, d):
    i = F.col("segment_id")
    c = v.segments(spark, d).select(F.floor(i / 4).alias("article_id"), (i % 4).alias("attempt"), F.when(i % 2 == 0, "direct").otherwise("proxy").alias("strategy"), F.col("raw_text").alias("text"), F.lit(3000).alias("expected_words"))
    return news.choose_body(c)


TEXT = r"replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|h[1-6])>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&')"


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({TEXT}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages", with_views=False)
def pages_to_text(spark, d):
    return v.table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(r", x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages) SELECT page_id, CASE WHEN length(t) <= 220 THEN t ELSE substr(t, 1, 219) || '…' END AS excerpt FROM x")
def page_excerpts(spark, d):
    return v.table(spark, d, "pages").select("page_id", text.cut(text.strip_html(F.col("html")), 220).alias("excerpt"))


@query(r"SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS address, lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%.example.com' AS same_site FROM pages", with_views=False)
def page_addresses(spark, d):
    h = text.host(F.col("url"))
    return v.table(spark, d, "pages").select("page_id", h.alias("host"), text.address_key(F.col("url")).alias("address"), text.same_site(h, F.lit("example.com")).alias("same_site"))


@query(r", c AS (SELECT doc_id, lang, substr(text, 1, 4000) AS s FROM documents), n AS (SELECT doc_id, lang, s, len(regexp_extract_all(s, '[A-Za-z]')) AS latin, len(regexp_extract_all(s, '\p{L}')) AS letters FROM c) SELECT doc_id, CASE WHEN latin + letters < 20 THEN NULL WHEN latin * 2 >= latin + letters THEN 'en' WHEN latin > 0 THEN 'en' END AS inferred, coalesce(lang <> 'en', false) AS needs FROM n")
def languages_inferred(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "lang", language.infer(F.col("text")).alias("inferred"))
    return docs.select("doc_id", "inferred", language.needs_translation(F.concat("lang", F.lit("-XX")), F.lit("en_US"), F.col("inferred")).alias("needs"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'zh' WHEN doc_id % 3 = 1 THEN 'ja' WHEN latin + letters < 20 THEN NULL WHEN latin > 0 THEN 'en' END AS inferred FROM (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 4000), '[A-Za-z]')) AS latin, len(regexp_extract_all(substr(text, 1, 4000), '\p{L}')) AS letters FROM documents)", with_views=False)
def languages_of_dressed_texts(spark, d):
    """Two texts of three after a Chinese or a Japanese preface, so that each class of letters decides somewhere."""
    k = F.col("doc_id") % 3
    preface = F.when(k == 0, F.repeat(F.lit("这是书"), 1400)).when(k == 1, F.repeat(F.lit("これは本"), 1100)).otherwise("")
    return v.table(spark, d, "documents").select("doc_id", language.infer(F.concat(preface, F.coalesce("text", F.lit("")))).alias("inferred"))


def _cards(docs: DataFrame, tight: bool = False) -> DataFrame:
    """Documents as Markdown: each line a point, every seventh a heading; tight: half of them with a first heading without its space."""
    head = F.when(F.col("doc_id") % 3 == 0, "## 结构化要点").when(F.col("doc_id") % 3 == 1, "## 你可以接着问").otherwise("## Other")
    head = F.when(F.lit(tight) & (F.floor(F.col("doc_id") / 3) % 2 == 0), F.replace(head, F.lit("## "), F.lit("##"))).otherwise(head)
    body = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("## H"), i.cast("string"))).when(i % 2 == 0, F.concat(F.lit("- "), x)).otherwise(F.concat(F.lit("- p.3 "), x)))
    return docs.select("doc_id", F.concat(F.lit("intro\n"), head, F.lit("\n"), F.array_join(body, "\n")).alias("md"))


CARDS = ", m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '## 结构化要点' WHEN 1 THEN '## 你可以接着问' ELSE '## Other' END AS head, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, 0 AS pos, 'intro' AS line FROM m UNION ALL SELECT doc_id, 1, head FROM m UNION ALL SELECT doc_id, i + 2, CASE WHEN i % 7 = 3 THEN '## H' || i WHEN i % 2 = 0 THEN '- ' || ls[i + 1] ELSE '- p.3 ' || ls[i + 1] END FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM m)), g AS (SELECT *, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)"


@query(CARDS + " SELECT doc_id, CAST(section AS BIGINT) AS section, arg_min(line, pos) AS heading, string_agg(line, chr(10) ORDER BY pos) AS text FROM g WHERE section > 0 GROUP BY doc_id, section")
def markdown_sections(spark, d):
    return markdown.sections(_cards(v.table(spark, d, "documents")), "doc_id", "md")


#: The same with half of the first headings without their space.
TIGHT = CARDS.replace("ELSE '## Other' END AS head", "ELSE '## Other' END AS wide, CASE WHEN doc_id // 3 % 2 = 0 THEN replace(wide, '## ', '##') ELSE wide END AS head").replace("line LIKE '## %'", "line LIKE '## %' OR line LIKE '##结%' OR line LIKE '##你%'")


@query(TIGHT + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN fixed THEN rtrim(line) || ' 〔未定位到页/节〕' ELSE line END AS line, fixed FROM (SELECT *, head IN ('## 结构化要点', '##结构化要点') AND line LIKE '- %' AND NOT regexp_matches(line, '(?i)〔[^〕]+〕|\\[p\\.\\d+\\]|〔?§[^\\s，,;；|〕\\]]+|Sheet\\s*[:：]?\\s*\\S+|p\\.\\d+') AS fixed FROM (SELECT g.*, first_value(line) OVER (PARTITION BY doc_id, section ORDER BY pos) AS head FROM g))")
def citations_repaired(spark, d):
    return markdown.cited(markdown.lines_of(_cards(v.table(spark, d, "documents"), tight=True), "doc_id", "md"), "doc_id")


@query(TIGHT + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT g.*, first_value(line) OVER (PARTITION BY doc_id, section ORDER BY pos) AS head FROM g) WHERE head NOT IN ('## 你可以接着问', '##你可以接着问')")
def asks_dropped(spark, d):
    return markdown.without_asks(markdown.lines_of(_cards(v.table(spark, d, "documents"), tight=True), "doc_id", "md"), "doc_id")


def _bare(x: str) -> str:
    """SQL for a text without markers, on one line."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?m)^#{{1,6}}\s*', '', 'g'), '\[§[^\]]+\]|\[p\.\d+\]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    CARDS
    + rf""", sec AS (SELECT doc_id, section, '§' || trim(regexp_replace(arg_min(line, pos), '^[#\s]+', '')) AS cite, string_agg(line, chr(10) ORDER BY pos) AS t FROM g WHERE section > 0 GROUP BY doc_id, section),
    lab AS (SELECT *, trim(regexp_replace(cite, '^§*[p.]*', '')) AS own, {_bare('t')} AS flat FROM sec),
    pts AS (SELECT doc_id, section, cite, coalesce(nullif(own, ''), cite) AS label, CASE WHEN starts_with(flat, own) THEN trim(regexp_replace(substr(flat, length(own) + 1), '^[ ：:>-]+', '')) ELSE trim(flat) END AS body FROM lab),
    six AS (SELECT doc_id, '- **' || label || '**：' || CASE WHEN length(body) > 120 THEN substr(body, 1, 120) || '…' ELSE body END || ' — 依据：原文 〔' || cite || '〕' AS p, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS k FROM pts WHERE body <> ''),
    per AS (SELECT doc_id, string_agg(p, chr(10) ORDER BY k) AS ps FROM six WHERE k <= 6 GROUP BY doc_id),
    whole AS (SELECT doc_id, list_filter(string_split(regexp_replace({_bare("string_agg(line, chr(10) ORDER BY pos)")}, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 8)[1] AS one FROM g GROUP BY doc_id),
    lead AS (SELECT doc_id, CASE WHEN length(coalesce(one, '文档 article 的要点如下。')) > 160 THEN substr(one, 1, 159) || '…' ELSE coalesce(one, '文档 article 的要点如下。') END AS one FROM whole)
    SELECT l.doc_id, array_to_string(['{markdown.LEAD}', one, '', '{markdown.POINTS}', coalesce(ps, '- **全文**：' || one || ' — 依据：原文 〔§全文〕'), {", ".join(f"'{x}'" for x in markdown.ASKS)}], chr(10)) AS markdown FROM lead l LEFT JOIN per ON l.doc_id = per.doc_id"""
)
def heuristic_summaries(spark, d):
    return markdown.heuristic_summary(_cards(v.table(spark, d, "documents")), "doc_id", "md")


@query(r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS chars, true AS lossless, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 12000 AS cut FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0", with_views=False)
def chunks_cover_texts(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    c = chunking.coverage(chunking.chunk(docs, "doc_id", "text"), "doc_id", docs, "text")
    return c.select("doc_id", "chars", "lossless", (F.col("n_segments") > 1).alias("cut"))


@query()
def chunk_segments(spark, d):
    s = chunking.chunk(v.table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", "idx", "start_offset", "end_offset", chunking.anchor(F.col("chapter"), F.col("idx"), F.col("page_range")).alias("anchor"))


@query("SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END, epoch_us(ts) * 100000000::HUGEINT + event_id) AS status, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n_events FROM events GROUP BY user_id", with_views=False)
def job_states(spark, d):
    return streams.batch_states(v.table(spark, d, "events")).select("user_id", "status", "errors", "n_events")


@query("SELECT k.status, count(e.status) AS n FROM (VALUES ('queued'), ('running'), ('paused'), ('completed'), ('failed'), ('cancelled')) k(status) LEFT JOIN (SELECT CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events) e ON k.status = e.status GROUP BY k.status", with_views=False)
def task_counts(spark, d):
    return jobs.status_counts(streams.statuses(v.table(spark, d, "events")))


@query("SELECT event_id AS task_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events ORDER BY CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 3 ELSE 0 END, ts, event_id LIMIT 100", with_views=False)
def task_snapshot(spark, d):
    t = streams.statuses(v.table(spark, d, "events")).select(F.col("event_id").alias("task_id"), "status", F.col("ts").alias("started_at"))
    return jobs.snapshot(t).select("task_id", "status")


@query("SELECT * FROM (SELECT user_id, event_type AS kind, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'click' THEN 1000 + event_id % 97 ELSE event_id % 97 + 1 END AS priority, event_id AS seq FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY priority, seq) = 1", with_views=False)
def job_queue(spark, d):
    i = F.col("event_id") % 97
    kind = F.when(F.col("event_type") == "click", "translate").otherwise("summarize")
    j = v.table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), jobs.priority(kind, i, F.col("event_type") == "error").alias("priority"), F.col("event_id").alias("seq"))
    return jobs.deduplicated(j, ["user_id", "kind"])


@query("SELECT event_type, CAST(max(running) AS BIGINT) AS peak FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT event_type, t, s, sum(s) AS d FROM (SELECT event_type, epoch_us(ts) // 1000000 AS t, 1 AS s FROM events UNION ALL SELECT event_type, epoch_us(ts) // 1000000 + 3600 + user_id * 10, -1 FROM events) GROUP BY ALL)) GROUP BY event_type", with_views=False)
def peak_concurrency(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = v.table(spark, d, "events").select("event_type", s.alias("started"), (s + 3600 + F.col("user_id") * 10).alias("ended"))
    return jobs.peak_concurrency(spans, "event_type")


@query("SELECT coalesce(l.resource, r.resource) AS resource, coalesce(slots, 0) AS slots, coalesce(in_use, 0) AS in_use, greatest(0, coalesce(slots, 0) - coalesce(in_use, 0)) AS available FROM (SELECT 's' || s_nationkey AS resource, count(*) AS slots FROM supplier GROUP BY 1) l FULL JOIN (SELECT 's' || (c_nationkey + 3) AS resource, count(*) // 10 AS in_use FROM customer GROUP BY 1) r ON l.resource = r.resource", with_views=False)
def resource_slots(spark, d):
    limits = v.table(spark, d, "supplier").groupBy(F.concat(F.lit("s"), "s_nationkey").alias("resource")).agg(F.count(F.lit(1)).alias("slots"))
    used = v.table(spark, d, "customer").groupBy(F.concat(F.lit("s"), F.col("c_nationkey") + 3).alias("resource")).agg(F.floor(F.count(F.lit(1)) / 10).alias("in_use"))
    return jobs.slots(limits, used)


@query("SELECT n.n_name AS profile, CAST(u.pos AS INTEGER) AS pos, u.resource, r.r_name FROM (SELECT n_name, [n_regionkey, 9, (n_regionkey + 1) % 5] AS ids FROM nation) n, LATERAL (SELECT unnest(n.ids) AS resource, unnest(range(3)) AS pos) u JOIN region r ON u.resource = r.r_regionkey", with_views=False)
def resource_chain(spark, d):
    k = F.col("n_regionkey")
    order = v.table(spark, d, "nation").select(F.col("n_name").alias("profile"), F.array(k, F.lit(9), (k + 1) % 5).alias("ids"))
    return jobs.chain(order, v.table(spark, d, "region").select(F.col("r_regionkey").alias("resource"), "r_name"))


@query("SELECT c_custkey AS machine, c_custkey % 60 AS ram, CASE WHEN c_custkey % 60 >= 40 THEN 'r4' WHEN c_custkey % 60 >= 30 THEN 'r3' WHEN c_custkey % 60 >= 20 THEN 'r2' WHEN c_custkey % 60 >= 10 THEN 'r1' ELSE 'r0' END AS model FROM customer", with_views=False)
def model_tiers(spark, d):
    tiers = v.table(spark, d, "region").select((F.col("r_regionkey") * 10).cast("long").alias("min_ram"), F.concat(F.lit("r"), "r_regionkey").alias("model"))
    return jobs.tier_for(v.table(spark, d, "customer").select(F.col("c_custkey").alias("machine"), (F.col("c_custkey") % 60).alias("ram")), tiers)


def _outputs(docs: DataFrame, *more: Column) -> DataFrame:
    """Model outputs made of whole texts: 0 to 4 sentences, 2 to 8 bullets of all shapes; sound, fenced, with a comma too many or missing, in two objects, or prose."""
    i = F.col("doc_id")
    body, n, m = F.coalesce(F.col("text"), F.lit("")), (i % 5).cast("int"), (i % 7 + 2).cast("int")
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    said_in = lambda k: F.when(k == 1, body).otherwise(F.lit("a body that says enough"))
    as_object = lambda k, label, said: F.concat(F.lit(f'{{"{label}": "b'), k, F.lit(f'", "{said}": '), quoted(said_in(k)), F.lit("}"))
    labelled = lambda k: quoted(F.concat(F.lit("b"), k.cast("string"), F.lit("："), said_in(k)))
    shape = lambda k: F.when(i % 3 == 0, as_object(k, "label", "body")).when(i % 3 == 1, labelled(k)).otherwise(as_object(k, "tag", "content"))
    shapes = F.transform(F.sequence(F.lit(1), m), shape)
    bullets = F.when(i % 6 == 4, F.array_join(shapes, " ")).otherwise(F.array_join(shapes, ", "))
    text_ = quoted(body)
    said = F.concat(F.lit("["), F.array_join(F.slice(F.concat(F.array(text_), F.array_repeat(F.lit('"more"'), 3)), F.lit(1), n), ", "), F.lit("]"))
    first = F.concat(F.lit('{"sentences": '), said, F.lit(', "bullets": ['), bullets, F.lit('], "notes": ["n", " ", "o", "p", "q"]'))
    good = F.concat(first, F.lit(', "label": "a label of more than twenty characters", "锚点": "§1"}'))
    parted = F.concat(first, F.lit('}, {"label": "a label of more than twenty characters", "anchor": "§1"}'))
    k = i % 8
    raw = F.when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 2, F.regexp_replace(good, r"\}$", ",}")).when(k == 3, parted).when(k == 4, F.concat(F.lit("So: "), good, F.lit(" Done."))).when(k == 5, F.concat(F.lit("Sorry: "), F.translate(body, "{", "("))).otherwise(good)
    return docs.select("doc_id", raw.alias("raw"), *more)


TRIMMED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
OUTPUTS = rf"SELECT doc_id, t, CASE WHEN doc_id % 8 <> 5 THEN doc_id % 5 END AS n_sentences, CASE WHEN doc_id % 8 <> 5 THEN doc_id % 7 + 2 END AS n_bullets, CASE WHEN t = '' AND doc_id % 3 <> 1 THEN 'b1' WHEN t = '' THEN 'b1：' ELSE substr(t, 1, 300) END AS body FROM (SELECT doc_id, {TRIMMED} AS t FROM documents)"


@query(rf"SELECT doc_id, n_sentences, n_bullets, CASE WHEN n_bullets IS NOT NULL THEN body END AS body, CASE WHEN n_bullets IS NOT NULL THEN 'a label of more than' END AS label, CASE WHEN n_bullets IS NULL THEN 'no JSON' WHEN NOT (n_sentences BETWEEN 1 AND 3 AND n_bullets BETWEEN 3 AND 7) THEN 'schema' WHEN length(regexp_replace(body, '^\s+|\s+$', '', 'g')) < 20 THEN 'too short' END AS problem FROM ({OUTPUTS})", with_views=False)
def summaries_validated(spark, d):
    s = _outputs(v.table(spark, d, "documents")).select("doc_id", model_output.summary(F.col("raw")).alias("s"))
    found = F.col("s.found").isNotNull()
    return s.select(
        "doc_id", F.when(found, F.size("s.sentences").cast("long")).alias("n_sentences"), F.when(found, F.size("s.bullets").cast("long")).alias("n_bullets"), F.get(F.col("s.bullets"), F.lit(0))["body"].alias("body"),
        F.col("s.label").alias("label"), model_output.problem(F.col("s")).alias("problem"),
    )


@query(rf"SELECT doc_id, CASE WHEN t = '' THEN NULL ELSE substr(t, 1, 300) END AS body FROM ({OUTPUTS}) WHERE n_bullets IS NOT NULL", with_views=False)
def summary_texts(spark, d):
    """The body of the first bullet, read back from the summary's text, between the sentences and the second bullet; null for a text that says nothing."""
    docs = v.table(spark, d, "documents")
    s = _outputs(docs, F.coalesce("text", F.lit("")).rlike(r"[^\t\n\f\r ]").alias("says")).select("doc_id", "says", model_output.summary(F.col("raw")).alias("s")).filter("s.found")
    s = s.select("doc_id", "says", "s", model_output.summary_text(F.col("s")).alias("plain"))
    before = F.when(F.size("s.sentences") > 0, F.concat(F.lit("总结: "), F.array_join("s.sentences", " "), F.lit("\n"))).otherwise("")
    rest = F.when(F.startswith("plain", before), F.substring("plain", F.length(before) + 1, F.length("plain")))
    told = F.regexp_extract(rest, r"(?s)^结构化要点:\n- b1：(.*)\n- b2：a body that says enough\n", 1)  # the last of them: a text may have such a line too
    return s.select("doc_id", F.when(F.col("says"), told).alias("body"))


@query()
def model_json_repaired(spark, d):
    return _outputs(v.table(spark, d, "documents")).select("doc_id", model_output.repaired_json(F.col("raw")).alias("json"))


#: Sentences are folded from left to right: what is told so far, how many claims, and the claim that may still get a note. A
#: section without text keeps the sign of the next heading, since the blank before that belongs to its own heading.
FOLDED = """WITH s AS (SELECT doc_id, source, list_transform(string_split_regex(text, '[.\n]+'), lambda x: ltrim(x || '。', ' ' || chr(9) || chr(13))) AS said FROM documents),
f AS (SELECT *, list_reduce(list_transform(CASE WHEN len(said) = 1 THEN ['📊。'] ELSE said[2:] END, lambda x: {'skim': '', 'n': 0, 'open': x}), lambda a, x: CASE WHEN a.open IS NULL THEN {'skim': a.skim, 'n': a.n, 'open': x.open}
  WHEN length(x.open) > length(a.open) AND length(x.open) >= 35 AND length(a.open) <= 60 THEN {'skim': a.skim || chr(10) || '· ' || a.open || chr(10) || '  ' || x.open, 'n': a.n + 1, 'open': NULL}
  ELSE {'skim': a.skim || chr(10) || '· ' || a.open, 'n': a.n + 1, 'open': x.open} END, {'skim': '', 'n': 0, 'open': NULL}) AS r FROM s),
v AS (SELECT *, r.n + CASE WHEN r.open IS NULL THEN 0 ELSE 1 END AS n FROM f)"""


@query(FOLDED + " SELECT doc_id, said[1] AS one_liner, CAST(n AS INTEGER) AS n_viewpoints, source AS author, CASE WHEN doc_id % 120 <= 100 THEN CAST(doc_id % 120 AS DOUBLE) END AS score, n >= 2 AS rich, substr(r.skim || coalesce(chr(10) || '· ' || r.open, ''), 2) AS skim FROM v", with_views=False)
def feed_summaries_parsed(spark, d):
    """Documents dressed as structured feed summaries: their first sentence, then all others as views."""
    said = F.transform(F.split("text", r"[.\n]+"), lambda x: F.concat(x, F.lit("。")))
    raw = F.concat_ws(" ", F.lit("📌 一句话摘要"), F.get(said, F.lit(0)), F.lit("💡 主要观点"), F.array_join(F.slice(said, F.lit(2), F.size(said)), " "), F.lit("📊 文章信息 AI 初评:"), F.col("doc_id") % 120, F.lit("作者:"), F.col("source"))
    p = v.table(spark, d, "documents").select("doc_id", news.parse_summary(raw).alias("p"))
    return p.select("doc_id", "p.one_liner", F.size("p.viewpoints").alias("n_viewpoints"), F.element_at(F.col("p.meta"), "author").alias("author"), news.score_hint(F.col("p")).alias("score"), news.is_rich(F.col("p")).alias("rich"), news.skim_text(F.col("p")).alias("skim"))


@query("SELECT s.segment_id, s.idx, s.idx >= 0 AND (b.segment_count = 30 OR s.idx + 5 < b.segment_count) AS valid FROM segments s JOIN books b ON s.book_id = b.book_id")
def reading_positions(spark, d):
    count = F.when(F.col("segment_count") == 30, 0).otherwise(F.col("segment_count"))
    s = v.segments(spark, d).select("segment_id", "book_id", "idx").join(v.books(spark, d).select("book_id", "segment_count"), "book_id")
    ok = library.valid_position(F.col("idx") + 5, count) & (F.col("idx") >= 0)
    return s.select("segment_id", "idx", ok.alias("valid"))


@query("SELECT n.note_id FROM notes n JOIN segments s ON n.segment_id = s.segment_id WHERE s.idx % 2 = 1")
def notes_misplaced(spark, d):
    s = v.segments(spark, d).select("segment_id", "book_id", "idx")
    said = F.when(F.col("idx") % 2 == 1, F.lit("another")).otherwise(F.col("book_id"))
    n = v.notes(spark, d).join(s, "segment_id").select("note_id", "segment_id", said.alias("book_id"))
    return library.misplaced(n, s).select("note_id")


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s % 60 = 0 THEN (s // 60) || 'm' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS label FROM (SELECT event_id, event_id % 400 AS s FROM events)", with_views=False)
def durations(spark, d):
    return v.table(spark, d, "events").select("event_id", text.duration((F.col("event_id") % 400).cast("double")).alias("label"))


@query("SELECT book_id, CASE WHEN length(book_id) % 2 = 0 THEN category ELSE '其他' END AS category FROM books")
def categories_normalised(spark, d):
    raw = F.when(F.length("book_id") % 2 == 0, F.concat(F.lit(" "), F.col("category"))).otherwise("unknown")
    return v.books(spark, d).select("book_id", library.category(raw).alias("category"))


@query(r"SELECT page_id, len(l) AS n_links, len(list_filter(l, lambda x: x[1:1] = '/' AND x[2:2] <> '/')) AS n_rooted FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*[\x22\x27]([^\x22\x27#]+)', 1) AS l FROM pages)", with_views=False)
def page_links(spark, d):
    links = text.hrefs(F.col("html"))
    full = F.transform(links, lambda x: text.resolved(x, F.col("url")))
    origin = F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit("/"))
    rooted = F.filter(F.zip_with(links, full, lambda x, y: x.startswith("/") & ~x.startswith("//") & y.startswith(origin)), lambda b: b)
    return v.table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(rooted).cast("long").alias("n_rooted"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, count(*) AS completion_tokens, CAST(CASE WHEN conv_id % 2 = 0 THEN sum(length(text)) + count(*) ELSE 7 END AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id", with_views=False)
def streamed_answers(spark, d):
    """Conversations sent as an event stream, a turn per delta and the usage at the end, and put together again."""
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    sent = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", delta.alias("x")))).alias("xs"), F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("k"))
    used = F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), F.struct(F.col("n").alias("prompt_tokens"), F.col("k").alias("completion_tokens"), F.when(F.col("conv_id") % 2 == 1, 7).alias("total_tokens")).alias("usage")))
    body = F.concat(F.array_join(F.transform("xs", lambda s: F.concat(F.lit("data: "), s["x"])), "\n\n"), F.lit("\n\ndata: "), used, F.lit("\n\ndata: [DONE]\n\ndata: later"))
    return sent.select("conv_id", text.stream_deltas(body).alias("answer"), text.stream_usage(body).alias("u")).select("conv_id", "answer", "u.*")


@query("SELECT segment_id, sha256(substr(raw_text, 1, 8000)) AS input_hash, CAST(least(length(raw_text), 8000) AS INTEGER) AS chars FROM segments")
def translation_inputs(spark, d):
    s = v.segments(spark, d).select("segment_id", settings.translation_input(F.col("raw_text")).alias("t"))
    return s.select("segment_id", F.sha2("t", 256).alias("input_hash"), F.length("t").alias("chars"))


@query("SELECT article_id, url FROM articles WHERE source_id = (SELECT min(source_id) FROM articles)")
def articles_of_source(spark, d):
    """The articles of the source that sorts first."""
    a = v.articles(spark, d)
    return news.of_source(a, a.agg(F.min("source_id")).first()[0]).select("article_id", "url")


@query("SELECT address, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS address FROM pages) GROUP BY address", with_views=False)
def pages_by_address(spark, d):
    return v.table(spark, d, "pages").groupBy(text.address_key(F.col("url")).alias("address")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT article_id, url, source_id FROM articles WHERE source_id NOT LIKE '%.org' OR source_id LIKE 'www.%'")
def articles_after_prune(spark, d):
    """Articles of retired sources go with them; the caller's own sources stay."""
    s = v.sources(spark, d)
    retired = s.filter("source_id LIKE '%.org'").join(s.filter("source_id LIKE 'www.%'"), "source_id", "left_anti")
    return library.cascade(v.articles(spark, d), retired, "source_id").select("article_id", "url", "source_id")


from leafmill.plans import asked, changes, files, found, queue_log, queue_stream, shown  # noqa: E402, F401
