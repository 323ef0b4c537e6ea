"""Queries of changes to a library, and of what it shows of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import library, news, ordering, settings
from leafmill.plans import views as v
from leafmill.plans.register import query

PROGRESS = "SELECT book_id, count(*) AS total, count(*) FILTER (summary_status = 'ready') AS ready FROM segments GROUP BY book_id"
STATES = f"SELECT p.book_id, p.total, p.ready, CASE WHEN p.ready >= p.total THEN 'summarized' WHEN b.status = 'reading' THEN 'running' WHEN b.status = 'error' THEN 'paused' ELSE 'idle' END AS state, p.total - p.ready AS queued FROM ({PROGRESS}) p JOIN books b ON b.book_id = p.book_id"


def _states(spark, d):
    b = library.with_progress(v.books(spark, d), v.segments(spark, d))
    state = library.state(F.col("total"), F.col("ready"), F.col("status") == "reading", F.col("status") == "error", F.lit(False))
    return b.select("book_id", "total", "ready", state.alias("state"), (F.col("total") - F.col("ready")).alias("queued"))


@query(f"SELECT book_id, state FROM ({STATES}) WHERE state IN ('idle', 'paused')")
def library_idle(spark, d):
    return library.client_filter(_states(spark, d), "idle").select("book_id", "state")


@query(f"""SELECT b.book_id, b.title, b.status, b.is_favorite, CASE WHEN b.metadata_json NOT LIKE '%broken' THEN regexp_extract(b.metadata_json, 'total_char_count": ([0-9]+)', 1) END AS total_char_count,
CASE WHEN b.metadata_json NOT LIKE '%broken' THEN regexp_extract(b.metadata_json, 'chunker_version": "([^"]*)"', 1) END AS chunker_version, s.ready, s.total, CASE WHEN b.status <> 'processing' THEN s.state END AS state, CASE WHEN b.status <> 'processing' THEN s.queued END AS queued FROM books b JOIN ({STATES}) s ON b.book_id = s.book_id""")
def books_public(spark, d):
    return library.public(v.books(spark, d), _states(spark, d))


@query("SELECT n.note_id, s.book_id, n.segment_id, CAST(row_number() OVER (PARTITION BY s.book_id ORDER BY n.created_at DESC, n.note_id) AS INTEGER) AS place FROM notes n JOIN segments s ON n.segment_id = s.segment_id")
def notes_by_book(spark, d):
    n = v.notes(spark, d).join(v.segments(spark, d).select("segment_id", "book_id"), "segment_id")
    latest = ordering.by_ranges(library.notes_of(n).withColumn("turned", -F.col("created_at")), ["book_id"], ["turned", "note_id"], "place")
    return latest.select("note_id", "book_id", "segment_id", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT source_id, url, length(source_id) % 2 = 0 AS preset FROM sources")
def sources_public(spark, d):
    s = v.sources(spark, d)
    return library.is_preset(s, s.filter("length(source_id) % 2 = 0")).select("source_id", "url", "preset")


@query("SELECT book_id, 2 AS from_idx, to_idx, CASE WHEN to_idx < n AND 2 < n THEN to_idx - 2 END AS delta FROM (SELECT book_id, count(*) AS n, CAST(hash_idx AS INTEGER) AS to_idx FROM (SELECT book_id, (SELECT count(*) FROM books) * 2 AS hash_idx FROM segments) GROUP BY book_id, hash_idx)")
def reading_jumps(spark, d):
    """From the third segment to one as far on as twice the number of books, which short books don't have."""
    b = v.books(spark, d)
    to = b.agg((F.count(F.lit(1)) * 2).cast("int").alias("to_idx"))
    moves = b.select("book_id", F.lit(2).alias("from_idx")).crossJoin(F.broadcast(to))  # a single row
    return library.position_delta(v.segments(spark, d).select("book_id", "idx"), moves)


@query("SELECT book_id, substr(raw_text, 1, 2000) AS sample FROM segments WHERE idx = 0")
def book_samples(spark, d):
    return library.first_sample(v.segments(spark, d))


@query("SELECT doc_id, sha256(text) AS file_hash, CASE WHEN doc_id <> min(doc_id) OVER w THEN 'duplicate' WHEN bool_or(source LIKE '%1') OVER w THEN 'replace' ELSE 'import' END AS action, CASE WHEN doc_id = min(doc_id) OVER w THEN min(CASE WHEN source LIKE '%1' THEN source END) OVER w END AS purged FROM documents WINDOW w AS (PARTITION BY sha256(text))", with_views=False)
def import_over_stored(spark, d):
    """Every text imported over a library that has those of some sources."""
    docs = v.table(spark, d, "documents").select("doc_id", "source", "text")
    stored = docs.filter(F.col("source").endswith("1")).select(F.col("source").alias("book_id"), F.sha2("text", 256).alias("file_hash"))
    return library.imported(docs.select("doc_id", "text"), stored, "text", "doc_id", overwrite=True)


@query("""SELECT 'books' AS name, count(*) AS n FROM books WHERE status <> 'error' UNION ALL SELECT 'segments', count(*) FROM segments s JOIN books b ON s.book_id = b.book_id WHERE b.status <> 'error'
UNION ALL SELECT 'notes', count(*) FROM notes n JOIN segments s ON n.segment_id = s.segment_id JOIN books b ON s.book_id = b.book_id WHERE b.status <> 'error' UNION ALL SELECT 'jobs', count(*) FROM segments s JOIN books b ON s.book_id = b.book_id WHERE b.status <> 'error' AND s.summary_status = 'pending'
UNION ALL SELECT 'index', count(*) + (SELECT count(*) FROM books WHERE status <> 'error') FROM segments s JOIN books b ON s.book_id = b.book_id WHERE b.status <> 'error'
UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations c LEFT JOIN segments s ON c.conv_id = s.segment_id LEFT JOIN books b ON s.book_id = b.book_id WHERE b.status IS NULL OR b.status <> 'error'
UNION ALL SELECT 'messages', count(*) FROM conversations c LEFT JOIN segments s ON c.conv_id = s.segment_id LEFT JOIN books b ON s.book_id = b.book_id WHERE b.status IS NULL OR b.status <> 'error'""")
def books_deleted(spark, d):
    """What is left of each table when the books with errors go."""
    from functools import reduce

    books, segments = v.books(spark, d), v.segments(spark, d).select("segment_id", "book_id", "summary_status")
    messages = v.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    sessions = messages.select("session_id").distinct().join(segments.select(F.col("segment_id").alias("session_id"), "book_id"), "session_id", "left")
    notes = v.notes(spark, d).join(segments, "segment_id").select("note_id", "book_id")
    tables = {"books": books.select("book_id"), "segments": segments, "notes": notes, "jobs": segments.filter("summary_status = 'pending'"), "index": segments.select("book_id").unionByName(books.select("book_id")), "sessions": sessions, "messages": messages}
    left = library.without_books(tables, books.filter("status = 'error'"))
    return reduce(lambda a, b: a.unionByName(b), (t.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k, t in left.items()))


@query("SELECT book_id, CASE WHEN status = 'processing' THEN 'unread' ELSE status END AS status, CAST(NULL AS VARCHAR) AS notes_json, author FROM books")
def books_migrated(spark, d):
    b = v.books(spark, d).select("book_id", "status", "author")
    return library.migrated(b, {"notes_json": "string", "author": "string"})


@query("SELECT conv_id AS session_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id", with_views=False)
def sessions_touched(spark, d):
    """Sessions as of their first turn, then all turns added."""
    m = v.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"))
    return library.with_messages(m.filter("created_at = 0").withColumnRenamed("created_at", "updated_at"), m)


@query("SELECT n.note_id, n.segment_id, s.book_id, n.content FROM notes n JOIN segments s ON n.segment_id = s.segment_id WHERE n.note_id % 4 <> 1 AND NOT (n.note_id % 2 = 0 AND s.idx % 3 = 0)")
def notes_changed(spark, d):
    """Odd notes are there, even ones are added (some with a wrong book), and a quarter is deleted."""
    n = v.notes(spark, d).join(v.segments(spark, d).select("segment_id", "book_id", "idx"), "segment_id")
    own = n.filter("note_id % 2 = 1").select("note_id", "segment_id", "book_id", "content")
    said = F.when(F.col("idx") % 3 == 0, F.concat("book_id", F.lit("?"))).otherwise(F.col("book_id"))
    added = n.filter("note_id % 2 = 0").select("note_id", "segment_id", said.alias("book_id"), "content")
    return library.with_notes(own, added, n.filter("note_id % 4 = 1"), v.segments(spark, d))


@query("SELECT CASE length(source_id) % 3 WHEN 2 THEN source_id ELSE url END AS url, CASE WHEN title IS NOT NULL THEN title WHEN length(source_id) % 3 = 2 THEN source_id ELSE url END AS title, CASE WHEN length(source_id) % 3 = 2 THEN 'invalid' WHEN length(source_id) % 2 = 0 THEN 'duplicate' ELSE 'added' END AS action FROM sources")
def sources_added(spark, d):
    s = v.sources(spark, d)
    wanted = s.select(F.when(F.length("source_id") % 3 == 2, F.col("source_id")).otherwise(F.concat(F.lit(" "), "url")).alias("url"), F.coalesce("title", F.lit(" ")).alias("title"))
    return library.add_sources(s.filter("length(source_id) % 2 = 0"), wanted)


@query("SELECT s.source_id, count(a.article_id) AS n FROM sources s JOIN articles a ON s.source_id = a.source_id WHERE s.source_id NOT LIKE 'm.%' GROUP BY s.source_id UNION ALL SELECT 'gone', count(*) FROM articles WHERE source_id LIKE 'm.%'")
def sources_deleted(spark, d):
    """Articles by what is left of their sources: those of deleted ones stay."""
    s = v.sources(spark, d)
    left = library.without_sources(s, s.filter("source_id LIKE 'm.%'")).select("source_id", F.lit(True).alias("there"))
    a = v.articles(spark, d).join(left, "source_id", "left")
    return a.groupBy(F.when(F.col("there"), F.col("source_id")).otherwise("gone").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT book_id, CASE WHEN segment_count % 3 = 0 THEN 'New ' || book_id ELSE title END AS title, CASE WHEN segment_count % 2 = 0 THEN CASE WHEN is_favorite THEN '文学' ELSE '其他' END ELSE category END AS category, CASE WHEN segment_count % 2 = 0 THEN NOT is_favorite ELSE is_favorite END AS is_favorite, segment_count % 3 = 0 AS reindex FROM books")
def books_patched(spark, d):
    b = v.books(spark, d)
    n = F.col("segment_count")
    title = F.when(n % 3 == 0, F.concat(F.lit(" New "), "book_id", F.lit(" "))).when(n % 3 == 1, "  ")
    p = b.select("book_id", F.when(n % 2 == 0, ~F.col("is_favorite")).alias("new_favorite"), F.when(n % 2 == 0, F.when(F.col("is_favorite"), " 文学").otherwise("unknown")).alias("new_category"), title.alias("new_title"))
    return library.patched(b, p).select("book_id", "title", "category", "is_favorite", "reindex")


@query("SELECT article_id, arg_min(CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE title END, page_id) AS title, arg_min(url, page_id) AS url, arg_min(CASE WHEN page_id % 3 = 0 THEN 7.0 ELSE score_hint END, page_id) AS score_hint FROM articles GROUP BY article_id")
def articles_updated(spark, d):
    """Updates that also name fields which none may set."""
    p = F.col("page_id")
    a = v.articles(spark, d).groupBy("article_id").agg(F.min_by(F.struct("page_id", "title", "url", "score_hint"), "page_id").alias("x")).select("article_id", "x.*")
    fields = F.map_filter(F.create_map(F.lit("title"), F.when(p % 2 == 0, F.concat(F.lit("T"), p)), F.lit("score_hint"), F.when(p % 3 == 0, "7"), F.lit("url"), F.lit("http://other")), lambda k, x: x.isNotNull())
    return library.updated(a, a.select("article_id", fields.alias("fields"))).select("article_id", "title", "url", "score_hint")


@query("SELECT book_id, CASE WHEN segment_count % 3 = 0 THEN NULL WHEN segment_count % 3 = 1 THEN category ELSE '其他' END AS category FROM books")
def categories_set_by_hand(spark, d):
    n = F.col("segment_count") % 3
    raw = F.when(n == 1, F.col("category")).when(n == 2, "x")
    return v.books(spark, d).select("book_id", library.manual_category(raw).alias("category"))


@query("SELECT book_id, array_to_string(CASE WHEN category = '文学' THEN ['文学', '其他'] WHEN category = '其他' THEN ['其他', '文学'] ELSE [category, '文学', '其他'] END, '|') AS offered FROM books")
def categories_offered(spark, d):
    """Each book's own category, then two fixed ones, each once."""
    return v.books(spark, d).select("book_id", F.array_join(library.distinct_in_order(F.array("category"), F.array(F.lit("文学"), F.lit("其他"))), "|").alias("offered"))


@query("SELECT article_id, page_id, published_at FROM articles ORDER BY published_at DESC NULLS LAST, synced_at DESC, article_id LIMIT 50")
def articles_recent(spark, d):
    return news.recent(v.articles(spark, d)).select("article_id", "page_id", "published_at")


@query("SELECT s.source_id, CASE WHEN length(s.source_id) % 7 = 0 THEN 0 ELSE count(a.article_id) END AS fetched, CASE WHEN length(s.source_id) % 7 = 0 THEN 0 ELSE count(DISTINCT CASE WHEN a.article_id NOT IN (SELECT article_id FROM articles WHERE page_id % 3 = 0) THEN a.article_id END) END AS inserted, CASE WHEN length(s.source_id) % 7 = 0 THEN 'timeout' END AS error FROM sources s LEFT JOIN articles a ON a.source_id = s.source_id GROUP BY s.source_id")
def sources_synced(spark, d):
    a = v.articles(spark, d)
    s = v.sources(spark, d).select("source_id", F.when(F.length("source_id") % 7 == 0, "timeout").alias("error"))
    return news.sync_counts(a.select("source_id", "article_id"), a.filter("page_id % 3 = 0").select("article_id"), s)


@query("SELECT page_id, 'attachment; filename=\"' || coalesce(nullif(regexp_replace(regexp_replace(n, '[^\\x00-\\x7F]', '', 'g'), '^[._\\- ]+|[._\\- ]+$', '', 'g'), ''), 'summary.md') || '\"; filename*=UTF-8''''' || replace(url_encode(n), '%2F', '/') AS header FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '读书' WHEN page_id % 3 = 1 THEN ' é~x*(1) ' || page_id || '.md' ELSE url END AS n FROM pages)", with_views=False)
def attachment_headers(spark, d):
    p = F.col("page_id")
    name = F.when(p % 3 == 0, "读书").when(p % 3 == 1, F.concat(F.lit(" é~x*(1) "), p, F.lit(".md"))).otherwise(F.col("url"))
    return v.table(spark, d, "pages").select("page_id", text.attachment(name).alias("header"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 AND c_nationkey > 0 THEN c_nationkey WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 8 ELSE 4 END AS at_once, c_mktsegment = 'BUILDING' OR c_custkey % 2 = 0 AS ready, CASE WHEN c_custkey % 4 = 0 THEN 'wikipedia' WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'tavily' ELSE 'ddgs' END AS web FROM customer", with_views=False)
def resources_resolved(spark, d):
    c = F.col("c_custkey")
    provider = F.when(F.col("c_mktsegment") == "BUILDING", "ollama").when(F.col("c_mktsegment") == "MACHINERY", " Cursor ").otherwise("openai")
    key, web = F.when(c % 2 == 0, "k").otherwise(" "), F.when(c % 4 == 0, " Wikipedia").when(c % 4 == 1, "tavily").when(c % 4 == 2, "bing")
    own = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey")).otherwise(0)
    return v.table(spark, d, "customer").select(c.alias("id"), settings.concurrency(provider, own).alias("at_once"), settings.configured(provider, key).alias("ready"), settings.web_provider(web, F.when(c % 3 == 0, "k")).alias("web"))


@query("SELECT n_name AS profile, n_regionkey = 0 AS local_first, n_regionkey <> 0 AS cloud_first, n_regionkey IN (0, 4) AS uses_local, CASE WHEN n_nationkey > 4 THEN n_nationkey ELSE 4 END AS most_at_once FROM nation", with_views=False)
def chain_facts(spark, d):
    """A chain of two resources for each nation, of its region and the next."""
    r = F.col("n_regionkey")
    named = lambda x: F.when(x == 0, "ollama").otherwise("openai")
    steps = F.explode(F.array(F.struct(F.lit(0).alias("pos"), named(r).alias("provider"), F.lit(0).cast("long").alias("concurrency")), F.struct(F.lit(1).alias("pos"), named((r + 1) % 5).alias("provider"), F.col("n_nationkey").cast("long").alias("concurrency"))))
    c = v.table(spark, d, "nation").select(F.col("n_name").alias("profile"), steps.alias("s")).select("profile", "s.*")
    return settings.chain_facts(c)


@query("SELECT p_partkey AS field, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'own' WHEN p_partkey % 2 = 0 AND p_partkey < 100 THEN NULL ELSE p_name END AS text FROM part", with_views=False)
def prompts_overlaid(spark, d):
    """A third of the fields isn't given, a third is, a third is blank; of the blank ones some can be cleared."""
    p = v.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("field"), F.col("p_name").alias("text"))
    k = F.col("field").cast("int") % 3
    own = p.filter(k != 0).select("field", F.when(k == 1, "own").otherwise(" ").alias("text"))
    found = settings.prompts(p, own, tuple(str(i) for i in range(0, 100, 2)))
    return found.select(F.col("field").cast("long").alias("field"), "text")


@query("SELECT event_id AS call_id, '优先级链全部失败（已尝试：' || CASE WHEN event_id % 2 = 0 THEN 'a, b' ELSE '（无）' END || '）：' || CASE event_id % 4 WHEN 0 THEN '未知错误' WHEN 1 THEN 'cursor api_key not set。Cursor API Key 未配置' WHEN 2 THEN 'openai base_url not set。请在设置中配置对应资源的 Base URL' ELSE '404 Not Found。请检查 Base URL 是否正确（OpenRouter 应为 https://openrouter.ai/api/v1）' END AS message FROM events", with_views=False)
def chain_failures(spark, d):
    k = F.col("event_id") % 4
    detail = F.when(k == 1, "cursor api_key not set").when(k == 2, "openai base_url not set").when(k == 3, "404 Not Found")
    tried = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return v.table(spark, d, "events").select(F.col("event_id").alias("call_id"), settings.chain_failure(tried, detail).alias("message"))


@query("SELECT user_id AS resource, arg_max(event_type, s) AS profile, arg_max(event_id % 900, s) AS duration_ms, arg_max(event_type <> 'error', s) AS ok FROM (SELECT *, epoch_us(ts) * 100000000::HUGEINT + event_id AS s FROM events) GROUP BY user_id", with_views=False)
def last_calls(spark, d):
    started = F.struct("ts", "event_id")
    c = v.table(spark, d, "events").select(F.col("user_id").alias("resource"), F.col("event_type").alias("profile"), started.alias("started"), (F.col("event_id") % 900).alias("duration_ms"), F.when(F.col("event_type") == "error", "e").alias("error"))
    return settings.last_calls(c).select("resource", "profile", "duration_ms", "ok")
