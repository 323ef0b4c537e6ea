"""Queries of the work queue, over the events table as its log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import queue
from leafmill.plans import views as v
from leafmill.plans.register import query

#: A few events pause or resume everything, early in the log.
LOG = """WITH e AS (SELECT event_id AS seq, 'b' || (user_id % 60) AS book_id, CAST(event_id % 7 AS INTEGER) AS idx, event_type AS t, event_id FROM events), log AS (SELECT seq,
CASE WHEN event_id < 2000 AND event_id % 500 IN (7, 9) THEN NULL ELSE book_id END AS book_id, CASE WHEN event_id < 2000 AND event_id % 500 IN (7, 9) OR event_id % 11 = 0 THEN NULL ELSE idx END AS idx,
CASE WHEN event_id < 2000 AND event_id % 500 = 7 THEN 'pause_all' WHEN event_id < 2000 AND event_id % 500 = 9 THEN 'resume_all' WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'pause' ELSE 'resume' END
WHEN t = 'signup' THEN 'enqueue' WHEN t = 'view' THEN 'start' WHEN t = 'purchase' THEN 'ready' WHEN t = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'retry' WHEN event_id % 3 = 1 THEN 'cancel' ELSE 'regenerate' END AS command FROM e)"""
#: The same states step by step: running counts of errors since the last reset, and flags as they stand after the last command.
STATES = (
    LOG
    + """, j AS (SELECT *, sum(CASE WHEN command IN ('retry', 'regenerate', 'ready') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, idx ORDER BY seq) AS era FROM log WHERE idx IS NOT NULL),
jobs AS (SELECT j.book_id, j.idx, arg_max(command, seq) AS last, max(CASE WHEN command = 'start' THEN seq END) AS started, count(*) FILTER (command = 'error' AND j.era = m.era) AS errors FROM j JOIN (SELECT book_id, idx, max(era) AS era FROM j GROUP BY ALL) m ON j.book_id = m.book_id AND j.idx = m.idx GROUP BY j.book_id, j.idx),
a AS (SELECT max(seq) FILTER (command = 'pause_all') AS off, max(seq) FILTER (command IN ('resume_all', 'resume')) AS on_, max(seq) FILTER (command IN ('pause_all', 'resume_all')) AS cleared FROM log),
p AS (SELECT book_id, coalesce(max(seq) FILTER (command = 'pause'), -1) > greatest(coalesce(max(seq) FILTER (command = 'resume'), -1), coalesce(any_value(a.cleared), -1)) OR coalesce(any_value(a.off), -1) > coalesce(any_value(a.on_), -1) AS paused FROM log, a WHERE book_id IS NOT NULL GROUP BY book_id),
s AS (SELECT *, CASE WHEN last = 'ready' THEN 'ready' WHEN last = 'start' THEN 'running' WHEN last = 'cancel' THEN 'cancelled' WHEN last = 'error' AND errors >= 3 THEN 'failed' ELSE 'pending' END AS was FROM jobs),
places AS (SELECT s.book_id, s.idx, CASE WHEN paused AND was = 'running' THEN 'pending' ELSE was END AS status, errors, started, CASE WHEN paused AND was IN ('running', 'pending') THEN 'backlog' WHEN was = 'pending' THEN 'queued' WHEN was = 'running' THEN 'active' ELSE 'none' END AS place FROM s JOIN p ON s.book_id = p.book_id)"""
)


def _log(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("event_id"), F.col("event_type")
    all_, own = (i < 2000) & (i % 500).isin(7, 9), i % 11 == 0
    command = F.when(all_, F.when(i % 500 == 7, "pause_all").otherwise("resume_all")).when(own, F.when(i % 2 == 0, "pause").otherwise("resume"))
    command = command.when(t == "signup", "enqueue").when(t == "view", "start").when(t == "purchase", "ready").when(t == "error", "error").when(i % 3 == 0, "retry").when(i % 3 == 1, "cancel").otherwise("regenerate")
    book = F.when(~all_, F.concat(F.lit("b"), F.col("user_id") % 60))
    return v.table(spark, d, "events").select(i.alias("seq"), book.alias("book_id"), F.when(~all_ & ~own, (i % 7).cast("int")).alias("idx"), command.alias("command"))


@query(STATES + " SELECT book_id, idx, status, errors, started, place FROM places", with_views=False)
def queue_places(spark, d):
    return queue.places(_log(spark, d))


@query(STATES + " SELECT book_id, paused FROM p", with_views=False)
def queue_pauses(spark, d):
    return queue.pauses(_log(spark, d))


@query(STATES + " SELECT book_id, idx, CASE WHEN place = 'active' THEN 'pending' ELSE status END AS status, CASE WHEN place = 'active' THEN 'queued' ELSE place END AS place FROM places", with_views=False)
def queue_recovered(spark, d):
    return queue.recovered(queue.places(_log(spark, d))).select("book_id", "idx", "status", "place")


@query(STATES + " SELECT book_id, count(*) AS running, arg_min(idx, started) AS first_idx, arg_max(idx, started) AS last_idx FROM places WHERE place = 'active' GROUP BY book_id", with_views=False)
def queue_active(spark, d):
    return queue.active(queue.places(_log(spark, d)))


@query(STATES + ", b AS (SELECT book_id, count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (place = 'queued') AS queued, count(*) FILTER (place = 'active') AS running FROM places GROUP BY book_id) SELECT b.book_id, total, ready, CASE WHEN ready >= total THEN 'summarized' WHEN running > 0 THEN 'running' WHEN paused THEN 'paused' WHEN queued > 0 THEN 'queued' ELSE 'idle' END AS state, queued FROM b JOIN p ON b.book_id = p.book_id", with_views=False)
def queue_book_states(spark, d):
    log = _log(spark, d)
    found = queue.places(log)
    progress = found.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("ready"))
    return queue.book_states(found, progress, queue.pauses(log))


@query(STATES + " SELECT count(*) FILTER (place = 'queued') AS depth, count(*) FILTER (place = 'active') AS running, count(*) FILTER (place = 'backlog') AS backlog, (SELECT count(*) FROM p WHERE paused) AS paused_books, 4 AS workers FROM places", with_views=False)
def queue_diagnostics(spark, d):
    log = _log(spark, d)
    return queue.diagnostics(queue.places(log), queue.pauses(log), 4)


@query(LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY book_id, idx, command ORDER BY seq) AS nth FROM log WHERE command IN ('ready', 'error')) SELECT seq, r.book_id, idx, command, CAST(sum(CASE WHEN command = 'ready' AND nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r.book_id ORDER BY seq) AS BIGINT) AS ready, total FROM r JOIN (SELECT book_id, count(DISTINCT idx) AS total FROM log GROUP BY book_id) t ON r.book_id = t.book_id", with_views=False)
def queue_events_with_progress(spark, d):
    log = _log(spark, d)
    return queue.with_progress(log, log.groupBy("book_id").agg(F.count_distinct("idx").alias("total")))


@query(LOG + ", b AS (SELECT book_id, idx, command, seq, sum(CASE WHEN command IN ('retry', 'regenerate', 'ready') THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, idx ORDER BY seq) AS era FROM log WHERE idx IS NOT NULL AND seq <= 5000), l AS (SELECT b.book_id, b.idx, arg_max(command, seq) AS last, count(*) FILTER (command = 'error' AND b.era = m.era) AS errors FROM b JOIN (SELECT book_id, idx, max(era) AS era FROM b GROUP BY ALL) m ON b.book_id = m.book_id AND b.idx = m.idx GROUP BY b.book_id, b.idx) SELECT CAST(5000 AS BIGINT) AS seq, book_id, idx, 'is ' || CASE WHEN last = 'ready' THEN 'ready' WHEN last = 'start' THEN 'running' WHEN last = 'cancel' THEN 'cancelled' WHEN last = 'error' AND errors >= 3 THEN 'failed' ELSE 'pending' END AS what FROM l UNION ALL SELECT seq, book_id, idx, command FROM log WHERE seq > 5000", with_views=False)
def queue_snapshot_then_events(spark, d):
    return queue.snapshot_then(_log(spark, d), 5000)


@query(LOG + ", w AS (SELECT DISTINCT 'b' || (user_id % 90) AS book_id FROM events) SELECT w.book_id, w.book_id IN (SELECT book_id FROM log WHERE book_id IS NOT NULL) AS affected FROM w", with_views=False)
def queue_batch(spark, d):
    """Ninety books wanted, of which sixty are there."""
    wanted = v.table(spark, d, "events").select(F.concat(F.lit("b"), F.col("user_id") % 90).alias("book_id"))
    return queue.batch(wanted, _log(spark, d).filter("book_id IS NOT NULL").select("book_id"))


@query(LOG + " SELECT DISTINCT book_id, idx, 'pending' AS status, 0 AS errors FROM (SELECT book_id, unnest([1, 3]) AS idx FROM log WHERE book_id IS NOT NULL)", with_views=False)
def queue_after_retries(spark, d):
    """Numbers 3, 1, 3 and -1 of every book tried again, after whatever was before."""
    log = _log(spark, d)
    end = 1 << 40
    wanted = log.filter("book_id IS NOT NULL").select("book_id", F.array(*[F.lit(x) for x in (3, 1, 3, -1)]).alias("ids")).distinct()
    again = log.unionByName(queue.retry_commands(wanted, end))
    return queue.places(again).filter("idx IN (1, 3)").select("book_id", "idx", "status", F.col("errors").cast("int").alias("errors"))


@query("SELECT event_id AS task_id, event_type AS kind, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' ELSE 'recent' END AS shown FROM events", with_views=False)
def tasks_shown(spark, d):
    from leafmill.streaming import jobs as streams

    e = v.table(spark, d, "events")
    kinds = e.select("event_id", F.col("event_type").alias("kind"))
    return queue.partitions(streams.statuses(e).join(kinds, "event_id")).select(F.col("event_id").alias("task_id"), "kind", "shown")


@query("SELECT event_id AS task_id FROM events WHERE event_type = 'view'", with_views=False)
def tasks_selected(spark, d):
    from leafmill.streaming import jobs as streams

    e = v.table(spark, d, "events")
    return queue.selected(streams.statuses(e).withColumn("kind", F.lit("job")), "running", "job").join(e.filter("event_type = 'view'").select("event_id"), "event_id").select(F.col("event_id").alias("task_id"))


@query("SELECT 'u' || user_id AS book_id, arg_max(event_id % 101, event_id) AS percent FROM events GROUP BY user_id", with_views=False)
def ingest_progress(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("book_id"), (F.col("event_id") % 101).alias("percent"))
    return queue.last_progress(e)


@query("SELECT segment_id, book_id FROM segments s JOIN documents d ON s.segment_id = d.doc_id WHERE s.summary_status = 'ready' AND d.lang <> 'en' AND coalesce(s.translation, '') = ''")
def translations_due(spark, d):
    from leafmill.functions import language

    lang = v.table(spark, d, "documents").select(F.col("doc_id").alias("segment_id"), "lang")
    s = v.segments(spark, d).join(lang, "segment_id")
    needed = language.needs_translation(F.col("lang"), F.lit("en"), F.lit(None).cast("string"))
    return queue.translations_due(s, needed).select("segment_id", "book_id")
