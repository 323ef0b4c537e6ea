"""Queries of the work queue as a stream: the events table arrives in a few parts, one for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import queue
from leafmill.plans import views as v
from leafmill.plans.queue_log import STATES, _log
from leafmill.plans.register import ORACLES, query
from leafmill.sources.shared import folder
from leafmill.streaming import queue as streams

PARTS, AFTER = 4, 5000


def ended(of, spark: SparkSession, d: str, schema: str) -> DataFrame:
    """What the stream of(log) has said when the log with its times has come, part by part in order of seq.

    A part is as many files as its rows make, and one micro-batch: the stream stops when it has read them all, and goes
    on from its checkpoint when the next part is there.
    """
    times = v.table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts")
    log, path, out, checkpoint = _log(spark, d).join(times, "seq"), folder(spark, "log"), folder(spark, "said"), folder(spark, "streams")
    end = times.agg(F.max("seq")).first()[0] or 0
    for k in range(PARTS):
        log.filter(F.floor(F.col("seq") * PARTS / (end + 1)) == k).write.mode("append").parquet(path)
        streams.to_folder(of(spark.readStream.schema(log.schema).parquet(path)), out, checkpoint).awaitTermination()
    return streams.said(spark, out, schema)


@query(STATES + " SELECT book_id, idx, status, errors, started, place, false AS overdue FROM places", with_views=False)
def queue_streamed(spark, d):
    """The states of jobs from a stream, with their places; the log is no longer than it may be late, so that no timer ends before it."""
    said = ended(lambda log: streams.job_changes(log, late="1000 days"), spark, d, streams.JOB)
    jobs = streams.latest(said, "book_id", "idx")
    return queue.placed(jobs, queue.pauses(_log(spark, d))).select("book_id", "idx", "status", "errors", "started", "place", "overdue")


@query(ORACLES["queue_events_with_progress"], with_views=False)
def queue_progress_streamed(spark, d):
    said = ended(streams.progress, spark, d, streams.PROGRESS)
    totals = _log(spark, d).groupBy("book_id").agg(F.count_distinct("idx").alias("total"))
    return said.join(totals, "book_id", "left").select("seq", "book_id", "idx", "command", "ready", "total")


@query(
    f"""SELECT seq, book_id, idx, what, upper(book_id) AS title,
    'data: {{"seq":' || seq || coalesce(',"book_id":"' || book_id || '"', '') || coalesce(',"idx":' || idx, '') || ',"what":"' || what || '"' || coalesce(',"title":"' || upper(book_id) || '"', '') || '}}' || chr(10) || chr(10) AS text
    FROM ({ORACLES["queue_snapshot_then_events"]})""",
    with_views=False,
)
def queue_feed(spark, d):
    """What a listener gets that joins after an event: the snapshot, and then each later event, once, with its book's title."""
    books = _log(spark, d).filter("book_id IS NOT NULL").select("book_id", F.upper("book_id").alias("title")).distinct()
    first = queue.snapshot_then(_log(spark, d).filter(F.col("seq") <= AFTER), AFTER).join(books, "book_id", "left")
    first = streams.with_text(first.select("seq", "book_id", "idx", "what", "title"))
    said = ended(lambda log: streams.events(log, books, AFTER), spark, d, "seq long, book_id string, idx int, what string, title string, text string")
    return first.unionByName(said.drop("batch"))
