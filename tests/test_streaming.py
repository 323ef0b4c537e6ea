"""Streams of the queue: stopped, restarted and repeated, they end where the batch form does; timers; a feed without doubles."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators import queue
from leafmill.plans import queue_log, views
from leafmill.streaming import queue as streams

DATA = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")
T0 = datetime(2024, 1, 1)
LOG = "seq long, ts timestamp, book_id string, idx int, command string"


@pytest.fixture(scope="module")
def log(spark):
    times = views.table(spark, DATA, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return queue_log._log(spark, DATA).join(times, "seq").select("seq", "ts", "book_id", "idx", "command").cache()


def stream(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path):
    streams.to_folder(df, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()


def forget_last_commit(tmp_path):
    """As if the job had died between the files of its last batch and the note that it was done."""
    commits = [f for f in os.listdir(tmp_path / "checkpoint/commits") if f.isdigit()]
    last = max(commits, key=int)
    for f in (last, f".{last}.crc"):
        if (tmp_path / "checkpoint/commits" / f).exists():
            os.remove(tmp_path / "checkpoint/commits" / f)
    return int(last)


def test_a_restarted_replay_ends_in_the_batch_states(spark, log, tmp_path):
    half = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    parts = [log.filter(F.col("seq") <= half), log.filter(F.col("seq") > half).unionByName(log.filter(F.col("seq") % 5 == 0))]  # some events come again, in another batch
    parts[0].orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run(streams.job_changes(stream(spark, tmp_path / "log"), late="1000 days"), tmp_path)
    parts[1].coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run(streams.job_changes(stream(spark, tmp_path / "log"), late="1000 days"), tmp_path)
    forget_last_commit(tmp_path)
    run(streams.job_changes(stream(spark, tmp_path / "log"), late="1000 days"), tmp_path)
    jobs = streams.latest(streams.said(spark, str(tmp_path / "out"), streams.JOB), "book_id", "idx")
    names = ["book_id", "idx", "status", "errors", "started", "place"]
    got = queue.placed(jobs, queue.pauses(log)).select(*names)
    assert sorted(got.collect()) == sorted(queue.places(log).select(*names).collect())


def test_timers_tell_what_is_overdue(spark, tmp_path):
    budget = timedelta(seconds=queue.TRY_SECONDS * queue.TRIES)
    rows = [(1, T0, "b", 1, "start"), (2, T0, "b", 2, "start"), (3, T0 + budget / 2, "b", 2, "ready"), (4, T0 + timedelta(minutes=59), "b", 3, "start")]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run(streams.job_changes(stream(spark, tmp_path / "log")), tmp_path)
    state = lambda: {(r.book_id, r.idx): (r.status, r.overdue) for r in streams.latest(streams.said(spark, str(tmp_path / "out"), streams.JOB), "book_id", "idx").collect()}
    assert state() == {("b", 1): ("running", False), ("b", 2): ("ready", False), ("b", 3): ("running", False)}
    # an hour and a while later, by the events' own clock: the first job's time is over, the third's isn't
    spark.createDataFrame([(5, T0 + timedelta(hours=1) + budget + timedelta(seconds=1), "c", 1, "enqueue")], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run(streams.job_changes(stream(spark, tmp_path / "log")), tmp_path)
    assert state() == {("b", 1): ("running", True), ("b", 2): ("ready", False), ("b", 3): ("running", False), ("c", 1): ("pending", False)}


def test_the_feed_says_each_event_once(spark, log, tmp_path):
    books = log.filter("book_id IS NOT NULL").select("book_id", F.upper("book_id").alias("title")).distinct()
    log.repartitionByRange(3, "seq").write.parquet(str(tmp_path / "log"))
    feed = lambda: streams.events(stream(spark, tmp_path / "log"), books, 100)
    run(feed(), tmp_path)
    for _ in range(2):
        forget_last_commit(tmp_path)
        run(feed(), tmp_path)
    said = streams.said(spark, str(tmp_path / "out"), "seq long, book_id string, idx int, what string, title string, text string")
    want = queue.snapshot_then(log, 100).filter("seq > 100")
    assert sorted(map(str, said.select("seq", "book_id", "idx", "what").collect())) == sorted(map(str, want.select("seq", "book_id", "idx", "what").collect()))
    row = said.filter("book_id IS NOT NULL AND idx IS NOT NULL").first()
    assert row.text == f'data: {{"seq":{row.seq},"book_id":"{row.book_id}","idx":{row.idx},"what":"{row.what}","title":"{row.title}"}}\n\n'


def test_progress_counts_a_job_once(spark, tmp_path):
    rows = [(1, "ready", 1), (2, "error", 2), (3, "ready", 1), (4, "ready", 2)]
    for k, part in enumerate((rows[:3], rows[2:])):  # the third comes twice
        spark.createDataFrame([(s, T0, "b", i, c) for s, c, i in part], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        run(streams.progress(stream(spark, tmp_path / "log")), tmp_path)
        assert k < 2
    got = sorted((r.seq, r.command, r.ready) for r in streams.said(spark, str(tmp_path / "out"), streams.PROGRESS).collect())
    assert got == [(1, "ready", 1), (2, "error", 1), (3, "ready", 1), (4, "ready", 2)]


def test_a_part_of_the_log_is_as_many_files_as_its_rows_make(spark, monkeypatch):
    """No task holds a whole part; a part is still one batch, and the parts come in order."""
    from leafmill.plans import queue_stream

    seen, paths = [], []

    def each(log):
        seen.append(log)
        return log.select("seq", "book_id", "idx", F.col("command").alias("what"))

    real = queue_stream.folder
    monkeypatch.setattr(queue_stream, "folder", lambda s, name: paths.append(real(s, name)) or paths[-1])
    monkeypatch.setattr(queue_stream, "_log", lambda s, d: queue_log._log(s, d).repartition(3, "seq"))
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        monkeypatch.setattr(queue_stream, f"_{name}", before, raising=False)
    try:
        said = queue_stream.ended(each, spark, DATA, "seq long, book_id string, idx int, what string")
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.set(name, getattr(queue_stream, f"_{name}"))
    spans = [(r.low, r.high) for r in said.groupBy("batch").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("batch").collect()]
    assert len(spans) == len(seen) == queue_stream.PARTS and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 2 * queue_stream.PARTS


def test_recent_tasks_of_a_stream_are_those_of_the_sql_with_repeated_and_missing_ids(spark, tmp_path):
    import duckdb

    from leafmill.plans import registry

    rows = [(None if i % 90 == 7 else i, None if i % 4 == 3 else i % 3, ("purchase", "error", "view")[i % 5 % 3]) for i in range(20 * streams.RING_ROWS)]
    spark.createDataFrame(rows + rows[::6], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["tasks_recent_streamed"](spark, str(tmp_path)).collect()
    sql = duckdb.connect()
    sql.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sql.sql(f"select key, task_id, place, n_finished from ({registry.ORACLES['tasks_recent_streamed']})").fetchall()
    assert len(want) == 200 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
