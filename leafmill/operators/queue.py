"""The work queue as tables, derived from a log of commands and results.

A log has seq (its order), command, book_id and idx (null for commands to a book or to all).
Commands to a job: enqueue, start, ready, error, cancel, retry, regenerate. Commands to a book: pause,
resume; to all: pause_all, resume_all. Everything is an aggregate by job or by book: no job waits anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.library import state
from leafmill.operators.ordering import RUN, running_sum

#: Tries of a job until it has failed, and seconds of each (fixed values).
TRIES, TRY_SECONDS = 3, 180
JOB_COMMANDS = ("enqueue", "start", "ready", "error", "cancel", "retry", "regenerate")
#: Commands that begin a job anew: earlier errors don't count.
RESETS = ("retry", "regenerate", "ready")


def _last(*commands: str) -> Column:
    return F.max(F.when(F.col("command").isin(*commands), F.col("seq")))


def pauses(log: DataFrame) -> DataFrame:
    """book_id, paused of every book in the log, at its end.

    Pausing all clears the pauses of single books, and resuming one book ends the pause of all. What
    concerns all comes back as a single row.
    """
    all_ = log.agg(_last("pause_all").alias("all_off"), _last("resume_all", "resume").alias("all_on"), _last("pause_all", "resume_all").alias("cleared"))
    books = log.filter("book_id IS NOT NULL").groupBy("book_id").agg(_last("pause").alias("off"), _last("resume").alias("on"))
    never = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("long"))
    own, of_all = never("off") > F.greatest(never("on"), never("cleared")), never("all_off") > never("all_on")
    return books.crossJoin(F.broadcast(all_)).select("book_id", (own | of_all).alias("paused"))


def jobs(log: DataFrame, tries: int = TRIES) -> DataFrame:
    """book_id, idx, status, errors (since the job last began anew), started (its last start) of every job.

    pending jobs wait; an error sends a job back until its tries are used up.
    """
    own = log.filter(F.col("command").isin(*JOB_COMMANDS))
    reset = own.groupBy("book_id", "idx").agg(_last(*RESETS).alias("reset"), F.max_by("command", "seq").alias("last"), _last("start").alias("started"))
    errors = own.filter("command = 'error'").join(reset.select("book_id", "idx", "reset"), ["book_id", "idx"]).filter("reset IS NULL OR seq > reset").groupBy("book_id", "idx").agg(F.count(F.lit(1)).alias("errors"))
    n = F.coalesce("errors", F.lit(0).cast("long"))
    status = F.when(F.col("last") == "ready", "ready").when(F.col("last") == "start", "running").when(F.col("last") == "cancel", "cancelled").when((F.col("last") == "error") & (n >= tries), "failed").otherwise("pending")
    return reset.join(errors, ["book_id", "idx"], "left").select("book_id", "idx", status.alias("status"), n.alias("errors"), "started")


def places(log: DataFrame, tries: int = TRIES) -> DataFrame:
    """jobs() with place: queued, active, backlog of a paused book, or none."""
    return placed(jobs(log, tries), pauses(log))


def placed(found: DataFrame, paused_books: DataFrame) -> DataFrame:
    """Jobs with place. A job is in one place, however often it was enqueued; pausing sends a running one back to pending."""
    paused = F.coalesce("paused", F.lit(False))
    waits, runs = F.col("status") == "pending", F.col("status") == "running"
    place = F.when(paused & (waits | runs), "backlog").when(waits, "queued").when(runs, "active").otherwise("none")
    status = F.when(paused & runs, "pending").otherwise(F.col("status"))
    return found.join(paused_books, "book_id", "left").withColumn("place", place).withColumn("status", status).drop("paused")


def recovered(found: DataFrame) -> DataFrame:
    """places() after a restart: what ran is pending, and waits again."""
    runs = F.col("place") == "active"
    return found.withColumns({"status": F.when(runs, "pending").otherwise(F.col("status")), "place": F.when(runs, "queued").otherwise(F.col("place"))})


def active(found: DataFrame) -> DataFrame:
    """Of each book its running jobs: how many, the first and the last that started."""
    return found.filter("place = 'active'").groupBy("book_id").agg(F.count(F.lit(1)).alias("running"), F.min_by("idx", "started").alias("first_idx"), F.max_by("idx", "started").alias("last_idx"))


def book_states(found: DataFrame, progress: DataFrame, paused: DataFrame) -> DataFrame:
    """progress(book_id, total, ready) -> also state and queued jobs of each book."""
    counts = found.groupBy("book_id").agg(F.count_if(F.col("place") == "queued").alias("queued"), F.count_if(F.col("place") == "active").alias("running"))
    joined = progress.join(counts, "book_id", "left").join(paused, "book_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    derived = state(F.col("total"), F.col("ready"), zero("running") > 0, F.coalesce("paused", F.lit(False)), zero("queued") > 0)
    return joined.select("book_id", "total", "ready", F.when(F.col("total") <= 0, "summarized").otherwise(derived).alias("state"), zero("queued").alias("queued"))


def diagnostics(found: DataFrame, paused: DataFrame, workers: int) -> DataFrame:
    """One row: depth of the queue, running and suspended jobs, workers, paused books."""
    n = lambda place: F.count_if(F.col("place") == place)
    books = paused.agg(F.count_if("paused").alias("paused_books"))
    return found.agg(n("queued").alias("depth"), n("active").alias("running"), n("backlog").alias("backlog")).crossJoin(F.broadcast(books)).withColumn("workers", F.lit(workers))


def with_progress(log: DataFrame, totals: DataFrame) -> DataFrame:
    """Every result in the log with its book's progress at that moment: how many of its jobs have been ready so far.

    A job counts from its first ready on. totals(book_id, total); no task needs all results of a book.
    """
    done = log.filter(F.col("command").isin("ready", "error"))
    nth = F.row_number().over(Window.partitionBy("book_id", "idx", "command").orderBy("seq"))
    new = F.when((F.col("command") == "ready") & (F.col("nth") == 1), 1).otherwise(0)
    counted = running_sum(done.withColumn("nth", nth), "book_id", "seq", F.floor(F.col("seq") / RUN), new, "ready")
    return counted.join(totals, "book_id", "left").select("seq", "book_id", "idx", "command", "ready", "total")


def snapshot_then(log: DataFrame, at: int) -> DataFrame:
    """What a listener gets that joins after event at: the state of each job then, as of that event, and all later events."""
    before = jobs(log.filter(F.col("seq") <= at)).select(F.lit(at).cast("long").alias("seq"), "book_id", "idx", F.concat(F.lit("is "), "status").alias("what"))
    return before.unionByName(log.filter(F.col("seq") > at).select("seq", "book_id", "idx", F.col("command").alias("what")))


def batch(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """wanted(book_id) of a batch to start or stop: affected, or skipped since there is no such book."""
    known = books.select("book_id", F.lit(True).alias("affected")).distinct()
    return wanted.distinct().join(known, "book_id", "left").select("book_id", F.coalesce("affected", F.lit(False)).alias("affected"))


def retries(wanted: Column) -> Column:
    """The numbers of a batch of retries, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(wanted, lambda x: x >= 0)))


def retry_commands(wanted: DataFrame, seq: int) -> DataFrame:
    """wanted(book_id, ids) -> commands that resume each book and begin its jobs anew, after event seq."""
    jobs_ = wanted.select("book_id", F.explode(retries(F.col("ids"))).alias("idx")).select(F.lit(seq + 2).cast("long").alias("seq"), "book_id", "idx", F.lit("retry").alias("command"))
    return wanted.select(F.lit(seq + 1).cast("long").alias("seq"), "book_id", F.lit(None).cast("int").alias("idx"), F.lit("resume").alias("command")).unionByName(jobs_)


def regenerate_commands(segments: DataFrame, books: DataFrame, seq: int) -> DataFrame:
    """Commands that resume the books and begin all their segments anew, ready ones too."""
    jobs_ = segments.join(books.select("book_id"), "book_id", "left_semi").select(F.lit(seq + 2).cast("long").alias("seq"), "book_id", F.col("idx").cast("int").alias("idx"), F.lit("regenerate").alias("command"))
    return books.select(F.lit(seq + 1).cast("long").alias("seq"), "book_id", F.lit(None).cast("int").alias("idx"), F.lit("resume").alias("command")).unionByName(jobs_)


def budget_seconds(tries: Column) -> Column:
    """How long a job may take at most, over all its tries."""
    return F.greatest(tries, F.lit(1)) * TRY_SECONDS


def last_progress(events: DataFrame) -> DataFrame:
    """events(seq, book_id, percent) -> the last report of each book."""
    return events.groupBy("book_id").agg(F.max_by("percent", "seq").alias("percent"))


def translations_due(segments: DataFrame, needed: Column) -> DataFrame:
    """Segments whose summary is ready, that need a translation and have none."""
    return segments.filter((F.col("summary_status") == "ready") & needed & (F.coalesce(F.col("translation"), F.lit("")) == ""))


def partitions(tasks: DataFrame) -> DataFrame:
    """tasks(status) with the list that shows them: running, queued, paused, or recent."""
    live = F.col("status").isin("running", "queued", "paused")
    return tasks.withColumn("shown", F.when(live, F.col("status")).otherwise("recent"))


def selected(tasks: DataFrame, status: str | None = None, kind: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("kind", kind)):
        tasks = tasks.filter(F.col(column) == value) if value is not None else tasks
    return tasks
