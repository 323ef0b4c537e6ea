"""Jobs and resources, derived from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "paused", "completed", "failed", "cancelled")


def final_state(events: DataFrame, key: list[str], at: str = "ts", status: str = "status") -> DataFrame:
    """The last status of each job; of events at the same time the one with the largest id."""
    return events.groupBy(*key).agg(F.max_by(status, F.struct(at, "event_id")).alias("status"), F.max(at).alias("at"), F.count(F.lit(1)).alias("n_events"))


def after_retries(errors: Column, limit: int = 2) -> Column:
    """An error is tried again up to the limit, then final."""
    return F.when(errors >= limit, "failed").when(errors > 0, "pending").otherwise("ready")


def status_counts(tasks: DataFrame) -> DataFrame:
    """A row for every known status, zeros too."""
    known = tasks.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def snapshot(tasks: DataFrame, limit: int = 100) -> DataFrame:
    """Tasks by status, running first, then by start."""
    rank = F.lit(len(STATUSES))
    for i, s in enumerate(("running", "queued", "paused")):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    return tasks.withColumn("status_rank", rank).orderBy("status_rank", "started_at", "task_id").limit(limit)


def priority(kind: Column, idx: Column, urgent: Column) -> Column:
    """0 for urgent jobs, then summaries in order, then translations."""
    return F.when(urgent, 0).when(kind == "translate", 1000 + idx).otherwise(idx + 1)


def deduplicated(jobs: DataFrame, key: list[str]) -> DataFrame:
    """The first job of each key, in order of priority."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy("priority", "seq"))
    return jobs.withColumn("nth", first).filter("nth = 1").drop("nth")


#: Seconds of a bucket of time.
BUCKET = 6 * 3600


def peak_concurrency(spans: DataFrame, resource: str, bucket: int = BUCKET) -> DataFrame:
    """spans(resource, started, ended) -> the most that ran at once; an end frees its slot before a start at the same time.

    Sums run in two steps, over buckets of time and within each, so that a busy resource is no single task.
    """
    steps = spans.select(resource, F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("d")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    net = steps.groupBy(resource, F.floor(F.col("s.at") / bucket).alias("bucket"), F.col("s.at").alias("at"), F.col("s.d").alias("d")).agg(F.sum("s.d").alias("step"))
    earlier = Window.partitionBy(resource).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = net.groupBy(resource, "bucket").agg(F.sum("step").alias("sum")).select(resource, "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    running = F.sum("step").over(Window.partitionBy(resource, "bucket").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    held = net.withColumn("running", running).groupBy(resource, "bucket").agg(F.max("running").alias("most"))
    return held.join(before, [resource, "bucket"]).groupBy(resource).agg(F.max(F.col("most") + F.col("before")).alias("peak"))


def slots(limits: DataFrame, running: DataFrame) -> DataFrame:
    """limits(resource, slots) ⟗ running(resource, in_use): what is free; unknown resources have no slots."""
    zero = F.lit(0).cast("long")
    joined = limits.join(running, "resource", "full_outer")
    n, used = F.coalesce("slots", zero), F.coalesce("in_use", zero)
    return joined.select("resource", n.alias("slots"), used.alias("in_use"), F.greatest(zero, n - used).alias("available"))


def chain(order: DataFrame, resources: DataFrame) -> DataFrame:
    """order(profile, ids) -> the known resources of each profile, in the order of its chain."""
    ids = order.select("profile", F.posexplode("ids").alias("pos", "resource"))
    return ids.join(resources, "resource").select("profile", "pos", "resource", *[c for c in resources.columns if c != "resource"])


def tier_for(machines: DataFrame, tiers: DataFrame) -> DataFrame:
    """machines(machine, ram) -> the model of the highest tier(min_ram, model) that fits: an as-of lookup.

    Tiers and machines stand in one order by memory, and each machine takes the last tier so far; runs of memory sizes
    are looked up apart, since there are few of them: one row per distinct size goes through the window.
    """
    sizes = machines.select("ram").distinct().select(F.col("ram").alias("at"), F.lit(None).cast("long").alias("tier")).unionByName(tiers.select(F.col("min_ram").alias("at"), F.col("min_ram").cast("long").alias("tier")))
    so_far = Window.orderBy("at", F.col("tier").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    best = sizes.withColumn("min_ram", F.last("tier", ignorenulls=True).over(so_far)).filter("tier IS NULL").select(F.col("at").alias("ram"), "min_ram")
    return machines.join(best, "ram", "left").join(tiers, "min_ram", "left").select("machine", "ram", "model")
