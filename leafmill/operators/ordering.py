"""Places in an order, for groups of any size: no task needs a whole group, and no cut points come to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.shared import stored


#: Keys, where they are whole numbers given in turn, that one task places.
RUN = 50_000


def _placed(runs: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """runs(group, order, run_) with column: places within runs, and where each run starts by the sums of the earlier ones."""
    counts = runs.groupBy(*group, "run_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*group).orderBy("run_")) - F.col("n_")
    starts = counts.select(*[F.col(g).alias(f"{g}_of") for g in group], F.col("run_").alias("at_"), before.alias("start_"))
    here = F.row_number().over(Window.partitionBy(*group, "run_").orderBy(*order)) - 1
    same = F.col("run_") == F.col("at_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of"))
    placed = runs.withColumn("here_", here).join(starts, same)
    return placed.withColumn(column, F.col("start_") + F.col("here_")).drop("run_", "here_", "at_", "start_", *[f"{g}_of" for g in group])


def running_sum(rows: DataFrame, group: str, key: str, run: Column, value: Column, column: str) -> DataFrame:
    """rows with the sum of value over the rows of their group up to their key; run as in by_runs, key unique within a group."""
    valued = rows.withColumn("run_", F.coalesce(run, F.lit(-1 << 62))).withColumn("value_", value)
    sums = valued.groupBy(group, "run_").agg(F.sum("value_").alias("sum_"))
    before = F.coalesce(F.sum("sum_").over(Window.partitionBy(group).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(group).alias("of_"), F.col("run_").alias("at_"), before.alias("start_"))
    here = F.sum("value_").over(Window.partitionBy(group, "run_").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    placed = valued.withColumn("here_", here).join(starts, F.col(group).eqNullSafe(F.col("of_")) & (F.col("run_") == F.col("at_")))
    return placed.withColumn(column, F.col("start_") + F.col("here_")).drop("run_", "value_", "here_", "of_", "at_", "start_")


def by_runs(rows: DataFrame, group: str, key: str, run: Column, column: str = "idx") -> DataFrame:
    """rows with their places, from 0 by key, nulls first, within their group. run must not fall while the key rises; a run of a group is numbered in one task.

    For keys that lie dense, such as numbers given in turn. Nothing is computed before the result is asked for.
    """
    return _placed(rows.withColumn("run_", F.coalesce(run, F.lit(-1 << 62))), [group], [key], column)


def by_ranges(rows: DataFrame, group: list[str], key: list[str], column: str = "idx") -> DataFrame:
    """rows with their places, from 0 by key within their group; group and key together are a row's identity.

    The keys alone are dealt out by ranges and stored, so that counts and places are of the same
    ranges; a large group lies in many of them. The places are then joined to the rows.
    """
    keys = rows.select(*group, *key).repartitionByRange(*group, *key).withColumn("run_", F.spark_partition_id())
    placed = _placed(stored(keys, "ranges"), group, key, column)
    names = [*group, *key]
    placed = placed.select(*[F.col(c).alias(f"{c}_is") for c in names], column)
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_is"))
    return rows.join(placed, same).drop(*[f"{c}_is" for c in names])
