"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document.

Null and blank texts have size 0 and are never copied. Null sources form one source, the last.
A row draws by its source, id and text, and by its number among rows that are equal in these, so that null
and repeated ids, and repeated rows, draw for themselves; reruns and retried tasks agree. An empty table gives an
empty result. Sources of size 0 have the target 0. Texts of any length are counted whole. Columns of docs are carried in a
struct, so that no name clashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, table, words_of

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target.

    Sources in code point order (null last) take the weights in turn and share the sum of all
    sizes; no target is above most times its source's size. Sources are sorted by the level
    at which they reach that; level is what each unit of weight gets once all sources before
    are full. The windows hold one row per source, an aggregate of the input.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    full = sizes.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("limit"))
    full = full.select("*", (F.col("limit") / F.col("weight")).alias("full_at"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, onward, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    levels = full.select("*", (left.cast("double") / F.sum("weight").over(onward)).alias("level"))
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    target = F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))
    return levels.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 12), 16, 10).cast("double") / float(16**12)


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source; one map-side combined aggregation."""
    sizes = docs.select("source", size_of(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    return materialize(targets(sizes, weights, most), "mix-plan")


def keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """doc (the columns, all by default), key (a hash of source, doc_id and text), nth (from 0, among rows with equal keys), blank.

    Only repeated rows are numbered: by partition, and in each from where the earlier ones end, so that no task
    needs all rows of a key. Which of the equal rows gets which number depends on the run, what they get together doesn't.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)))
    rows = docs.select(F.struct(*(columns or ("*",))).alias("doc"), key.alias("key"), (~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"))
    again = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeated-rows")
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    placed = rows.join(again, "key", "left_semi").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "repeated-rows")
    counts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("key", "part", (F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).alias("start"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.lit(0))) - 1
    numbered = placed.withColumn("place", place).join(starts, ["key", "part"]).withColumn("nth", (F.col("start") + F.col("place")).cast("long"))
    alone = rows.join(again, "key", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    return alone.unionByName(numbered.select(*alone.columns))


def with_copies(rows: DataFrame, mix: DataFrame, seed: str = SEED) -> DataFrame:
    """doc and mix as two structs, size, and the number of copies of each row of keyed(); none of a blank one.

    The plan is a written table of a known size: Spark broadcasts it if it is under the
    session's threshold and otherwise shuffles, and splits sources that are skewed.
    """
    m = mix.select(F.struct("*").alias("mix"))
    joined = rows.join(m, F.col("doc.source").eqNullSafe(F.col("mix.source")), "left")
    rate = F.coalesce(F.try_divide(F.col("mix.target"), F.col("mix.source_size").cast("double")), F.lit(0.0))
    drawn = draw(F.concat_ws(":", "key", F.col("nth").cast("string")), seed)
    copies = F.when(F.col("blank"), 0).otherwise(F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long"))
    return joined.select("doc", "mix", copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    taken = with_copies(keyed(docs), plan(docs, weights, most), seed)
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = keyed(docs, "doc_id", "source", size_of(F.col("text")).alias("size"))
    return with_copies(rows, plan(docs)).select(
        "doc.doc_id", "doc.size", "mix.source_size", "mix.target", (F.col("doc.size") * F.col("copies")).alias("taken")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS top,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s
), f AS (
  SELECT *, CAST(top AS DOUBLE) / weight AS full_at FROM w
), l AS (
  SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(top) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM f
), v AS (
  SELECT level FROM l WHERE level < full_at ORDER BY full_at, level LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(top AS DOUBLE), coalesce((SELECT level FROM v) * weight, CAST(top AS DOUBLE))) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || d.key || ':' || (row_number() OVER (PARTITION BY d.key) - 1)), 1, 12)) AS BIGINT) / 281474976710656.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""
