"""Library-shaped views over the given tables, and the same views as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.library import CATEGORIES
from leafmill.operators.ordering import by_runs

STATUSES = ("unread", "reading", "summarized", "processing", "error")
#: Numbers of documents that are placed in one task.
RUN_ROWS = 50_000


def summary_parts(d, seventh):
    """The pieces of a segment's summary as JSON, texts and numbers in turn: two sentences, three bullets, a note, two questions."""
    return ['{"sentences": ["Sentence ', d, '。", " Second  "], "bullets": [{"label": "甲", "body": "body of ', d, '"}, "乙：second", {"tag": "丙", "text": "third"}], "notes": ["note ', seventh, '"], "follow_ups": ["why?", "how?"], "label": "L", "anchor": "A"}']


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day(n, modulus: int):
    return F.concat(F.lit("2024-01-"), F.lpad((n % modulus + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per document source."""
    n = F.col("n")
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("segment_count"))
    numbered = counted.withColumn("n", F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    return numbered.select(
        F.col("source").alias("book_id"),
        F.concat(F.when(n % 2 == 0, "book ").otherwise("Book "), F.col("source")).alias("title"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), n % 5 + 1).alias("status"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), n % 7 + 1).alias("category"),
        (n % 3 == 0).alias("is_favorite"),
        F.when(n % 4 != 0, _day(n, 28)).alias("last_opened_at"),
        _day(n * 3, 25).alias("created_at"),
        _day(n * 7, 27).alias("updated_at"),
        "segment_count",
        F.when(n % 3 != 1, F.concat(F.lit("Author "), F.col("source"))).alias("author"),
        F.when(n % 2 == 0, "txt").otherwise("epub").alias("format"),
        F.when(n % 4 == 1, "{broken").when(n % 4 != 2, F.concat(F.lit('{"total_char_count": '), n * 100, F.lit(', "chunker_version": "v'), n % 3, F.lit('"}'))).alias("metadata_json"),
    )


def _texts() -> dict[str, Column]:
    """What a segment has of its document alone."""
    d = F.col("doc_id")
    made = {
        "label": F.when(d % 3 != 0, F.concat(F.lit("L"), d)).otherwise(F.lit("")),
        "raw_text": F.col("text"),
        "summary_json": F.when(d % 6 == 5, "no summary").when(d % 6 != 4, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in summary_parts(d, d % 7)])),
        "translation": F.when(d % 5 == 0, F.concat(F.lit("T: "), "text")),
    }
    return {k: c.alias(k) for k, c in made.items()}


def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all segments, with their ids and books, which may be null: a scan, in which nothing is dealt out."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), F.col("source").alias("book_id"), *_texts().values())


def segments(spark: SparkSession, sf_dir: str, books: DataFrame | None = None) -> DataFrame:
    """A segment per document, in doc_id order within its book; its status from the labels. With books, those in them alone, and book_title.

    All that is joined is joined to the keys; the texts are dealt out once. Rows with equal ids are told apart by number.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    d, of, own = F.col("doc_id"), F.struct("doc_id"), _texts()  # never null, so that null ids meet
    keys = by_runs(docs.select("doc_id", "source"), "source", "doc_id", F.floor(d / RUN_ROWS)).withColumn("of_", of)
    keys = keys.withColumn("copy_", F.row_number().over(Window.partitionBy("of_").orderBy("source", "idx")))
    keys = keys.join(labels, "doc_id", "left")
    if books is not None:
        keys = keys.join(books.select(F.col("book_id").alias("source"), F.coalesce("title", F.lit("")).alias("book_title")), "source")
    keys = keys.select(F.col("of_").alias("of_key_"), F.col("copy_").alias("copy_key_"), "quality", F.col("idx").cast("int").alias("idx"), *(["book_title"] if books is not None else []))
    texts = docs.withColumn("of_", of).withColumn("copy_", F.row_number().over(Window.partitionBy("of_").orderBy("source")))
    placed = texts.join(keys, (F.col("of_") == F.col("of_key_")) & (F.col("copy_") >= F.col("copy_key_")) & (F.col("copy_") <= F.col("copy_key_")))  # two inequalities: no key of the exchange
    return placed.select(
        d.alias("segment_id"),
        F.col("source").alias("book_id"),
        "idx",
        own["label"],
        F.when(d % 2 != 0, F.concat(F.lit("A"), d)).alias("anchor_label"),
        own["raw_text"],
        F.col("n_chars").alias("char_count"),
        F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("pending").alias("summary_status"),
        (d % 4).cast("int").alias("retry_count"),
        own["summary_json"],
        own["translation"],
        *(["book_title"] if books is not None else []),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per user turn, on the segment with the conversation's number."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    quote = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("quote "), F.col("conv_id")))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("conv_id").alias("segment_id"), F.col("text").alias("content"), F.col("turn").alias("created_at"), quote.alias("quote"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article per page; its identity is the start of its address's hash."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.substring(F.sha2("url", 256), 1, 16).alias("article_id"),
        p.alias("page_id"),
        "url",
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("source_id"),
        F.concat(F.lit("Article "), p).alias("title"),
        F.when(p % 5 != 0, F.concat(F.lit("2024-03-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit("T06:30:00Z"))).alias("published_at"),
        F.concat(F.lit("2024-03-"), F.lpad((p * 7 % 29 + 1).cast("string"), 2, "0"), F.lit("T12:00:00Z")).alias("synced_at"),
        F.when(p % 3 != 0, (p * 13 % 101).cast("double")).alias("score_hint"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news source per host; a third have no title."""
    hosts = articles(spark, sf_dir).select("source_id").distinct()
    return hosts.select("source_id", F.when(F.length("source_id") % 3 != 0, F.upper("source_id")).alias("title"), F.concat(F.lit("https://"), F.col("source_id")).alias("url"))


SUMMARY_SQL = " || ".join(x if k % 2 else f"'{x}'" for k, x in enumerate(summary_parts("d.doc_id", "d.doc_id % 7")))

SQL = f"""
WITH books AS (
  SELECT source AS book_id, (CASE WHEN n % 2 = 0 THEN 'book ' ELSE 'Book ' END) || source AS title,
    [{", ".join(f"'{s}'" for s in STATUSES)}][n % 5 + 1] AS status,
    [{", ".join(f"'{c}'" for c in CATEGORIES)}][n % 7 + 1] AS category, n % 3 = 0 AS is_favorite,
    CASE WHEN n % 4 <> 0 THEN '2024-01-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS last_opened_at,
    '2024-01-' || lpad(CAST(n * 3 % 25 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS created_at,
    '2024-01-' || lpad(CAST(n * 7 % 27 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS updated_at, segment_count,
    CASE WHEN n % 3 <> 1 THEN 'Author ' || source END AS author, CASE WHEN n % 2 = 0 THEN 'txt' ELSE 'epub' END AS format,
    CASE WHEN n % 4 = 1 THEN '{{broken' WHEN n % 4 <> 2 THEN '{{"total_char_count": ' || n * 100 || ', "chunker_version": "v' || n % 3 || '"}}' END AS metadata_json
  FROM (SELECT source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS n, count(*) AS segment_count FROM documents GROUP BY source)
), segments AS (
  SELECT d.doc_id AS segment_id, d.source AS book_id,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INTEGER) AS idx,
    CASE WHEN d.doc_id % 3 <> 0 THEN 'L' || d.doc_id ELSE '' END AS label,
    CASE WHEN d.doc_id % 2 <> 0 THEN 'A' || d.doc_id END AS anchor_label, d.text AS raw_text, d.n_chars AS char_count,
    CASE WHEN l.quality = 1 THEN 'ready' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS summary_status, CAST(d.doc_id % 4 AS INTEGER) AS retry_count,
    CASE WHEN d.doc_id % 6 = 5 THEN 'no summary' WHEN d.doc_id % 6 <> 4 THEN {SUMMARY_SQL} END AS summary_json, CASE WHEN d.doc_id % 5 = 0 THEN 'T: ' || d.text END AS translation
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), notes AS (
  SELECT conv_id * 1000 + turn AS note_id, conv_id AS segment_id, text AS content, turn AS created_at, CASE WHEN turn % 3 <> 0 THEN 'quote ' || conv_id END AS quote FROM conversations WHERE role = 'user'
), articles AS (
  SELECT substr(sha256(url), 1, 16) AS article_id, page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS source_id,
    'Article ' || page_id AS title,
    CASE WHEN page_id % 5 <> 0 THEN '2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T06:30:00Z' END AS published_at,
    '2024-03-' || lpad(CAST(page_id * 7 % 29 + 1 AS VARCHAR), 2, '0') || 'T12:00:00Z' AS synced_at,
    CASE WHEN page_id % 3 <> 0 THEN CAST(page_id * 13 % 101 AS DOUBLE) END AS score_hint
  FROM pages
), sources AS (
  SELECT source_id, CASE WHEN length(source_id) % 3 <> 0 THEN upper(source_id) END AS title, 'https://' || source_id AS url
  FROM (SELECT DISTINCT source_id FROM articles)
)
"""
