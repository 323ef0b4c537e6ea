"""Markdown export of books, as rows in order: of any size, no book is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators import model_output

#: Texts of the export (fixed values).
NONE_YET, NOTES = "_摘要未生成_", "## 我的笔记"


def header(by: str, day: str) -> Column:
    """Title and information of a book, and the heading of its summaries."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    return F.concat(
        F.lit("# 《"), F.coalesce("title", F.lit("Untitled")), F.lit(f"》摘要版\n> 由 {by} 生成 · {day}\n\n## 元信息\n- 作者: "), known("author"),
        F.lit("\n- 格式: "), known("format"), F.lit("\n- 段数: "), F.col("segment_count"), F.lit("\n\n## 段摘要"),
    )


def segment_block(summary: Column) -> Column:
    """Heading, summary and translation of a segment, a line each; a summary that can't be read stands as it is."""
    number = (F.col("idx") + 1).cast("string")
    anchor = F.regexp_replace(F.coalesce(F.nullif(F.col("anchor_label"), F.lit("")), F.concat(F.lit("段 "), number)), "^[〔〕]+|[〔〕]+$", "")
    rendered = model_output.summary_lines(summary)
    told = F.when(F.coalesce(F.col("summary_json"), F.lit("")) == "", F.array(F.lit(NONE_YET))).when(summary["found"].isNull(), F.array("summary_json"))
    told = told.otherwise(F.when(F.size(rendered) > 0, rendered).otherwise(F.array(F.lit(NONE_YET))))
    other = F.when(F.coalesce(F.col("translation"), F.lit("")) != "", F.array(F.concat(F.lit("#### 译文 · 段 "), number), F.col("translation"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.concat(F.lit("### 段 "), number, F.lit(" · "), anchor)), told, F.array(F.lit("")), other), "\n")


def blocks(books: DataFrame, segments: DataFrame, by: str, day: str, notes: DataFrame | None = None) -> DataFrame:
    """book_id, part, idx, block, in order: a book's blocks joined by line breaks are its export.

    Part 0 is the header, 1 the segments of the export width, 2 the notes(book_id, note_id, content), if they are asked for.
    """
    zero = F.lit(0).cast("long")
    found = books.select("book_id", F.lit(0).alias("part"), zero.alias("idx"), header(by, day).alias("block"))
    read = segments.join(books.select("book_id"), "book_id", "left_semi").withColumn("s", model_output.summary(F.col("summary_json")))
    found = found.unionByName(read.select("book_id", F.lit(1).alias("part"), F.col("idx").cast("long").alias("idx"), segment_block(F.col("s")).alias("block")))
    if notes is not None:
        own = notes.join(books.select("book_id"), "book_id", "left_semi")
        heads = own.select("book_id").distinct().select("book_id", F.lit(2).alias("part"), (zero - 1).alias("idx"), F.lit(NOTES + "\n").alias("block"))
        lines = own.select("book_id", F.lit(2).alias("part"), F.col("note_id").cast("long").alias("idx"), F.concat(F.lit("- "), F.coalesce("content", F.lit(""))).alias("block"))
        found = found.unionByName(heads).unionByName(lines)
    return found.orderBy("book_id", "part", "idx")


def write(found: DataFrame, path: str) -> None:
    """blocks() as text files, in folders by book; the names of a book's files are in the order of its blocks."""
    ranged = found.repartitionByRange("book_id", "part", "idx").sortWithinPartitions("book_id", "part", "idx")
    ranged.select("book_id", F.col("block").alias("value")).write.partitionBy("book_id").text(path)
