"""Markdown documents as rows of lines: sections, citations, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip

#: What is a heading, what cites a place, and what is said of a point without one (fixed values).
HEADING = r"^#{1,6}\s+.+$"
CITATION = r"(?i)〔[^〕]+〕|\[p\.\d+\]|〔?§[^\s，,;；|〕\]]+|Sheet\s*[:：]?\s*\S+|p\.\d+"
UNLOCATED = " 〔未定位到页/节〕"
#: Headings and lines of a card made without a model (fixed values).
LEAD, POINTS, WHOLE, NO_LEAD = "## 总结（最多三句话）", "## 结构化要点", "(全文)", ("文档 ", " 的要点如下。")
ASKS = ["", "## 你可以接着问", "1. 哪一节最值得展开？", "2. 有哪些需要注意的限制？"]


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per line: pos and line."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per heading, with its text; what is before the first heading goes, unless there is none."""
    lines = lines_of(docs, key, text).withColumn("is_heading", F.trim("line").rlike(HEADING))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(so_far)).withColumn("any", F.max("is_heading").over(Window.partitionBy(key)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    grouped = numbered.filter("section > 0 OR NOT any").groupBy(key, "section").agg(F.min_by("line", "pos").alias("first"), F.first("any").alias("any"), body.alias("text"))
    return grouped.select(key, "section", F.when(F.col("any"), F.rtrim("first")).otherwise(WHOLE).alias("heading"), "text")


def under(lines: DataFrame, key: str, heading: str) -> Column:
    """Whether a line is inside a section whose heading begins so, with or without a space; any other heading with one ends it."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(heading), True).when(F.col("line").startswith("## "), False)
    last = F.last(mark, ignorenulls=True).over(so_far)
    return F.coalesce(last, F.lit(False))


def cited(lines: DataFrame, key: str) -> DataFrame:
    """lines with a note on every point that cites nothing."""
    bare = F.col("in_points") & F.col("line").rlike(r"^\s*[-*•]\s+") & ~F.col("line").rlike(CITATION)
    marked = lines.withColumn("in_points", under(lines, key, r"^##\s*结构化要点"))
    return marked.select(key, "pos", F.when(bare, F.concat(F.rtrim("line"), F.lit(UNLOCATED))).otherwise(F.col("line")).alias("line"), bare.alias("fixed"))


def without_asks(lines: DataFrame, key: str) -> DataFrame:
    """lines without the section of follow-up questions."""
    return lines.withColumn("ask", under(lines, key, r"^##\s*你可以接着问")).filter("NOT ask").drop("ask")


def joined(lines: DataFrame, key: str) -> DataFrame:
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def cite_of(heading: Column) -> Column:
    title = F.coalesce(F.nullif(strip(F.regexp_replace(heading, r"^[#\s]+", "")), F.lit("")), F.lit("全文"))
    inner = F.when(title.rlike(r"^\[.*\]$"), F.substring(title, F.lit(2), F.length(title))).otherwise(title)
    inner = F.when(title.rlike(r"^\[.*\]$"), F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
    return F.when(inner.rlike(r"^(?:§|p\.)"), inner).otherwise(F.concat(F.lit("§"), inner))


def without_markers(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^#{1,6}\s*", ""), r"\[§[^\]]+\]|\[p\.\d+\]", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def annotated(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each document with its sections under the places that answers cite."""
    title = F.coalesce(F.nullif(F.trim(F.regexp_replace("heading", "^[# ]+", "")), F.lit("")), F.lit("全文"))
    whole = strip(F.col("text"))
    body = F.when(whole.startswith(F.col("heading")), strip(F.regexp_replace(whole, r"^[^\n]*\n?", ""))).otherwise(whole)
    parts = sections(docs, key, text).select(key, "section", F.concat(F.lit("[§"), title, F.lit("]")).alias("mark"), body.alias("body"))
    block = F.concat("mark", F.when(F.col("body") != "", F.concat(F.lit("\n"), F.col("body"))).otherwise(""))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("annotated"))


def clipped(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def heuristic_summary(docs: DataFrame, key: str, text: str, filename: Column | str = "article") -> DataFrame:
    """A summary card without a model: the first sentence, or a line with the file's name, and a point for each of the first six sections."""
    lead = F.filter(F.split(without_markers(F.col(text)), r"(?<=[。！？.!?])\s+"), lambda s: F.length(F.trim(s)) > 8)
    name = F.lit(filename) if isinstance(filename, str) else filename
    one = F.coalesce(F.get(lead, F.lit(0)), F.concat(F.lit(NO_LEAD[0]), name, F.lit(NO_LEAD[1])))
    one = F.when(F.length(one) > 160, F.concat(F.substring(one, 1, 159), F.lit("…"))).otherwise(one)
    parts = sections(docs, key, text).select(key, "section", cite_of(F.col("heading")).alias("cite"), without_markers(F.col("text")).alias("body"))
    label = strip(F.regexp_replace("cite", r"^§*[p.]*", ""))
    rest = F.when(F.col("body").startswith(label), F.regexp_replace(F.substring("body", F.length(label) + 1, F.lit(1 << 30)), "^[ ：:>-]+", "")).otherwise(F.col("body"))
    shown = F.coalesce(F.nullif(label, F.lit("")), F.col("cite"))
    points = parts.select(key, "section", "cite", shown.alias("label"), F.trim(rest).alias("body")).filter("body <> ''")
    point = F.concat(F.lit("- **"), F.col("label"), F.lit("**："), clipped(F.col("body"), 120), F.lit(" — 依据：原文 〔"), F.col("cite"), F.lit("〕"))
    per_doc = points.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("section", point.alias("p")))), 1, 6).alias("ps"))
    made = docs.select(key, one.alias("lead")).join(per_doc, key, "left")
    fallback = F.array(F.concat(F.lit("- **全文**："), F.col("lead"), F.lit(" — 依据：原文 〔§全文〕")))
    ps = F.coalesce(F.transform("ps", lambda x: x["p"]), fallback)
    return made.select(key, F.array_join(F.concat(F.array(F.lit(LEAD), F.col("lead"), F.lit(""), F.lit(POINTS)), ps, F.array(*[F.lit(x) for x in ASKS])), "\n").alias("markdown"))


#: Characters up to which a document is summarised in one; segments, bullets of each and of all that a longer one shows; and its own lines (fixed values).
SHORT_CHARS, SEGMENTS, PER_SEGMENT, POINTS_MOST = 12_000, 6, 3, 8
SEGMENT_LEAD, SEGMENT_ASKS = "本文按段落摘要如下。", ["", "## 你可以接着问", "1. 哪一段最值得展开？", "2. 有哪些需要注意的限制？"]


def segment_cards(segments: DataFrame, key: str) -> DataFrame:
    """A card per text from its first segments(idx, label, said: sentences, points): the lead of each, and its points with the place they are from."""
    point = lambda label: lambda x: F.concat(F.lit("- **"), label, F.lit("**："), x, F.lit(" — 依据：原文 〔§"), label, F.lit("〕"))
    first = segments.filter(F.col("idx") < SEGMENTS)
    part = F.struct("idx", F.slice("said", 1, 1).alias("said"), F.transform(F.slice("points", 1, PER_SEGMENT), point(F.col("label"))).alias("points"))
    parts = first.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))  # six at most
    lead = F.coalesce(F.nullif(F.array_join(F.slice(F.flatten(F.transform("parts", lambda x: x["said"])), 1, 3), " "), F.lit("")), F.lit(SEGMENT_LEAD))
    points = F.slice(F.flatten(F.transform("parts", lambda x: x["points"])), 1, POINTS_MOST)
    points = F.when(F.size(points) > 0, points).otherwise(F.array(F.concat(F.lit("- **全文**："), lead, F.lit(" — 依据：原文 〔§全文〕"))))
    return parts.select(key, F.array_join(F.concat(F.array(F.lit(LEAD), lead, F.lit(""), F.lit(POINTS)), points, F.array(*map(F.lit, SEGMENT_ASKS))), "\n").alias("markdown"))


def document_summaries(docs: DataFrame, key: str, text: str, segments: DataFrame) -> DataFrame:
    """Every text's card without a model, and whether it is made by segments(key, idx, raw_text, chapter), as of the long ones; texts without words have none."""
    noted = docs.join(annotated(docs, key, text), key).filter(strip(F.col(text)) != "")
    is_long = F.length("annotated") > SHORT_CHARS
    short = heuristic_summary(noted.filter(~is_long).select(key, "annotated"), key, "annotated").select(key, "markdown", F.lit(False).alias("by_segments"))
    said = F.array(F.substring(without_markers(F.col("raw_text")), 1, 120))
    label = F.coalesce("chapter", F.concat(F.lit("段 "), F.col("idx") + 1))
    of_long = segments.join(noted.filter(is_long).select(key), key, "left_semi").select(key, "idx", label.alias("label"), said.alias("said"), said.alias("points"))
    return short.unionByName(segment_cards(of_long, key).select(key, "markdown", F.lit(True).alias("by_segments")))
