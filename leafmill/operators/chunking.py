"""Lossless cutting of long texts into segments at structure, paragraphs, lines and sentences."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.batches import pieces
from leafmill.functions.text import strip

SHORT = 12_000
#: Markers that ingest writes, chapter headings, and ends of sentences (fixed patterns).
MARKER = re.compile(r"^## \[(?:§(.+)|p\.(\d+)(?:\s+无文本)?)\]$", re.M)
CHAPTER = re.compile(r"^(?:第[零一二三四五六七八九十百千\d]+[章节篇回].*|§\s*.+)$", re.M)
SENTENCE = re.compile(r'[。！？；.!?][」』"\'\)\]】]*')


class Budget(NamedTuple):
    target: int = 4000
    most: int = 6000
    least: int = 2400


def budget_for(provider: str, target: int | None = None) -> Budget:
    """A provider's budget; with a target of its own, 1.2 and 0.6 times that."""
    base = {"local": 2500, "openrouter": 3500}.get(provider, 4000)
    t = target or base
    return Budget(t, int(t * 1.2), int(t * 0.6))


class Outline:
    """Where a text's structure begins."""

    def __init__(self, text: str):
        markers = [*MARKER.finditer(text)]
        self.titles = [(m.start(), "§" + m[1].strip()) for m in markers if m[1]]
        self.pages = [(m.start(), int(m[2])) for m in markers if m[2]]
        self.headers = [(m.start(), m[0].strip()) for m in CHAPTER.finditer(text)]
        self.starts = sorted({0, *(m.start() for m in markers), *(at for at, _ in self.headers)})

    def next_start(self, after: int, before: int) -> int | None:
        i = bisect_right(self.starts, after)
        return self.starts[i] if i < len(self.starts) and self.starts[i] < before else None

    def chapter(self, at: int) -> str | None:
        """The last marked title so far; only without any, the last header line."""
        for places in (self.titles, self.headers):
            if i := bisect_right(places, at, key=lambda p: p[0]):
                return places[i - 1][1] or None
        return None

    def page_range(self, start: int, end: int) -> str | None:
        i, j = (bisect_left(self.pages, x, key=lambda p: p[0]) for x in (start, end))
        if i == j:
            return None
        first, last = self.pages[i][1], self.pages[j - 1][1]
        return f"p.{first}" if j - i == 1 else f"p.{first}-{last}"


def cut_at(text: str, outline: Outline, start: int, end: int, b: Budget) -> int:
    """The end of a segment that begins at start: the next structure within the most, else the
    last paragraph, line or sentence that ends up to the target, else the most."""
    window = min(start + b.most, end)
    if (at := outline.next_start(start, window)) is not None:
        return at
    low, high = start + max(b.least // 2, 1), min(start + b.target, end)
    for mark in ("\n\n", "\n"):
        if (i := text.rfind(mark, start, high)) >= 0 and i + len(mark) >= low:
            return i + len(mark)
    last = None
    for m in SENTENCE.finditer(text, start, high):
        last = m.end()
    return last if last is not None and last >= low else window


def spans(text: str, b: Budget = Budget()) -> list[tuple[int, int]]:
    """Ends of the segments of a stripped text: no gap, no overlap."""
    if len(text) <= SHORT:
        return [(0, len(text))] if text else []
    outline = Outline(text)

    def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
        while end - start > b.most:
            at = cut_at(text, outline, start, end, b)
            yield start, at
            start = at
        yield start, end

    def thinned(cuts: list[int]) -> list[int]:
        """cuts without those behind a small piece in which nothing begins, if the two pieces together aren't too long; of two such cuts in a row the first goes."""
        kept = cuts[:1]
        for left, cut, right in zip(cuts, cuts[1:], cuts[2:], strict=False):
            small = cut - left < b.least and right - left <= b.most and outline.next_start(left, cut) is None
            if not small or kept[-1] != left:
                kept.append(cut)
        return kept + cuts[-1:]

    cuts = [0, *(e for _, e in pieces(0, len(text)))]
    while (fewer := thinned(cuts)) != cuts:
        cuts = fewer
    return [x for s, e in zip(cuts, cuts[1:], strict=False) for x in pieces(s, e)]


SEGMENT = "idx int, raw_text string, start_offset int, end_offset int, chapter string, page_range string"


def chunk(docs: DataFrame, key: str, text: str, b: Budget = Budget()) -> DataFrame:
    """A row per segment of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(f.split()[0] for f in SEGMENT.split(", "))]
        for batch in (p for b in batches for p in pieces(b)):
            rows = []
            for k, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                value = (value or "").strip()
                outline = Outline(value)
                rows += [(k, i, value[s:e], s, e, outline.chapter(s), outline.page_range(s, e)) for i, (s, e) in enumerate(spans(value, b))]
            types = [batch.schema.field(key).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return docs.select(key, text).mapInArrow(cut, f"{key} {dict(docs.dtypes)[key]}, {SEGMENT}")


def anchor(chapter: Column, idx: Column, pages: Column) -> Column:
    return F.concat(F.lit("〔"), F.concat_ws(" · ", chapter, F.concat(F.lit("段 "), idx + 1), pages), F.lit("〕"))


def coverage(segments: DataFrame, key: str, texts: DataFrame, text: str) -> DataFrame:
    """Per text of texts(key, text): segments, characters, the largest, and whether they are the text, each beginning where the one before ends.

    A text's segments come together in one row, as long as the text itself.
    """
    parts = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "raw_text"))).alias("s"))
    ends = F.concat(F.array(F.lit(0)), F.slice(F.transform("s", lambda x: x["end_offset"]), F.lit(1), F.size("s") - 1))
    joined = F.array_join(F.transform("s", lambda x: x["raw_text"]), "")
    sizes = F.transform("s", lambda x: F.length(x["raw_text"]))
    lossless = (F.transform("s", lambda x: x["start_offset"]) == ends) & (F.transform("s", lambda x: x["end_offset"] - x["start_offset"]) == sizes) & (joined == strip(F.col(text)))
    return parts.join(texts, key).select(key, F.size("s").cast("long").alias("n_segments"), F.length(joined).cast("long").alias("chars"), F.array_max(sizes).alias("largest"), lossless.alias("lossless"))


def report(segments: DataFrame, key: str) -> DataFrame:
    """The first two segments of each text, for a reviewer: characters, chapter, offsets, the start, and whether the second overlaps the first."""
    ends = segments.filter("idx = 0").select(key, F.col("end_offset").alias("first_end"))
    shown = segments.filter("idx < 2").join(ends, key)
    overlap = F.when(F.col("idx") == 1, F.col("first_end") > F.col("start_offset")).otherwise(F.lit(False))
    return shown.select(key, "idx", F.length("raw_text").alias("chars"), F.coalesce("chapter", F.lit("—")).alias("chapter"), "start_offset", "end_offset", F.translate(F.substring("raw_text", 1, 200), "\n", " ").alias("preview"), overlap.alias("overlap"))
