"""Files to annotated text: plain text, EPUB and page-wise documents, and feeds."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.batches import pieces

FORMATS = {"txt": "txt", "md": "txt", "pdf": "pdf", "epub": "epub", "mobi": "mobi"}
MOST_BYTES, OCR_BELOW = 500 << 20, 0.15
ENCODINGS = ("utf-8", "gb18030", "latin-1")


def format_of(path: Column) -> Column:
    """The format by the file's extension; null if it isn't known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext)


def files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, format, file_hash, content and error of files; those too large or of no known format have an error and no content."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most_bytes)


def described(raw: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """raw(path, length, content), as Spark reads files whole -> the columns of files()."""
    error = F.when(F.col("length") > most_bytes, "too large").when(format_of(F.col("path")).isNull(), "unknown format")
    return raw.select("path", format_of(F.col("path")).alias("format"), F.sha2("content", 256).alias("file_hash"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def decoded(content: bytes) -> str:
    """The first encoding that fits; the last fits always."""
    for e in ENCODINGS:
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            pass
    raise AssertionError


class _Text(HTMLParser):
    """Collects the text of a page: tags part words, and some end a line or a paragraph."""

    BREAKS = {"p": "\n\n"}
    HEADINGS = {f"h{n}": "\n\n" for n in range(1, 7)}

    def __init__(self, ends: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.ends, self.parts, self.hidden = ends, [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in ("script", "style")
        self.parts.append("\n" if tag == "br" else " ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.parts.append("\n" if tag == "br" else " ")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        self.parts.append(self.ends.get(tag, " "))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def plain(page: str, headings: bool = True) -> str:
    """Text of an HTML chapter."""
    reader = _Text(_Text.BREAKS | (_Text.HEADINGS if headings else {}))
    reader.feed(page)
    reader.close()
    lines = [x.rstrip(" \t") for x in "".join(reader.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def is_navigation(item) -> bool:
    """Whether a package's item is its table of contents."""
    name = (item.get("href") or "").lower()
    return (item.get("id") or "").lower() == "nav" or name.endswith(("nav.xhtml", "toc.xhtml")) or "nav" in (item.get("properties") or "").split()


def chapter_title(page: str, name: str) -> str:
    """The page's own title, else its file's name."""
    found = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
    return (plain(found[1]) if found else "") or posixpath.splitext(posixpath.basename(name))[0].replace("_", " ")


def epub_text(content: bytes) -> str:
    """Chapters in reading order, each under a marker with its title; navigation and empty ones left out."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e for e in package.iter() if e.tag.endswith("}item")}
        order = list(dict.fromkeys(e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")))
        pages = [i for i in items if "html" in (items[i].get("media-type") or "")]
        parts = []
        for ids in (order, pages):
            for i in ids:
                if i not in items or is_navigation(items[i]):
                    continue
                page = z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[i].get("href")))).decode("utf-8", "replace")
                body = plain(re.sub(r"(?is)<head\b.*?</head>", "", page))
                if body:
                    parts.append(f"## [§{chapter_title(page, items[i].get('href'))}]\n{body}")
            if parts:
                break
    return "\n\n".join(parts)


def paged(pages: list[str | None]) -> str:
    """Pages under markers with their numbers; an empty or failed one says so."""
    return "\n\n".join(f"## [p.{n}]\n{t.strip()}" if t and t.strip() else f"## [p.{n} 无文本]" for n, t in enumerate(pages, 1))


TEXT = "path string, text string, pages int, pages_with_text int, pages_empty array<int>, pages_failed array<int>, coverage double, error string"


def texts(found: DataFrame, pages_of: dict[str, Callable[[bytes], list[str | None]]] | None = None) -> DataFrame:
    """found(path, format, content, error) -> path, text, pages, pages_with_text, pages_empty, pages_failed, coverage, error.

    pages_of gives extractors of page texts for formats that need a library of their own (pdf, mobi); a page that
    can't be read is None. A file that can't be read has its error and no text; others aren't affected.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in pieces(batch)):
            rows = []
            for path, kind, content, error in zip(*(b.column(c).to_pylist() for c in ("path", "format", "content", "error")), strict=True):
                text = n = full = empty = failed = share = None
                try:
                    if error:
                        pass
                    elif kind == "txt":
                        text = decoded(content)
                    elif kind == "epub":
                        text = epub_text(content)
                    elif kind in (pages_of or {}):
                        pages = pages_of[kind](content)
                        empty = [k for k, p in enumerate(pages, 1) if p is not None and not p.strip()]
                        failed = [k for k, p in enumerate(pages, 1) if p is None]
                        text, n, full = paged(pages), len(pages), len(pages) - len(empty) - len(failed)
                        share = full / max(n, 1)
                    else:
                        error = f"no extractor for {kind}"
                except Exception as e:  # a broken file is a row with an error
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, text, n, full, empty, failed, share, error))
            numbers = pa.list_(pa.int32())
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), numbers, numbers, pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in TEXT.split(", ")])

    return found.select("path", "format", "content", "error").mapInArrow(read, TEXT)


def needs_ocr(pages: Column, with_text: Column) -> Column:
    return (with_text <= 0) | (with_text / F.greatest(pages, F.lit(1)) < OCR_BELOW)


def with_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages(path, page, text) with the texts of ocr(path, page, ocr_text) where there is none."""
    own = F.nullif(F.trim("text"), F.lit(""))
    return pages.join(ocr, ["path", "page"], "left").select("path", "page", F.coalesce(own, F.nullif(F.trim("ocr_text"), F.lit(""))).alias("text"))


def recognised(texts: Column, scores: Column) -> Column:
    """text and confidence of a page from what a recogniser gave: lines and their scores.

    Missing scores are 0, spare ones go; blank lines are left out of the text but their scores count.
    """
    n = F.size(texts)
    zeros = F.array_repeat(F.lit(0.0), F.greatest(n - F.size(scores), F.lit(0)))
    used = F.slice(F.concat(F.coalesce(scores, F.array().cast("array<double>")), zeros), F.lit(1), n)
    lines = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    mean = F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / n
    return F.when((n > 0) & (F.size(lines) > 0), F.struct(F.array_join(lines, "\n").alias("text"), mean.alias("confidence"))).otherwise(F.struct(F.lit("").alias("text"), F.lit(0.0).alias("confidence")))


def page_section(page: Column, text: Column) -> Column:
    """A page under its marker; nothing of an empty one."""
    return F.when(F.trim(text) != "", F.concat(F.lit("## [p."), page, F.lit("]\n"), F.trim(text))).otherwise("")


def ocr_pages(found: DataFrame, pages: DataFrame | None = None, doubt: float = 0.5) -> DataFrame:
    """found(path, page, texts, scores), of all or of the given pages(path, page) -> text, confidence, and a flag for doubtful ones that have text."""
    if pages is not None:
        found = found.join(pages.select("path", "page").distinct(), ["path", "page"], "left_semi")
    r = recognised(F.col("texts"), F.col("scores"))
    read = found.select("path", "page", r["text"].alias("text"), r["confidence"].alias("confidence"))
    return read.withColumn("doubtful", (F.col("confidence") < doubt) & (F.trim("text") != ""))


def ocr_documents(pages: DataFrame, engine: str) -> DataFrame:
    """ocr_pages() -> of each document engine, mean confidence, pages, those with text, and the doubtful ones."""
    doubtful = F.array_sort(F.collect_list(F.when(F.col("doubtful"), F.col("page"))))
    return pages.groupBy("path").agg(
        F.lit(engine).alias("ocr_engine"), F.bround(F.avg("confidence"), 4).alias("ocr_confidence"), F.count(F.lit(1)).alias("ocr_pages"), F.count_if(F.trim("text") != "").alias("pages_with_text"), doubtful.alias("ocr_doubtful"),
    )


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files and entries of Atom files, with the columns that operators.news.feed_rows takes."""
    rss = spark.read.schema("title string, link string, description string, author string, pubDate string").option("recursiveFileLookup", "true").option("rowTag", "item").xml(path)
    kinds = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, author struct<name:string>, published string, updated string"
    atom = spark.read.schema(kinds).option("recursiveFileLookup", "true").option("rowTag", "entry").xml(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return rss.unionByName(atom.select("title", F.get(own, F.lit(0))["_href"].alias("link"), F.coalesce("summary", "content").alias("description"), F.col("author.name").alias("author"), F.coalesce("published", "updated").alias("pubDate")))
