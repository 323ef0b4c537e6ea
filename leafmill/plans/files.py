"""Queries of the file readers: the given tables as files of each format, in rows as Spark's readers give them."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions.batches import pieces
from leafmill.operators import news
from leafmill.plans import views as v
from leafmill.plans.register import query
from leafmill.sources import readers
from leafmill.sources.shared import folder

EXTENSIONS, MOST = ("TXT", "epub", "Pdf", "xyz", "mobi"), 5000


@query(
    f"""SELECT path, format, file_hash, CASE WHEN n > {MOST} THEN 'too large' WHEN format IS NULL THEN 'unknown format' END AS error FROM (
    SELECT 'shelf.old/doc' || doc_id || '.' || [{", ".join(f"'{x}'" for x in EXTENSIONS)}][doc_id % 5 + 1] AS path, ['txt', 'epub', 'pdf', NULL, 'mobi'][doc_id % 5 + 1] AS format, sha256(text) AS file_hash, strlen(text) AS n FROM documents)""",
    with_views=False,
)
def files_described(spark, d):
    n = F.col("doc_id")
    path = F.concat(F.lit("shelf.old/doc"), n, F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (n % 5 + 1).cast("int")))
    raw = v.table(spark, d, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return readers.described(raw, MOST).select("path", "format", "file_hash", "error")


def _made(docs, kind: str, make):
    """A file of each document: path, format, content, error; make gives its bytes."""

    def write(batches):
        for b in (p for batch in batches for p in pieces(batch)):
            ids, contents = b.column("doc_id").to_pylist(), [make(i, t) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([kind] * len(ids)), pa.array(contents, pa.binary()), pa.nulls(len(ids), pa.string())], ["path", "format", "content", "error"])

    return docs.select("doc_id", "text").mapInArrow(write, "path string, format string, content binary, error string")


def _encoded(doc_id: int, text: str) -> bytes:
    """UTF-8; the older Chinese encoding; or ASCII and a byte that only the last encoding knows."""
    return text.encode(("utf-8", "gb18030")[doc_id % 3]) if doc_id % 3 < 2 else text.encode("ascii", "replace") + b"\xff"


@query(
    r"SELECT CAST(doc_id AS VARCHAR) AS path, sha256(t) AS text_hash, CAST(length(t) AS INTEGER) AS chars FROM (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text ELSE regexp_replace(text, '[^\x00-\x7F]', '?', 'g') || 'ÿ' END AS t FROM documents)",
    with_views=False,
)
def texts_decoded(spark, d):
    found = readers.texts(_made(v.table(spark, d, "documents"), "txt", _encoded))
    return found.select("path", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("chars"))


def _pages(content: bytes) -> list[str | None]:
    """A page for each line; some can't be read, some are blank."""
    return [None if len(x) % 7 == 0 else " \t" if len(x) % 7 == 1 else x for x in content.decode().split("\n")]


PAGED = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents),
p AS (SELECT *, length(line) % 7 = 0 AS failed, length(line) % 7 = 1 OR length(line) % 7 > 1 AND trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l)"""


@query(
    PAGED
    + """ SELECT CAST(doc_id AS VARCHAR) AS path, sha256(string_agg(CASE WHEN failed OR blank THEN '## [p.' || page || ' 无文本]' ELSE '## [p.' || page || ']' || chr(10) || trim(line, ' ' || chr(9) || chr(13)) END, chr(10) || chr(10) ORDER BY page)) AS text_hash,
    CAST(count(*) AS INTEGER) AS pages, CAST(count(*) FILTER (NOT failed AND NOT blank) AS INTEGER) AS pages_with_text, coalesce(string_agg(page, ',' ORDER BY page) FILTER (blank), '') AS empty, coalesce(string_agg(page, ',' ORDER BY page) FILTER (failed), '') AS failed,
    count(*) FILTER (NOT failed AND NOT blank) / count(*) AS coverage, count(*) FILTER (NOT failed AND NOT blank) / count(*) < 0.15 AS needs_ocr FROM p GROUP BY doc_id""",
    with_views=False,
)
def pages_read(spark, d):
    found = readers.texts(_made(v.table(spark, d, "documents"), "pdf", lambda i, t: t.encode()), {"pdf": _pages})
    numbers = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("path", F.sha2("text", 256).alias("text_hash"), "pages", "pages_with_text", numbers("pages_empty").alias("empty"), numbers("pages_failed").alias("failed"), "coverage", readers.needs_ocr(F.col("pages"), F.col("pages_with_text")).alias("needs_ocr"))


#: A recogniser's lines are the parts of a page between commas, each with a score; the last one's score is missing on every other page, and a spare one is there on others.
RECOGNISED = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page FROM documents),
x AS (SELECT doc_id, page, string_split(line, ',') AS texts FROM l),
s AS (SELECT *, list_transform(texts, lambda t, i: CASE WHEN page % 2 = 0 AND i = len(texts) THEN 0.0 ELSE length(t) % 10 / 10.0 END) AS scores, list_filter(list_transform(texts, lambda t: trim(t)), lambda t: t <> '') AS lines FROM x),
r AS (SELECT doc_id, CAST(page AS INTEGER) AS page, array_to_string(lines, chr(10)) AS text, CASE WHEN len(lines) > 0 THEN list_sum(scores) / len(texts) ELSE 0 END AS confidence FROM s)"""


def _recognised(spark, d):
    pages = v.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("page"), F.split("line", ",").alias("texts"))
    scores = F.transform("texts", lambda t: F.length(t) % 10 / 10)
    return pages.withColumn("scores", F.when(F.col("page") % 2 == 0, F.slice(scores, F.lit(1), F.size("texts") - 1)).otherwise(F.concat(scores, F.array(F.lit(1.0)))))


@query(RECOGNISED + " SELECT doc_id AS path, page, text, round(confidence, 9) AS confidence, round(confidence, 9) < 0.5 AND text <> '' AS doubtful FROM r", with_views=False)
def ocr_pages_read(spark, d):
    read = readers.ocr_pages(_recognised(spark, d))
    return read.select("path", "page", "text", F.round("confidence", 9).alias("confidence"), (F.round("confidence", 9).cast("double") < 0.5).alias("low"), "doubtful").select("path", "page", "text", "confidence", F.when(F.col("confidence") == 0.5, F.col("low")).otherwise(F.col("doubtful")).alias("doubtful"))


@query(RECOGNISED + " SELECT doc_id AS path, 'e' AS ocr_engine, count(*) AS ocr_pages, count(*) FILTER (text <> '') AS pages_with_text, true AS is_mean FROM r GROUP BY doc_id", with_views=False)
def ocr_documents_read(spark, d):
    """is_mean: whether the confidence is the mean of its pages' to four places, which sums in another order may round to another last place."""
    pages = readers.ocr_pages(_recognised(spark, d))
    means = pages.groupBy("path").agg(F.avg("confidence").alias("mean"))
    found = readers.ocr_documents(pages, "e").join(means, "path")
    return found.select("path", "ocr_engine", "ocr_pages", "pages_with_text", (F.abs(F.col("ocr_confidence") - F.col("mean")) < 0.0000501).alias("is_mean"))


@query(RECOGNISED + " SELECT l.doc_id AS path, CAST(l.page AS INTEGER) AS page, coalesce(CASE WHEN length(l.line) % 4 > 0 THEN nullif(trim(l.line), '') END, nullif(trim(r.text), '')) AS text FROM l JOIN r ON l.doc_id = r.doc_id AND l.page = r.page", with_views=False)
def pages_with_ocr(spark, d):
    """Pages of which every fourth has no text of its own, with what was recognised."""
    own = v.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("page"), F.when(F.length("line") % 4 > 0, F.col("line")).alias("text"))
    ocr = readers.ocr_pages(_recognised(spark, d)).select("path", "page", F.col("text").alias("ocr_text"))
    return readers.with_ocr(own, ocr)


def _book(doc_id: int, text: str) -> bytes:
    """An EPUB of three chapters and a table of contents: every third line is a paragraph of a chapter; the second chapter has no title of its own."""
    out = io.BytesIO()
    lines = [x for x in text.split("\n") if x.strip()]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + "".join(f'<item id="c{k}" href="part_{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(3))
        z.writestr("OEBPS/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine><itemref idref="nav"/><itemref idref="c2"/><itemref idref="c0"/><itemref idref="c1"/></spine></package>')
        z.writestr("OEBPS/nav.xhtml", "<html><body><p>contents</p></body></html>")
        for k in range(3):
            title = f"<title>T &amp; {k}</title>" if k != 1 else ""
            z.writestr(f"OEBPS/part_{k}.xhtml", f"<html><head>{title}</head><body>{''.join(f'<p>{escape(x)}</p>' for x in lines[k::3])}</body></html>")
    return out.getvalue()


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS ls FROM documents),
    c AS (SELECT doc_id, k, list_transform(list_filter(range(1, len(ls) + 1), lambda i: (i - 1) % 3 = k), lambda i: regexp_replace(ls[i], '[ \t]+$', '')) AS ps FROM l, (VALUES (0), (1), (2)) x(k)),
    t AS (SELECT doc_id, CASE k WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS pos, '## [§' || CASE k WHEN 1 THEN 'part 1' ELSE 'T & ' || k END || ']' || chr(10) || trim(array_to_string(ps, chr(10) || chr(10) || ' ')) AS chapter FROM c WHERE len(ps) > 0)
    SELECT CAST(l.doc_id AS VARCHAR) AS path, coalesce(string_agg(chapter, chr(10) || chr(10) ORDER BY pos), '') AS text FROM l LEFT JOIN t ON l.doc_id = t.doc_id GROUP BY l.doc_id""",
    with_views=False,
)
def epubs_read(spark, d):
    return readers.texts(_made(v.table(spark, d, "documents"), "epub", _book)).select("path", "text")


@query(
    """SELECT substr(sha256(url), 1, 16) AS article_id, 'feed' AS source_id, url, 'Page & ' || page_id AS title, 'About "' || page_id || '"' AS rss_summary, CASE WHEN page_id % 3 > 0 THEN 'A' || page_id END AS author,
    CASE WHEN page_id % 2 = 0 THEN '2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T06:30:00Z' ELSE '2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T06:30:00' END AS published_at FROM pages""",
    with_views=False,
)
def feeds_read(spark, d):
    """Pages as items of RSS and entries of Atom, written as files and read as feeds."""
    n, day = F.col("page_id"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    mark = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    title, about, who = F.concat(F.lit("Page &amp; "), n), F.concat(F.lit("About &quot;"), n, F.lit("&quot;")), F.when(n % 3 > 0, F.concat(F.lit("A"), n))
    empty = F.lit("")
    rss = F.concat(F.lit("<item>"), tag("title", title), tag("link", mark(F.col("url"))), tag("description", about), F.coalesce(tag("author", who), empty), tag("pubDate", F.concat(F.lit("Tue, "), day, F.lit(" Mar 2024 06:30:00 GMT"))), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), tag("title", title), F.lit('<link rel="self" href="https://x.test/self"/><link href="'), mark(F.col("url")), F.lit('"/>'), tag("summary", about), F.coalesce(tag("author", tag("name", who)), empty), tag("published", F.concat(F.lit("2024-03-"), day, F.lit("T06:30:00+00:00"))), F.lit("</entry>"))
    path = folder(spark, "feeds")
    items = v.table(spark, d, "pages").select((n % 8).alias("feed"), F.when(n % 2 == 0, rss).otherwise(atom).alias("item"))
    heads = F.when(F.col("feed") % 2 == 0, F.lit("<rss><channel>")).otherwise("<feed>"), F.when(F.col("feed") % 2 == 0, F.lit("</channel></rss>")).otherwise("</feed>")
    whole = items.groupBy("feed").agg(F.array_join(F.collect_list("item"), "\n").alias("items"))  # eight files, as large as a feed's publisher makes it
    whole.select("feed", F.concat(heads[0], "items", heads[1])).write.partitionBy("feed").text(path)
    return news.feed_rows(readers.feed_items(spark, path), "feed").select("article_id", "source_id", "url", "title", "rss_summary", "author", "published_at")
