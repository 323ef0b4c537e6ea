"""Full-text search by trigrams, ranked by BM25: over books, segments and notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BODY_CHARS = 4000


#: Kinds of rows, in the order in which a reader sees them.
KINDS = ("book", "segment", "note")


def index(segments: DataFrame, books: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """kind, book_id, segment_id, note_id, idx, title, body of all that can be found.

    A book by title and author, a segment by label, summary, the start of its text and translation, a note by quote and content.
    A note is a row of its own: it stays when its segment is indexed again. Segments with book_title aren't joined to the books.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = lambda c, kind="long": F.lit(None).cast(kind).alias(c)
    b = books.select("book_id", text("title").alias("book_title"))
    found = books.select(F.lit("book").alias("kind"), "book_id", none("segment_id"), none("note_id"), none("idx", "int"), text("title").alias("title"), text("author").alias("body"))
    body = F.concat_ws("\n", text("label"), text("summary_json"), F.substring(text("raw_text"), 1, BODY_CHARS), text("translation"))
    found = found.unionByName((segments if "book_title" in segments.columns else segments.join(b, "book_id")).select(F.lit("segment").alias("kind"), "book_id", "segment_id", none("note_id"), "idx", segment_title().alias("title"), body.alias("body")))
    return found if notes is None else found.unionByName(noted(notes, segments, books))


def segment_title() -> Column:
    """The title of a segment, from book_title and idx."""
    return F.concat("book_title", F.lit(" · 段 "), F.col("idx") + 1)


def noted(notes: DataFrame, segments: DataFrame, books: DataFrame) -> DataFrame:
    """The rows of notes, of an index."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    placed = notes.join(segments.select("segment_id", "book_id", "idx"), "segment_id").join(books.select("book_id", text("title").alias("book_title")), "book_id")
    return placed.select(F.lit("note").alias("kind"), "book_id", "segment_id", "note_id", "idx", F.concat(F.lit("笔记 · "), "book_title").alias("title"), F.concat(text("quote"), F.lit("\n"), text("content")).alias("body"))


def by_kind(hits: DataFrame) -> DataFrame:
    """Hits with the place at which a reader sees them: books, then segments, then notes, each by rank."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return hits.orderBy(order, "rank", "book_id", "segment_id", "note_id")


def terms_of(query: str) -> list[str]:
    """Quoted phrases and words, in lower case; those of under three characters have no trigram and are left out."""
    found = [(a or b).lower() for a, b in re.findall(r'"([^"]*)"|(\S+)', query)]
    return list(dict.fromkeys(t for t in found if len(t) >= 3))


def frequency(text: Column, term: str) -> Column:
    """Occurrences, overlapping ones too."""
    return F.regexp_count(text, F.lit("(?=" + "".join(rf"\x{{{ord(c):x}}}" for c in term) + ")"))


def bm25(rows: DataFrame, query: str) -> DataFrame:
    """rows(.., title, body) that hold all terms, with rank: the less, the better.

    One aggregate gives the rows, their mean length and each term's rows; it comes back as a single row.
    """
    terms = terms_of(query)
    if not terms:
        return rows.withColumn("rank", F.lit(0.0)).filter(F.lit(False))
    both = F.lower(F.concat(F.col("title"), F.lit("\n"), F.col("body")))
    length = F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("body") - 2, F.lit(0))
    counted = rows.select("*", length.alias("length_"), *[frequency(both, t).alias(f"f{i}_") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n_"), F.avg("length_").alias("mean_"), *[F.count_if(F.col(f"f{i}_") > 0).alias(f"n{i}_") for i in range(len(terms))])
    hits = counted.filter(" AND ".join(f"f{i}_ > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # a single row
    rank = F.lit(0.0)
    for i in range(len(terms)):
        n, f = F.col(f"n{i}_"), F.col(f"f{i}_")
        idf = F.log((F.col("n_") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        rank = rank - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length_") / F.col("mean_")))
    return hits.select(*rows.columns, rank.alias("rank"))


def search(rows: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The best rows; equal ranks in order of their ids."""
    ties = [c for c in ("kind", "book_id", "segment_id", "note_id") if c in rows.columns]
    return bm25(rows, query).orderBy("rank", *ties).limit(limit)


#: Words that tell what a question is about, and words that ask for facts from outside (fixed values).
ACADEMIC, CODE, BOOKS = "arxiv|论文|paper|research|study", "github|repo|代码|开源|library api", "作者|书名|出版|author|isbn|open library"
OUTSIDE = "历史上|背景|为什么|维基|网上|最新|who is|when did|wikipedia"


def domain(query: Column) -> Column:
    """What a question is about: the first of the lists that has a word of it."""
    q = F.lower(query)
    return (
        F.when(q.rlike(ACADEMIC), "academic")
        .when(q.rlike(CODE), "code")
        .when(q.rlike(BOOKS), "books")
        .otherwise("general")
    )


def evidence_is_enough(query: Column, context: Column, least: int = 200) -> Column:
    """Enough context, and no word in the question that asks for outside facts."""
    outside = F.lower(query).rlike(OUTSIDE)
    return (F.length(F.trim(F.coalesce(context, F.lit("")))) >= least) & ~outside


def top_results(results: DataFrame, limit: int = 5) -> DataFrame:
    """Web results(query_id, pos, url, ...): the first of each url, then the first few of each query."""
    from pyspark.sql import Window

    once = results.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("pos"))).filter("nth = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("place") <= limit).drop("nth")


#: The source that is asked besides the general one, by what a question is about (fixed values).
EXTRA = {"academic": "arxiv", "books": "openlibrary", "code": "github", "general": "wikipedia"}


def web_results(queries: DataFrame, results: DataFrame, provider: str, limit: int = 5) -> DataFrame:
    """queries(query_id, domain), results(query_id, source, pos, url, ...) -> the first of each url: the provider's, then those of the domain's own source."""
    extra = F.create_map(*[F.lit(x) for kv in EXTRA.items() for x in kv])
    asked = results.join(queries.select("query_id", F.element_at(extra, F.col("domain")).alias("extra")), "query_id")
    first, second = F.col("source") == provider, F.col("source") == F.col("extra")
    placed = asked.filter((first | second) & (F.coalesce("url", F.lit("")) != "")).withColumn("pos", F.col("pos") + F.when(first, 0).otherwise(1 << 20))
    return top_results(placed.drop("extra"), limit)
