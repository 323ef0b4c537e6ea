"""Feeds and articles: parsing of summaries, ranking, the brief, choice of bodies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.batches import in_pieces
from leafmill.functions.text import bare, body_is_good, cut, ensure_mark, first_filled, once, sentences, strip

#: Headings of a structured summary and the fields they open (fixed values).
SECTIONS = {"一句话摘要": "one_liner", "详细摘要": "detail", "主要观点": "viewpoints", "文章金句": "quotes", "文章信息": "meta"}
HEADING = r"(?U)(?:^|\s)(?:[📌📝💡💬📊]\s*)?(?:" + "|".join(SECTIONS) + r")\s*"
#: Keys of the information line (fixed values).
META = {
    "ai_score": r"(?i)AI\s*初评[:：]\s*(\d{1,3})",
    "source": r"来源[:：]\s*([^\s]+(?:\([^)]*\))?)",
    "author": r"作者[:：]\s*([^\s]+)",
    "category": r"分类[:：]\s*([^\s]+)",
    "language": r"语言[:：]\s*([^\s]+)",
    "read_mins": r"阅读时间[:：]\s*(\d+)\s*分钟",
    "word_count": r"字数[:：]\s*(\d+)",
}
CLAIM_MOST, NOTE_LEAST = 60, 35
#: Sentences that are folded at once.
RUN = 128
VIEWS = "struct<claims:array<string>,notes:array<string>,open:string>"


def sections(text: Column) -> Column:
    """Bodies by field; of a repeated heading the last counts."""
    ended = lambda b: F.when(b.contains("阅读"), F.regexp_replace(b, r"\s*阅读(?:完整文章|推文)\s*$", "")).otherwise(b)
    fields = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])

    def paired(raw: Column) -> Column:
        names = F.transform(F.regexp_extract_all(raw, F.lit(HEADING), F.lit(0)), lambda h: F.regexp_replace(h, r"(?U)[\s📌📝💡💬📊]", ""))
        bodies = once(F.split(raw, HEADING, -1), lambda parts: F.transform(F.transform(F.slice(parts, F.lit(2), F.size(parts)), ended), bare))
        return F.zip_with(names, bodies, lambda n, b: F.struct(F.element_at(fields, n).alias("k"), b.alias("b")))

    pairs = F.filter(once(F.coalesce(text, F.lit("")), lambda t: once(bare(t), paired)), lambda p: p["b"] != "")
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["b"])))
    return last


def viewpoints(text: Column) -> Column:
    """Claims and notes: a short sentence takes the next one as its note, if that is longer and long enough."""
    start = F.struct(F.array().cast("array<string>").alias("claims"), F.array().cast("array<string>").alias("notes"), F.lit(None).cast("string").alias("open"))

    def closed(s: Column, claim: Column, note: Column, open_: Column) -> Column:
        return F.struct(F.array_append(s["claims"], ensure_mark(claim)).alias("claims"), F.array_append(s["notes"], note).alias("notes"), open_.cast("string").alias("open"))

    def step(s: Column, x: Column) -> Column:
        pairs = (F.length(x) > F.length(s["open"])) & (F.length(x) >= NOTE_LEAST) & (F.length(s["open"]) <= CLAIM_MOST)
        waiting = F.struct(s["claims"].alias("claims"), s["notes"].alias("notes"), x.alias("open"))
        return F.when(s["open"].isNull(), waiting).when(pairs, closed(s, s["open"], x, F.lit(None))).otherwise(closed(s, s["open"], F.lit(""), x))

    def folded(said: Column) -> Column:
        """In runs of sentences, so that no list is copied once for each of them."""

        def run(s: Column, i: Column) -> Column:
            begin = F.struct(start["claims"].alias("claims"), start["notes"].alias("notes"), s["open"].alias("open"))
            joined = lambda r: F.struct(F.concat(s["claims"], r["claims"]).alias("claims"), F.concat(s["notes"], r["notes"]).alias("notes"), r["open"].alias("open"))
            return once(F.aggregate(F.slice(said, i, F.lit(RUN)), begin, step), joined)

        runs = F.sequence(F.lit(1), F.greatest(F.size(said), F.lit(1)), F.lit(RUN))
        return F.aggregate(runs, start, run, lambda s: F.when(s["open"].isNull(), s).otherwise(closed(s, s["open"], F.lit(""), F.lit(None))))

    return once(sentences(text), folded)


def quotes(text: Column) -> Column:
    return F.transform(F.filter(sentences(text), lambda s: F.length(F.btrim(s, F.lit("。！？.!?"))) >= 2), ensure_mark)


def meta(text: Column) -> Column:
    found = F.create_map(*[x for k, p in META.items() for x in (F.lit(k), F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")))])
    return F.map_filter(found, lambda k, v: v.isNotNull())


def plain(text: Column) -> Column:
    """A summary without headings: the first sentence, the rest, and up to five short claims."""
    raw = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    s = sentences(raw)
    rest = F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))
    claims = F.slice(F.transform(F.filter(rest, lambda x: F.length(x) <= CLAIM_MOST), lambda x: F.when(x.rlike("[。！？]$"), x).otherwise(F.concat(x, F.lit("。")))), 1, 5)
    one = F.get(s, F.lit(0))
    return F.struct(
        F.coalesce(F.when(F.length(one) > 120, F.concat(F.substring(one, 1, 119), F.lit("…"))).otherwise(one), F.lit("")).alias("one_liner"),
        F.array_join(rest, "").alias("detail"), claims.alias("viewpoints"), F.array().cast("array<string>").alias("viewpoint_notes"), F.array().cast("array<string>").alias("quotes"), F.create_map().cast("map<string,string>").alias("meta"),
    )


def parse_summary(text: Column) -> Column:
    """One-liner, detail, viewpoints with notes, quotes and information of a feed's summary."""

    def parsed(s: Column) -> Column:
        get = lambda k: F.coalesce(F.element_at(s, k), F.lit(""))
        made = lambda v: F.struct(get("one_liner").alias("one_liner"), get("detail").alias("detail"), v["claims"].alias("viewpoints"), v["notes"].alias("viewpoint_notes"), quotes(get("quotes")).alias("quotes"), meta(get("meta")).alias("meta"))
        return F.when(get("one_liner") != "", once(viewpoints(get("viewpoints")), made)).otherwise(plain(first_filled(get("detail"), text)))

    return once(sections(text), parsed)


def score_hint(parsed: Column) -> Column:
    v = F.element_at(parsed["meta"], "ai_score").try_cast("double")
    return F.when(v.between(0, 100), v)


def is_rich(parsed: Column) -> Column:
    """Enough structure to skim without a model."""
    return (F.length(F.trim(parsed["detail"])) >= 80) | (F.size(parsed["viewpoints"]) >= 2) | (F.size(parsed["quotes"]) > 0)


def skim_text(parsed: Column) -> Column:
    lines = F.zip_with(parsed["viewpoints"], parsed["viewpoint_notes"], lambda c, n: F.concat(F.lit("· "), c, F.when(F.trim(n) != "", F.concat(F.lit("\n  "), F.trim(n))).otherwise("")))
    return F.array_join(lines, "\n")


def timestamp(x: Column) -> Column:
    """ISO times and dates; those without an offset are UTC, whatever the session's zone. Anything else is null."""
    s = F.trim(x)
    full = F.when(s.contains("T"), s).otherwise(F.concat(F.substring(s, 1, 10), F.lit("T00:00:00")))
    zoned = F.when(full.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(full.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}"), F.try_to_timestamp(zoned))


def freshness(published: Column, synced: Column, now: Column) -> Column:
    """3 in the first day, 1.5 in three, 0.5 in seven, else 0; without a time 0. A time to come counts as now."""
    at = F.coalesce(timestamp(published), timestamp(synced))
    hours = F.greatest(F.lit(0.0), (timestamp(now).cast("double") - at.cast("double")) / 3600)
    return F.when(at.isNull(), 0.0).when(hours <= 24, 3.0).when(hours <= 72, 1.5).when(hours <= 168, 0.5).otherwise(0.0)


def scored(articles: DataFrame, now: str) -> DataFrame:
    fresh = freshness(F.col("published_at"), F.col("synced_at"), F.lit(now))
    hint = F.col("score_hint")
    reasons = F.array_compact(F.array(F.when(fresh > 0, "新鲜"), F.when(hint.isNotNull(), F.concat(F.lit("质量提示:"), hint.cast("int")))))
    return articles.select("*", (fresh + F.coalesce(hint / 50, F.lit(0.0))).alias("score"), F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("默认候选"))).alias("reasons"))


def brief(articles: DataFrame, sources: DataFrame, now: str, k: int = 25) -> DataFrame:
    """The k best of the newest: a pool by time of sync, then the rank by score, time and title."""
    pool = articles.orderBy(F.desc("synced_at"), "article_id").limit(max(6 * k, 150))
    keys = [F.desc("score"), F.coalesce("published_at", F.lit("")).desc(), F.coalesce("title", F.lit("")).desc(), F.col("article_id").asc()]
    best = scored(pool, now).orderBy(*keys).limit(k)
    names = sources.select("source_id", first_filled(F.col("title"), F.col("url"), F.col("source_id")).alias("source_title"))
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(*keys)))  # k rows
    return placed.join(names, "source_id", "left").withColumn("source_title", F.coalesce("source_title", F.nullif(F.col("source_id"), F.lit(""))))


def recent(articles: DataFrame, k: int = 50) -> DataFrame:
    """The k last published, then last synced."""
    return articles.orderBy(F.desc("published_at"), F.desc("synced_at"), "article_id").limit(k)


def of_source(articles: DataFrame, source: str = "all") -> DataFrame:
    return articles if source == "all" else articles.filter(F.col("source_id") == source)


def cards(ranked: DataFrame) -> DataFrame:
    """ranked(..., rss_summary, one_liner, excerpt, author) -> what a card of the brief shows, lists and detail cut to its limits (fixed values)."""
    p = F.col("p")
    line = first_filled(F.col("one_liner"), p["one_liner"], F.col("excerpt"))
    detail = F.nullif(cut(strip(F.coalesce(p["detail"], F.lit(""))), 360), F.lit(""))
    own = F.map_filter(p["meta"], lambda k, v: v.isNotNull())
    author = first_filled(F.col("author"))
    meta = F.when(author.isNotNull() & ~F.map_contains_key(own, "author"), F.map_concat(own, F.create_map(F.lit("author"), author))).otherwise(own)
    shown = F.coalesce(detail, p["detail"])
    rich = (F.length(F.trim(F.coalesce(shown, F.lit("")))) >= 80) | (F.size(p["viewpoints"]) >= 2) | (F.size(p["quotes"]) > 0)
    made = {"one_liner": line, "detail": detail, "viewpoints": F.slice(p["viewpoints"], 1, 5), "quotes": F.slice(p["quotes"], 1, 6), "meta": meta, "skim_rich": rich}
    return ranked.withColumn("p", parse_summary(F.col("rss_summary"))).withColumns(made).drop("p")


def expected_words(parsed: Column) -> Column:
    """The number of words that a summary announces, null unless it is above 0."""
    n = F.element_at(parsed["meta"], "word_count").try_cast("int")
    return F.when(n > 0, n)


def origin_hint(parsed: Column) -> Column:
    """The source that a summary names, if it is an address."""
    source = F.trim(F.element_at(parsed["meta"], "source"))
    return F.when(source.rlike("^https?://"), source)


def fallback_body(parsed: Column, excerpt: Column) -> Column:
    """What a summary tells, for want of the body: line, detail, viewpoints, quotes; else the excerpt."""
    listed = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    parts = F.array(parsed["one_liner"], parsed["detail"], listed("主要观点：", parsed["viewpoints"]), listed("金句：", parsed["quotes"]))
    body = strip(F.array_join(F.filter(F.array_compact(parts), lambda x: strip(x) != ""), "\n\n"))
    return F.when(body != "", body).otherwise(F.coalesce(excerpt, F.lit("")))


def cached(title: Column, url: Column, body: Column) -> Column:
    """A body as it is kept: title, address and text."""
    return F.concat(F.lit("# "), title, F.lit("\n\n来源: "), url, F.lit("\n\n"), body)


def uncached(raw: Column) -> Column:
    """title and body of a kept text; a text without the head is the body."""
    raw = F.coalesce(raw, F.lit(""))
    head = F.regexp_extract(raw, r"(?m)^# (.*)$", 1)
    parts = F.split(raw, "\n\n", 3)
    rest = F.when((F.size(parts) == 3) & F.get(parts, F.lit(1)).startswith("来源:"), F.get(parts, F.lit(2))).otherwise(F.array_join(F.slice(parts, 2, 2), "\n\n"))
    body = F.when(raw.startswith("# ") & (F.size(parts) >= 2), rest).otherwise(raw)
    return F.struct(strip(head).alias("title"), strip(body).alias("body"))


def article_context(body: Column, fallback: Column, card: Column) -> Column:
    """What a question about an article is answered from: the start of its body (fixed value), else its summary, else its card."""
    return first_filled(F.substring(body, 1, 12000), fallback, card)


def deep_read(body: Column, good: Column, parsed: Column, excerpt: Column, least: int = 250) -> Column:
    """body, strategy and status of a deep read: a good body, a short one of some length, or what the summary tells."""
    n = F.length(strip(F.coalesce(body, F.lit(""))))
    told = fallback_body(parsed, excerpt)
    strategy = F.when(good, "full").when(n >= least, "short").when(told != "", "summary").otherwise("none")
    text = F.when(strategy.isin("full", "short"), strip(body)).when(strategy == "summary", told)
    return F.struct(text.alias("body"), strategy.alias("strategy"), F.when(strategy == "none", "failed").otherwise("ready").alias("status"), strategy.isin("full").alias("complete"))


def sync_counts(fetched: DataFrame, known: DataFrame, sources: DataFrame) -> DataFrame:
    """sources(source_id, error) -> of each source the fetched(source_id, article_id) and the new ones among them, or its error."""
    new = fetched.join(known.select("article_id").distinct().withColumn("old", F.lit(True)), "article_id", "left")
    counts = new.groupBy("source_id").agg(F.count(F.lit(1)).alias("fetched"), F.count_distinct(F.when(F.col("old").isNull(), F.col("article_id"))).alias("inserted"))
    zero = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return sources.join(counts, "source_id", "left").select("source_id", zero("fetched").alias("fetched"), zero("inserted").alias("inserted"), "error")


def choose_body(candidates: DataFrame) -> DataFrame:
    """candidates(article_id, attempt, strategy, text, expected_words): the first good body, else the longest, flagged."""
    good = body_is_good(F.col("text"), F.col("expected_words"))
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    order = F.struct((~good).alias("bad"), F.when(good, F.col("attempt")).otherwise(-n).alias("rank"), F.col("attempt").alias("tie"))
    return candidates.select("article_id", order.alias("o"), F.struct("attempt", "strategy", n.alias("chars"), good.alias("good")).alias("c")).groupBy("article_id").agg(F.min_by("c", "o").alias("c")).select("article_id", "c.*")


#: Most addresses of origins that are tried, and of them those through the proxy; the least length of a body (fixed values).
ORIGINS, PROXIED, BODY_LEAST = 5, 2, 500
TRIES = ("direct", "proxy", "origin", "origin_proxy")


def fetched(candidates: DataFrame) -> DataFrame:
    """candidates(article_id, strategy, nth, text, expected_words) -> the body of each article, by the first try that is good.

    Direct, the proxy, the first origins, the proxy on fewer of them. An origin's body must also be
    more than twice as long as what came before from the page itself. Failing all, the longest text (of equal ones the
    first) stands, marked short; without any text the article failed.
    """
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    s = F.col("strategy")
    tried = candidates.withColumn("n", n).filter((s != "origin") | (F.col("nth") < ORIGINS)).filter((s != "origin_proxy") | (F.col("nth") < PROXIED))
    order = F.struct(F.array_position(F.array(*map(F.lit, TRIES)), s).alias("a"), F.col("nth").alias("b"))
    stub = tried.groupBy("article_id").agg(F.coalesce(F.max(F.when(s.isin("direct", "proxy"), F.col("n"))), F.lit(0)).alias("stub"))
    good = body_is_good(F.col("text"), F.col("expected_words")) & ((s != "origin") | (F.col("n") > F.greatest(2 * F.col("stub"), F.lit(BODY_LEAST))))
    rank = F.struct((~good).alias("bad"), F.when(good, 0).otherwise(-F.col("n")).alias("size"), order.alias("order"))
    best = tried.join(stub, "article_id").select("article_id", rank.alias("rank"), F.struct("strategy", "nth", "n", good.alias("good")).alias("c")).groupBy("article_id").agg(F.min_by("c", "rank").alias("c"))
    outcome = F.when(F.col("c.good"), "good").when(F.col("c.n") > 0, "short").otherwise("failed")
    return best.select("article_id", F.when(outcome != "failed", F.col("c.strategy")).alias("strategy"), F.when(outcome != "failed", F.col("c.nth")).alias("nth"), F.col("c.n").alias("chars"), outcome.alias("outcome"))


#: Words beside a link to the original, hosts that are no origin, and endings of files that are none (fixed values).
ORIGIN_HINT = re.compile(r"阅读(?:完整)?(?:文章|原文)|查看原文|原文链接|原文地址|original\s*(?:article|link)|source\s*url", re.I)
NO_ORIGIN = (
    "schema.org w3.org purl.org creativecommons.org github.com twitter.com x.com facebook.com linkedin.com youtube.com google.com fonts.googleapis.com cdn.jsdelivr.net"
).split()
AGGREGATORS = ("bestblogs.dev",)
NO_PAGE = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".json")
HREF = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)""", re.I)
HINT_CHARS, OTHERS = 160, 3


def _under(host: str, names) -> bool:
    return any(host == x or host.endswith("." + x) for x in names)


def _leads_out(link: str, page: str) -> bool:
    """Whether an address can be an article's origin: a page with a path, on another site that is no platform."""
    try:
        parts, own = urlsplit(link), urlsplit(page).hostname or ""
        host = (parts.hostname or "").lower()
    except ValueError:
        return False
    same = bool(own) and (_under(host, [own.lower()]) or _under(own.lower(), [host]))
    path = parts.path.lower()
    return parts.scheme in ("http", "https") and bool(host) and not same and not _under(host, [*AGGREGATORS, *NO_ORIGIN]) and bool(path.strip("/")) and not path.endswith(NO_PAGE)


def _origins(page: str | None, url: str | None) -> list[str]:
    found: dict[bool, dict[str, str]] = {True: {}, False: {}}
    for m in HREF.finditer(page or ""):
        try:
            link = urljoin(url or "https://example.invalid/", m[1].strip())
        except ValueError:  # no address
            continue
        if _leads_out(link, url or ""):
            hinted = bool(ORIGIN_HINT.search(page, max(0, m.start() - HINT_CHARS), m.end() + HINT_CHARS))
            found[hinted].setdefault(link.split("#")[0].rstrip("/"), link)
    return list(found[True].values()) or list(found[False].values())[:OTHERS]


def _all_origins(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        for pages, urls in in_pieces(*columns):
            yield pa.array([_origins(p, u) for p, u in zip(pages, urls, strict=True)], pa.list_(pa.string()))


def origins(page: Column, url: Column) -> Column:
    """The addresses of a page's originals: links with words that say so beside them, else its first few links that lead out."""
    return F.arrow_udf(_all_origins, "array<string>")(page, url)


def feed_rows(items: DataFrame, source_id: str) -> DataFrame:
    """items(title, link, description, author, pubDate) of a feed -> articles; items without a link go."""
    from leafmill.functions.text import article_id, strip_html

    summary = strip_html(F.coalesce("description", F.lit("")))
    rows = items.filter(first_filled(F.col("link")).isNotNull()).select(F.trim("link").alias("url"), strip_html(F.coalesce("title", F.lit(""))).alias("title"), summary.alias("rss_summary"), "author", "pubDate")
    rows = rows.withColumn("parsed", parse_summary(F.col("rss_summary")))
    month = F.element_at(F.create_map(*[x for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (F.lit(m), F.lit(f"{i:02d}"))]), F.regexp_extract("pubDate", r"\d{1,2} ([A-Z][a-z]{2}) \d{4}", 1))
    parts = lambda p, i: F.regexp_extract("pubDate", p, i)
    full = r"(\d{1,2}) [A-Z][a-z]{2} (\d{4}) (\d{2}:\d{2}:\d{2})"
    when = F.concat(parts(full, 2), F.lit("-"), month, F.lit("-"), F.lpad(parts(full, 1), 2, "0"), F.lit("T"), parts(full, 3), F.lit("Z"))
    excerpt = first_filled(F.col("parsed.one_liner"), cut(F.col("rss_summary"), 220))
    return rows.select(
        article_id(F.col("url")).alias("article_id"), F.lit(source_id).alias("source_id"), "url", first_filled(F.col("title"), F.col("url")).alias("title"), excerpt.alias("excerpt"),
        first_filled(F.col("author"), F.element_at(F.col("parsed.meta"), "author")).alias("author"), F.when(F.col("pubDate").rlike(full), when).otherwise(F.substring("pubDate", 1, 19)).alias("published_at"),
        "rss_summary", F.col("parsed.one_liner").alias("one_liner"), score_hint(F.col("parsed")).alias("score_hint"),
    )
