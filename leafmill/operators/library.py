"""Books, segments and notes: filters, joins, aggregates, orders, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import MASK, ascii_nocase, first_filled, strip
from leafmill.operators.ordering import RUN, by_runs

#: The fixed categories of a book; the last is the fallback.
CATEGORIES = ("文学", "历史", "科技", "经管", "社科", "生活", "其他")
SLIM = ["segment_id", "book_id", "idx", "label", "anchor_label", "char_count", "summary_status", "retry_count"]
#: Columns of a segment at each width: only full has its text, list has neither summary nor translation.
WIDTHS = {
    "full": [*SLIM, "raw_text", "summary_json", "translation"],
    "list": SLIM,
    "meta": [*SLIM, "summary_json"],
    "summary": ["segment_id", "idx", "summary_json", "label", "anchor_label", "summary_status"],
    "export": [*SLIM, "summary_json", "translation"],
}
STATES = ("running", "queued", "paused", "idle", "summarized")


def progress(segments: DataFrame) -> DataFrame:
    """total and ready segments of each book."""
    return segments.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("summary_status") == "ready").alias("ready"))


def state(total: Column, ready: Column, active: Column, paused: Column, queued: Column) -> Column:
    done = (total > 0) & (ready >= total)
    return F.when(done, "summarized").when(active, "running").when(paused, "paused").when(queued, "queued").otherwise("idle")


def with_progress(books: DataFrame, segments: DataFrame) -> DataFrame:
    joined = books.join(progress(segments), "book_id", "left")
    total, ready = (F.coalesce(x, F.lit(0).cast("long")) for x in ("total", "ready"))
    return joined.select(*books.columns, total.alias("total"), ready.alias("ready"))


def all_ready(segments: DataFrame) -> DataFrame:
    """Books all of whose segments are ready: they become summarized."""
    return progress(segments).filter("total > 0 AND ready = total").select("book_id", F.lit("summarized").alias("status"))


def state_histogram(states: DataFrame) -> DataFrame:
    """A row of counts for every known state, zeros too; books still in processing don't count."""
    counted = states.filter("status <> 'processing'").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    known = states.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return known.join(counted, "state", "left").select("state", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def filtered(books: DataFrame, which: str = "all") -> DataFrame:
    """All, the summarized, or a category; what isn't known is all."""
    if which == "summarized":
        return books.filter("status = 'summarized'")
    return books.filter(F.col("category") == which) if which in CATEGORIES else books


def order_keys(sort: str = "recent") -> list[Column]:
    """Keys of the library's orders, with the id as the last; what isn't known is recent."""
    recent = [F.desc_nulls_last("last_opened_at"), F.desc_nulls_last("updated_at")]
    keys = {
        "recent": recent,
        "added": [F.desc_nulls_last("created_at")],
        "title": [ascii_nocase(F.col("title")).asc_nulls_first()],
        "favorite": [F.desc("is_favorite"), *recent],
    }
    return [*keys.get(sort, recent), F.col("book_id").asc()]


def listed(books: DataFrame, which: str = "all", sort: str = "recent", first: Column | None = None) -> DataFrame:
    """The filtered books with their place in the order; first ranks groups of books before the keys."""
    keys = ([] if first is None else [first.asc()]) + order_keys(sort)
    # one row per book: a library, not a corpus
    return filtered(books, which).withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def activity_rank(state_column: Column) -> Column:
    return F.when(state_column == "running", 0).when(state_column == "queued", 1).otherwise(2)


def segment_list(segments: DataFrame, width: str = "list") -> DataFrame:
    return segments.select(*WIDTHS[width])


def notes_enriched(notes: DataFrame, segments: DataFrame, books: DataFrame) -> DataFrame:
    """Notes with their segment's label and book's title; a label falls back to the anchor, then to the number."""
    s = segments.select("segment_id", "book_id", "idx", "label", "anchor_label")
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("anchor_label"), F.concat(F.lit("段 "), F.col("idx") + 1))
    return notes.join(s, "segment_id").join(books.select("book_id", F.col("title").alias("book_title")), "book_id").select("note_id", "segment_id", "book_id", "book_title", label.alias("segment_label"), "content", "created_at")


def orphans(notes: DataFrame, segments: DataFrame) -> DataFrame:
    """Notes without a segment."""
    return notes.join(segments.select("segment_id"), "segment_id", "left_anti")


def misplaced(notes: DataFrame, segments: DataFrame) -> DataFrame:
    """Notes whose segment belongs to another book than they say."""
    return notes.join(segments.select("segment_id", "book_id"), ["segment_id", "book_id"], "left_anti")


def cascade(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What stays of a child table when the rows with the given keys go."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def first_of_each_hash(files: DataFrame, content: str, key: str) -> DataFrame:
    """Import by content: the first file of each content is new, others are duplicates of it."""
    hashed = files.withColumn("file_hash", F.sha2(F.col(content), 256))
    first = hashed.groupBy("file_hash").agg(F.min(key).alias("original"))
    return hashed.join(first, "file_hash").withColumn("is_new", F.col(key) == F.col("original"))


def upsert(old: DataFrame, new: DataFrame, key: str, overwritten: list[str], kept: list[str]) -> DataFrame:
    """Rows of both by key: overwritten columns from the newest, kept ones from the oldest; is_new of keys that only new has.

    Of several new rows with a key the one with the largest seq counts.
    """
    both = old.withColumn("seq", F.lit(-1).cast("long")).withColumn("was", F.lit(1)).unionByName(new.withColumn("was", F.lit(0)), allowMissingColumns=True)
    takes = [F.max_by(c, "seq").alias(c) for c in overwritten] + [F.min_by(c, "seq").alias(c) for c in kept]
    return both.groupBy(key).agg(*takes, (F.max("was") == 0).alias("is_new"))


def reconcile(presets: DataFrame, stored: DataFrame) -> DataFrame:
    """What a restore of presets(url, title) does to stored(url, title): insert, update or keep."""
    s = stored.select("url", F.col("title").alias("stored_title"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "insert").when(~F.col("title").eqNullSafe(F.col("stored_title")), "update").otherwise("keep")
    return presets.join(s, "url", "left").select("url", "title", action.alias("action"))


def merge_in_order(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows in old's order, then those that old hasn't, in new's order; both have pos."""
    o = old.select(key, F.col("pos").alias("old_pos"))
    merged = new.join(o, key, "left")
    order = Window.orderBy(F.col("old_pos").asc_nulls_last(), "pos", key)
    return merged.withColumn("place", F.row_number().over(order)).drop("old_pos", "pos")


def overlay(base: DataFrame, own: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Settings: own values where they aren't blank or the mask of a secret, else the base's; keys of both."""
    o = own.select(key, *[F.col(f).alias(f"own_{f}") for f in fields])
    filled = [F.coalesce(F.nullif(F.nullif(F.trim(F.col(f"own_{f}")), F.lit("")), F.lit(MASK)), F.col(f)).alias(f) for f in fields]
    return base.join(o, key, "full_outer").select(key, *filled)


def fill_char_counts(segments: DataFrame) -> DataFrame:
    n = F.col("char_count")
    return segments.withColumn("char_count", F.when(n.isNull() | (n == 0), F.length("raw_text")).otherwise(n))


def update_summary(segments: DataFrame, summaries: DataFrame) -> DataFrame:
    """Segments with new summaries(segment_id, new_status, new_anchor): an anchor that is null keeps the old, a summary that is ready clears the retries."""
    joined = segments.join(summaries, "segment_id", "left")
    if "retry_count" in segments.columns:
        joined = joined.withColumn("retry_count", F.when(F.col("new_status") == "ready", 0).otherwise(F.col("retry_count")))
    return joined.withColumn("anchor_label", F.coalesce("new_anchor", "anchor_label")).withColumn("summary_status", F.coalesce("new_status", "summary_status")).drop("new_anchor", "new_status")


def opened(books: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Books after some were opened: the time, and unread becomes reading."""
    hit = F.col("hit").isNotNull()
    joined = books.join(ids.select("book_id").distinct().withColumn("hit", F.lit(1)), "book_id", "left")
    status = F.when(hit & (F.col("status") == "unread"), "reading").otherwise(F.col("status"))
    return joined.select(*[c for c in books.columns if c not in ("status", "last_opened_at")], status.alias("status"), F.when(hit, F.lit(at)).otherwise(F.col("last_opened_at")).alias("last_opened_at"))


def category(x: Column) -> Column:
    """A known category, else the fallback."""
    return F.when(F.trim(x).isin(*CATEGORIES), F.trim(x)).otherwise(F.lit(CATEGORIES[-1]))


def valid_position(idx: Column, count: Column) -> Column:
    """A reading position inside the book; a book without segments takes any."""
    return (idx >= 0) & ((count == 0) | (idx < count))


def window_around(segments: DataFrame, center: int, buffer: int) -> DataFrame:
    """The segments around a place in each book, with how many there are above and below."""
    near = F.col("idx").between(center - buffer, center + buffer)
    total, low = F.count(F.lit(1)), F.count_if(F.col("idx") < center - buffer)
    sums = segments.groupBy("book_id").agg(low.alias("above"), (total - F.count_if(F.col("idx") <= center + buffer)).alias("below"))
    return segments.filter(near).select("book_id", "segment_id", "idx").join(sums, "book_id")


def client_filter(states: DataFrame, which: str) -> DataFrame:
    """states(state, total, ready): all, or those in a state as a reader sees it: paused is idle too, and all ready is summarized."""
    done = (F.col("state") == "summarized") | ((F.col("total") > 0) & (F.col("ready") >= F.col("total")))
    rules = {"all": F.lit(True), "idle": F.col("state").isin("idle", "paused"), "summarized": done}
    return states.filter(rules.get(which, F.col("state") == which))


def public(books: DataFrame, states: DataFrame) -> DataFrame:
    """Books as the outside sees them: flags, numbers from their metadata (null if it can't be read), and states(book_id, total, ready, state, queued) unless still in processing."""
    meta = F.try_parse_json(F.col("metadata_json"))
    number = lambda k: F.try_variant_get(meta, f"$.{k}", "string")
    joined = books.join(states, "book_id", "left")
    live = F.col("status") != "processing"
    return joined.select(
        "book_id", "title", "status", F.coalesce(F.col("is_favorite").cast("boolean"), F.lit(False)).alias("is_favorite"), number("total_char_count").alias("total_char_count"), number("chunker_version").alias("chunker_version"),
        F.coalesce("ready", F.lit(0).cast("long")).alias("ready"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.when(live, F.col("state")).alias("state"), F.when(live, F.coalesce("queued", F.lit(0).cast("long"))).alias("queued"),
    )


def notes_of(notes: DataFrame, book: str | None = None, segment=None) -> DataFrame:
    """All notes, those of a book, or of a segment in it; the last made first."""
    if book is not None:
        notes = notes.filter(F.col("book_id") == book)
    if segment is not None:
        notes = notes.filter(F.col("segment_id") == segment)
    return notes.orderBy(F.desc("created_at"), "note_id")


def is_preset(sources: DataFrame, presets: DataFrame) -> DataFrame:
    marked = presets.select("url", F.lit(True).alias("preset")).distinct()
    return sources.join(marked, "url", "left").withColumn("preset", F.coalesce("preset", F.lit(False)))


def position_delta(segments: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(book_id, from_idx, to_idx) -> the places between two segments in their book's list; null if either isn't there."""
    placed = by_runs(segments.select("book_id", "idx"), "book_id", "idx", F.floor(F.col("idx") / RUN), "at")
    ends = moves.join(placed.select("book_id", F.col("idx").alias("from_idx"), F.col("at").alias("a")), ["book_id", "from_idx"], "left")
    ends = ends.join(placed.select("book_id", F.col("idx").alias("to_idx"), F.col("at").alias("b")), ["book_id", "to_idx"], "left")
    return ends.select("book_id", "from_idx", "to_idx", (F.col("b") - F.col("a")).cast("int").alias("delta"))


def first_sample(segments: DataFrame, chars: int = 2000) -> DataFrame:
    """The start of each book's first segment."""
    return segments.filter("idx = 0").select("book_id", F.substring("raw_text", 1, chars).alias("sample"))


# changes: each gives the table as it is afterwards, or what happens to each request


def imported(files: DataFrame, stored: DataFrame, content: str, key: str, overwrite: bool = False) -> DataFrame:
    """files against stored(book_id, file_hash): new, a duplicate, or with overwrite a replacement of the book that goes."""
    new = first_of_each_hash(files, content, key)
    old = stored.groupBy("file_hash").agg(F.min("book_id").alias("existing"))
    action = F.when(~F.col("is_new"), "duplicate").when(F.col("existing").isNull(), "import").otherwise("replace" if overwrite else "duplicate")
    return new.join(old, "file_hash", "left").select(key, "file_hash", action.alias("action"), F.when(action == "replace", F.col("existing")).alias("purged"))


def without_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the books that go; messages know theirs by the session only."""
    ids = gone.select("book_id").distinct()
    left = {name: rows.join(ids, "book_id", "left_anti") for name, rows in tables.items() if name != "messages"}
    if "messages" in tables:
        sessions = tables["sessions"].join(ids, "book_id", "left_semi").select("session_id")
        left["messages"] = tables["messages"].join(sessions, "session_id", "left_anti")
    return left


def migrated(rows: DataFrame, added: dict[str, str]) -> DataFrame:
    """A table of an older version: columns that it hasn't are added empty, and books left in processing are unread."""
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in added.items() if c not in rows.columns})
    return rows.withColumn("status", F.when(F.col("status") == "processing", "unread").otherwise(F.col("status"))) if "status" in rows.columns else rows


def with_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions(session_id, updated_at) after messages(session_id, created_at) were added: the last one's time."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("last"))
    return sessions.join(last, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "last")).drop("last")


def with_notes(notes: DataFrame, added: DataFrame, deleted: DataFrame, segments: DataFrame) -> DataFrame:
    """notes with those added whose segment belongs to the book they name, without those deleted."""
    good = added.join(segments.select("segment_id", "book_id"), ["segment_id", "book_id"], "left_semi")
    return notes.unionByName(good.select(*notes.columns)).join(deleted.select("note_id").distinct(), "note_id", "left_anti")


def add_sources(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(url, title) -> url, title (the url, if blank) and what happens: added, duplicate, or invalid if it is no web address."""
    url = strip(F.coalesce("url", F.lit("")))
    named = wanted.select(url.alias("url"), first_filled(F.col("title"), url).alias("title"))
    known = stored.select("url", F.lit(True).alias("known")).distinct()
    action = F.when(~F.col("url").rlike("^https?://"), "invalid").when(F.col("known"), "duplicate").otherwise("added")
    return named.join(known, "url", "left").select("url", "title", action.alias("action"))


def without_sources(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """sources without those of the ids; their articles stay."""
    return stored.join(ids.select("source_id").distinct(), "source_id", "left_anti")


def patched(books: DataFrame, patches: DataFrame) -> DataFrame:
    """books after patches(book_id, new_favorite, new_category, new_title): null leaves a field, a blank title too. reindex tells where the title changed."""
    title = first_filled(F.col("new_title"))
    known = F.when(F.col("new_category").isNotNull(), category(F.col("new_category")))
    joined = books.join(patches, "book_id", "left")
    made = {"title": F.coalesce(title, F.col("title")), "category": F.coalesce(known, F.col("category")), "is_favorite": F.coalesce(F.col("new_favorite"), F.col("is_favorite")), "reindex": F.coalesce(title != F.col("title"), F.lit(False))}
    return joined.withColumns(made).drop("new_favorite", "new_category", "new_title")


#: Fields of an article that an update may set (fixed values).
UPDATABLE = ("title", "excerpt", "author", "published_at", "rss_summary", "one_liner", "score_hint", "fetched_text_path", "summary_markdown", "summary_status")


def updated(articles: DataFrame, changes: DataFrame) -> DataFrame:
    """articles after changes(article_id, fields: map from name to text): only fields that may be set are."""
    joined = articles.join(changes, "article_id", "left")
    takes = {c: F.when(F.map_contains_key(F.coalesce("fields", F.create_map().cast("map<string,string>")), c), F.element_at("fields", c).try_cast(kind)).otherwise(F.col(c)) for c, kind in articles.dtypes if c in UPDATABLE}
    return joined.withColumns(takes).drop("fields")


def manual_category(x: Column) -> Column:
    """A category that a reader set; null stays null."""
    return F.when(x.isNotNull(), category(x))


def distinct_in_order(first: Column, second: Column) -> Column:
    """The items of both lists, each once, at its first place."""
    return F.array_distinct(F.concat(first, second))


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key once, with its row, or with nulls if there is none."""
    return wanted.select(key).distinct().join(rows, key, "left")
