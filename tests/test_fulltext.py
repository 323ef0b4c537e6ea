"""The stored index against SQLite's full-text search with the same tokens, and against an index built afresh."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from leafmill.operators import fulltext, match
from leafmill.sources.shared import folder

KIND = "kind string, book_id string, segment_id long, note_id long, idx int, title string, body string"
WORDS = ["abc", "abcd", "The", "fox jumps", "section", "段落文字", "ab", "Ünïté", "foo_bar", "42x9", "don", "one two", "xabcx", "jumps over", "onon", "ononon", "深度学习"]
ATOMS = ["abc", '"fox jumps"', "ab", "section", "段落文字", "xab*", "^abc", "title:abc", "body:fox", "-title:abc", "{title body}:one", '"x""y"', "onon", "a.b", "it's", "foo-bar", "NOT", "(abc OR don)", "title:(abc OR fox)", "kind:abc", "nope:abc", "ÜNÏ", "深度学"]

#: SQLite marks hits that overlap in pieces, here they are one.
OVERLAPPING = ("onon",)


def texts(n, seed):
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return [(words(rng.randint(0, 6)) + rng.choice(["", ". ", ": "]) + words(rng.randint(0, 4)), ". ".join(words(rng.randint(0, 7)) for _ in range(rng.randint(1, 3)))) for _ in range(n)]


class Sqlite:
    def __init__(self, rows):
        self.c = sqlite3.connect(":memory:")
        self.c.execute("create virtual table t using fts5(book_id UNINDEXED, segment_id UNINDEXED, note_id UNINDEXED, kind UNINDEXED, title, body, tokenize='trigram')")
        self.c.executemany("insert into t(rowid, title, body) values (?, ?, ?)", rows)

    def search(self, query):
        """row, rank, snippet of the title; an error as a word."""
        try:
            return {i: (rank, s) for i, rank, s in self.c.execute("select rowid, rank, snippet(t, 4, '[', ']', '…', 10) from t where t match ?", (query,))}
        except sqlite3.OperationalError:
            return "error"


def hits(index, query):
    rows = index.search(query, limit=None).collect()
    return "error" if any(r.error for r in rows) else {r.segment_id: (r["rank"], r.snippet) for r in rows}


def of(spark, rows):
    return spark.createDataFrame([("segment", "b", i, None, i, *t) for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def both(spark):
    rows = list(enumerate(texts(150, 5)))
    rows += [(150, ("", "")), (151, ("ab", "x")), (152, ("fox jumps over the lazy fox jumps", "İabc straße")), (153, ("a " * 30 + ". abc here and abc there: fox jumps", "abc"))]
    return fulltext.Index.build(of(spark, rows), folder(spark, "index"), 8), Sqlite([(i, *t) for i, t in rows])


def assert_same(mine, theirs, query):
    if "error" in (mine, theirs):
        assert mine == theirs, query
        return
    assert mine.keys() == theirs.keys(), query
    for i, (rank, snippet) in theirs.items():
        assert mine[i][0] == pytest.approx(rank, abs=1e-9), (query, i)
        assert mine[i][1] == snippet or query in OVERLAPPING, (query, i, mine[i][1], snippet)


@pytest.mark.parametrize("query", ["abc", "abc ab", '"fox jumps" OR section', "onon", "深度学习 NOT abc", "title:abc fox", "-title:fox jumps", "^abc", "(abc OR don) AND section", "ab", "", "ab*", "foo-bar", "nope:abc", '"open', "abc abc", "the fox"])
def test_hits_ranks_and_snippets_are_sqlites(both, query):
    index, sqlite = both
    assert_same(hits(index, query), sqlite.search(query) if query else {}, query)


def test_many_queries_are_read_as_sqlite_reads_them():
    rng = random.Random(9)
    rows = [(i, *t) for i, t in enumerate(texts(60, 6))]
    sqlite = Sqlite(rows)
    for _ in range(2500):
        query = rng.choice(ATOMS) + "".join(rng.choice([" AND ", " OR ", " NOT ", " ", " "]) + rng.choice(ATOMS) for _ in range(rng.randint(0, 3)))
        theirs = sqlite.search(query)
        try:
            tree, phrases = match.parse(query)
        except match.Unreadable:
            assert theirs == "error", query
            continue
        assert theirs != "error", query
        found = set()
        for i, *text in rows:
            f = [False] * len(phrases)
            for k, p in enumerate(phrases):
                for name, t in zip(match.FIELDS, text, strict=True):
                    g = match.trigrams(t)
                    f[k] |= name in p.fields and any(g[j : j + len(p.grams)] == p.grams and (j == 0 or not p.initial) for j in range(len(g)))
            if true(tree, f):
                found.add(i)
        assert found == set(theirs), query


def true(tree, f):
    if tree == match.NOTHING:
        return False
    if tree[0] == "phrase":
        return f[tree[1]]
    a, b = (true(x, f) for x in tree[1:])
    return a and b if tree[0] == "AND" else a or b if tree[0] == "OR" else a and not b


def lists(index):
    rows = index.rows
    return sorted(map(str, index.contents().join(rows, "row_no").select("segment_id", "field", "gram", "n").collect())), sorted(map(str, rows.drop("row_no").collect())), index.n_rows, index.n_grams


def test_changes_leave_what_an_index_built_afresh_has(spark):
    old, new = list(enumerate(texts(40, 1))), texts(50, 2)
    index = fulltext.Index.build(of(spark, old), folder(spark, "index"), 8)
    state = dict(old)
    for step in ([(3, new[0]), (99, new[1])], [(3, new[2])], [(i, new[i]) for i in range(20, 45)]):
        index = index.put(of(spark, step))
        state |= dict(step)
    index = index.remove(of(spark, [(5, ("", "")), (99, ("", "")), (777, ("", ""))]))
    for i in (5, 99):
        del state[i]
    fresh = fulltext.Index.build(of(spark, sorted(state.items())), folder(spark, "index"), 8)
    assert lists(index) == lists(fresh) and index.n_rows == len(state)
    assert rounded(hits(index, "abc OR section")) == rounded(hits(fresh, "abc OR section")) != {}


def rounded(found):
    return {i: (round(rank, 9), s) for i, (rank, s) in found.items()}


def test_a_change_rewrites_its_buckets_only(spark):
    index = fulltext.Index.build(of(spark, list(enumerate(texts(40, 1)))), folder(spark, "index"), 64)
    before = index.buckets_at
    later = index.put(of(spark, [(1000, ("zzz", ""))]))
    changed = {b for b, at in later.buckets_at.items() if at != before[b]}
    assert changed == {fulltext.bucket_of("zzz", 64)} and list(hits(later, "zzz")) == [1000]
    assert hits(index, "zzz") == {}  # a reader of the earlier state sees that
    assert fulltext.Index.open(spark, index.path).batch == later.batch


def test_a_search_opens_the_buckets_of_its_trigrams_only(spark, both):
    index, _ = both
    files = lambda grams: {r[0] for r in index.lists(grams).select(F.input_file_name()).distinct().collect()}
    assert all(f"bucket={fulltext.bucket_of('dee', 8)}" in f or not f for f in files(["dee"])) and len(files(["fox"])) < len(files(None))
    plan = index.lists(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(gram" in plan.replace("EqualTo(gram", "In(gram")


def test_an_empty_index_finds_nothing(spark):
    index = fulltext.Index.build(of(spark, [(1, ("a", "b"))]).filter("segment_id > 1"), folder(spark, "index"), 4)
    assert hits(index, "abc") == {} and index.n_rows == 0
    index = index.put(of(spark, [(1, ("abc", "b"))]))
    assert list(hits(index, "abc")) == [1]


def test_lists_are_written_straight_to_their_buckets(spark):
    """No exchange and no sort of postings, and one list for a trigram of many rows."""
    rows = spark.createDataFrame([(i, "", f"abcabc {i}") for i in range(500)], "row_no long, title string, body string").coalesce(1)
    made = fulltext._lists(rows, 8)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    abc = made.filter("gram = 'abc' AND field = 1")
    assert abc.count() == 1 and sorted((r.row_no, r.places) for r in fulltext._unlisted(abc).collect()) == [(i, [0, 3]) for i in range(500)]


def test_a_compact_index_holds_the_same_without_what_is_gone(spark):
    index = fulltext.Index.build(of(spark, list(enumerate(texts(40, 1)))), folder(spark, "index"), 8)
    index = index.put(of(spark, [(3, ("abc", "zzz"))])).remove(of(spark, [(5, ("", ""))]))
    before, found = lists(index), hits(index, "abc OR zzz")
    compact = index.compact()
    assert lists(compact) == before and hits(compact, "abc OR zzz") == found
    held = {n for r in compact.lists().collect() for n in r.rows}
    assert held <= {r.row_no for r in compact.rows.collect()} and not {r.row_no for r in index.gone.collect()} & held
    assert hits(index, "abc OR zzz") == found  # a reader of the earlier state sees that


def test_segments_keep_rows_with_equal_or_no_ids(spark, tmp_path):
    from leafmill.plans import views

    docs = [(1, "a", "src1"), (1, "b", "src1"), (1, "c", "src2"), (None, "d", "src1"), (None, "e", "src1"), (2, "f", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for books in (None, views.books(spark, str(tmp_path))):
        got = views.segments(spark, str(tmp_path), books).collect()
        assert sorted(r.raw_text for r in got) == list("abcdef") and {r.raw_text: r.summary_status for r in got} == dict(zip("abcdef", ["ready"] * 3 + ["pending"] * 2 + ["failed"], strict=True))
        assert sorted((r.book_id, r.idx) for r in got) == [("src1", i) for i in range(5)] + [("src2", 0)]
