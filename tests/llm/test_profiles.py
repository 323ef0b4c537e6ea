"""Language identification, fill-in-the-middle and the source audit: brute force, exact round trips, odd rows."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from leafmill.llm import fill_in_middle, language_id, registry, source_divergence  # noqa: E402

DATA = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")
LONG = "The quick brown fox jumps over the lazy dog, over and over again.\n" * 20000
#: Nulls, blanks, ties, repeated rows, marks inside a text, letters beyond ASCII and beyond the BMP, a null id.
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "12 + 3 = 15"), (5, "one"), (5, "one"), (6, "a<P>b"), (7, "<S<S>>"), (8, "<M"), (9, LONG), (10, "Ünï ©ode 😀 𝒳y, IT'S $1 \\1 wörds\r\n"),
    (None, "no id at all"), (11, "\0\0a\0"), (12, "x" * 70000), (13, "<P><S><M>"), (14, "ab cdİΣ"), *((i, f"row {i} of many, with <b>tags</b> & $2") for i in range(100, 160)),
]
CLASHING = ["n", "form", "output", "doc", "own", "score", "lang_pred", "item", "slice", "value", "a", "b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, None if i == 9 else "xx", "s" if t else None) for i, t in ROWS], "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit("?").alias(x) for x in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    return c


def same_as_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    sql = duck.sql(registry.ORACLES[name])
    assert columns == sorted(sql.columns)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    return len(got)


# 12 fill in the middle


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    if h4 % 100 < 20:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_fill_in_middle_query(spark, duck):
    assert same_as_sql(spark, duck, "op12_fill_in_middle") == duck.sql("select count(*) from documents").fetchall()[0][0]


def test_fill_in_middle_of_odd_rows(spark, odd):
    cut = fill_in_middle.transform(odd).withColumn("restored", fill_in_middle.restore(F.col("output"), F.col("form")))
    assert set(CLASHING) <= set(cut.select("doc.*").columns)
    got = sorted((tuple(r) for r in cut.select("doc.doc_id", "doc.text", "n", "form", "output", "prefix_chars", "middle_chars", "restored").collect()), key=repr)
    assert got == sorted(((i, t, *cut_by_hand(i, t), t or "") for i, t in ROWS), key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(odd.filter("doc_id < 0")).count() == 0


def test_fill_in_middle_shares_are_parameters(spark, odd):
    forms = lambda **k: {r.form for r in fill_in_middle.transform(odd.filter("doc_id >= 100"), **k).select("form").collect()}
    assert forms(cut_percent=0) == {"plain"} and forms(cut_percent=100, suffix_first_percent=100) == {"spm"} and forms(cut_percent=100, suffix_first_percent=0) == {"psm"}


# 13 source divergence


def audit_by_hand(rows, threshold, ranks=50):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups.add((lang, source))
        held[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= threshold]
        sources = [g[1] for g in groups if g[0] == lang]
        shares = {}
        for s in [*sources, None]:
            n = {t: sum(held[lang, x][t] for x in ([s] if s is not None else sources)) for t in kept}
            total = sum(n.values())
            shares[s] = {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [("pair", o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in sources if o != s]
            over = [("term", t, shares[s][t] - shares[None][t]) for t in kept if held[lang, s][t] and shares[s][t] > shares[None][t]]
            for found in (pairs, over):
                found = sorted(found, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, i + 1) for i, x in enumerate(found) if x[0] == "pair" or i < ranks]
    return sorted(out)


def audited(docs, *args, **kw):
    return sorted(tuple(r) for r in source_divergence.audit(docs, *args, **kw).collect())


def test_source_divergence_query(spark, duck):
    assert same_as_sql(spark, duck, "op13_source_divergence")


@pytest.mark.parametrize(("tile_terms", "tile_sources"), [(1024, 128), (3, 2)])
def test_source_divergence_of_random_rows(spark, tile_terms, tile_sources):
    rng = np.random.default_rng(7)
    words = ["a", "abc", "abcd", "abcde", "Abcdefgh", "abcdefghi", "x" * 40, "x" * 300, "x" * 300 + "y", "ß", "straße", "日本語", "éa", "zz", "q", "rare"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s4", "s5", None]), None if rng.random() < 0.1 else " ".join(rng.choice(words, rng.integers(0, 9)))) for _ in range(400)]
    rows += [("fr", "only", "1 2 3"), ("fr", "other", None), ("it", "one", "abc")] + [("en", "s1", "same same")] * 40
    rows = [(*(None if x is None else str(x) for x in r),) for r in rows]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("item", F.lit(1)).repartition(5)
    got = audited(docs, 12, 3, tile_terms, tile_sources)
    assert got == audit_by_hand(rows, 12, 3)
    assert {r[3] for r in got if r[2] == "term"} and ("fr", "only", "pair", "other", 0, 1) in got


def test_source_divergence_of_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert audited(odd, 5) == audit_by_hand(rows, 5)
    assert audited(odd.filter("doc_id < 0")) == []
    nothing = spark.createDataFrame([("en", "a", None), ("en", "b", ""), ("de", "a", "x")], "lang string, source string, text string")
    assert audited(nothing) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_rare_prefixes_go_no_further(spark):
    """The terms of a rare prefix never reach the second level, those of a frequent one do."""
    rows = [("en", "s", f"common{'xyz'[i % 3] * 9} seldom{i}") for i in range(40)] + [("en", "s", f"{chr(97 + i % 26)}{chr(97 + i // 26)}rarebeginning") for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    kept, levels = source_divergence.kept_terms(docs, 10)
    assert sorted(bytes(r.item).rstrip(b"\0") for r in kept.collect()) == [b"common" + x * 9 for x in (b"x", b"y", b"z")] + [b"seldom"]
    assert levels == [4, 8, 16]


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 7, 10**10, 3 * 10**12])
    assert source_divergence.share(n, 10**15, 77).tolist() == [1 + 10**9 * (k + 5) // (10**15 + 5 * 77) for k in n.tolist()]


# 11 language identification


def by_hand(text, dimensions=language_id.DIMENSIONS):
    """The bundle of a text, n-gram by n-gram."""
    symbols = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
    vector = lambda c: language_id.symbol_vectors(np.array([c]), dimensions)[0].astype(int)
    grams = Counter((a, b, c) for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False) if (a or b) and (b or c))
    out = np.zeros(dimensions, int)
    for (a, b, c), n in grams.items():
        out += n * (np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c))
    return out, sum(grams.values())


def test_bundles_are_sums_of_bound_vectors(monkeypatch):
    texts = ["a", "Hello, hello  world!", "straße 12 été", "日本語のテキスト", "", "...", "x" * 50, "The end.\n" * 9]
    whole = [by_hand(t) for t in texts]
    for chars, numbered in ((1 << 19, 1 << 24), (7, 1 << 24), (7, 0)):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", chars)
        monkeypatch.setattr(language_id, "TABLE", numbered)
        sums, counts = np.zeros((len(texts), language_id.DIMENSIONS), int), np.zeros(len(texts), int)
        for block in language_id.blocks(iter(enumerate(texts))):
            made, n = language_id.bundles(block, len(texts))
            sums += made
            counts += n.astype(int)
        assert (sums == [v for v, _ in whole]).all() and counts.tolist() == [n for _, n in whole]


def test_symbol_vectors_are_nearly_orthogonal():
    v = language_id.symbol_vectors(np.array([0, *range(97, 123), 0x4E00, 0x1D4B3]), language_id.DIMENSIONS).astype(int)
    cosines = np.abs(v @ v.T / language_id.DIMENSIONS - np.eye(len(v)))
    assert cosines.max() < 0.15


def test_language_query_by_hand(spark):
    rows = duckdb.sql(f"select doc_id, text, lang from '{DATA}/documents.parquet'").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    made = {i: by_hand(t)[0] for i, t, _ in rows}
    profiles = defaultdict(int)
    for i, _, lang in rows:
        if not held[i]:
            profiles[lang] = profiles[lang] + made[i]
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)
    got = {r.doc_id: r for r in registry.QUERIES["op11_language_id"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = max((cos(made[i].astype(float), p.astype(float)), lang) for lang, p in profiles.items())
        assert got[i].held_out == held[i] and got[i].lang_pred == want[1] and abs(got[i].score - max(0, want[0])) < 1e-9


def test_held_out_accuracy(spark):
    data = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.01")
    lang = dict(duckdb.sql(f"select doc_id, lang from '{data}/documents.parquet'").fetchall())
    found = [r for r in registry.QUERIES["op11_language_id"](spark, data).collect() if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in found)
    assert right >= 0.97 * len(found), (right, len(found))


def test_language_of_odd_rows(spark, odd, monkeypatch):
    known = spark.createDataFrame([(t, lang) for lang, ts in {"en": ["the quick brown fox and the lazy dog", "over and over"], "de": ["der schnelle braune Fuchs und das Ding"], None: ["nothing"], "fr": [None]}.items() for t in ts], "text string, lang string")
    profiles = language_id.learn(known)
    assert {r.lang for r in profiles.collect()} == {"en", "de"}
    judged = language_id.predict(odd, profiles)
    assert set(CLASHING) - {"score", "lang_pred"} <= set(judged.columns)
    got = {r.doc_id: r for r in judged.collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4)) and got[9].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert got[6].lang_pred != "und" and judged.count() == len(ROWS)
    monkeypatch.setattr(language_id, "BLOCK_LANGS", 1)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(odd, profiles).collect()} == {i: r.lang_pred for i, r in got.items()}
    assert {r.lang_pred for r in language_id.predict(odd, profiles.filter("lang = 'xx'")).collect()} == {"und"}
    assert language_id.predict(odd.filter("doc_id < 0"), profiles).count() == 0 and language_id.learn(known.filter("lang = 'zz'")).count() == 0
