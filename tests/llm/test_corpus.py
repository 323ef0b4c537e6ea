"""Each corpus query against brute force on the smallest tables, and edge cases of each operator."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from leafmill.llm import common, components, decontamination, katz, mixing, near_dedup, personal_data, quality_classifier, quality_rules, registry, token_counts, token_output, url_filters  # noqa: E402

DATA = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")
LONG = "The quick brown fox jumps over the lazy dog near the old river bank " * 8000
#: Nulls, blanks, ties, repeated rows, a null id, a very long text; the other columns have names that operators use inside.
ROWS = [
    (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (10, "One two"), (10, "One two"), (11, LONG), (12, LONG + "end"),
    (None, "a text of its own without any id at all"), (13, "Ünï ©ode 😀 wörds, IT'S  double  spaced<|endoftext|>\n\n x"), (3, "a text of its own without any id at all"),
]
CLASHING = ["n_words", "kept", "key", "node", "bucket", "mark", "root", "copies", "doc", "mix", "size", "image", "part", "row", "m", "base", "score"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, "s" if t else None) for i, t in ROWS], "doc_id long, text string, source string")
    return rows.select("*", *[F.lit(x).alias(x) for x in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("doc_id < 0")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()


def run(spark, name, data=DATA):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, data).collect())


# 1 token output


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path(token_output.VOCABULARY))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_output_is_the_librarys(spark, docs):
    expected, start = [], 0
    for (i, _), ids in zip(docs, reference_ids([t for _, t in docs]), strict=True):
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert run(spark, "op1_token_output") == expected


def test_token_output_of_odd_rows(spark, odd, empty):
    got = token_output.read_blocks(token_output.write_blocks(odd, block_ids=50)).orderBy("start").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order] and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    want = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in reference_ids([t for _, t in ROWS]))
    assert sorted(r.ids_crc32 for r in got) == want
    assert token_output.read_blocks(token_output.write_blocks(empty)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 1000, 1000, 10**12], list(range(0, 5000, 3)), [2**40 + i * i for i in range(500)]])
def test_elias_fano(values):
    code = token_output.EliasFano.of(np.array(values, np.uint64))
    assert code.values().tolist() == values and [code.select(i) for i in range(len(values))] == values
    if values:
        opened, ids = token_output.open_image(token_output.image(np.array(values), np.array([7, 8], "<u2")))
        assert opened.values().tolist() == values and ids.tolist() == [7, 8]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10000))
    code = token_output.EliasFano.of(ends)
    assert (code.low.nbytes + code.upper.nbytes + code.samples.nbytes) * 8 / 10000 < 14  # 64 in a plain table


# 2 token counts


def test_token_counts_are_the_librarys(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.VOCABULARY))
    count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert run(spark, "op2_token_counts") == [(i, len(x.encode()), n := count(x), n > 1024) for i, x in docs]
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd).collect())
    assert got == sorted((len((x or "").encode()), count(x)) for _, x in ROWS)
    assert token_counts.token_counts(empty).count() == 0


def test_token_counts_of_random_texts():
    from tokenizers import Tokenizer

    c = token_counts.counter(token_counts.tokenizer_path(token_counts.VOCABULARY))
    t: Tokenizer = c.tokenizer
    rng = np.random.default_rng(3)
    letters = list("ab'stZé漢 \n\t\u00a0\u2003\u0085\u001c1٣!?<|endoftext|>") + ["<|endoftext|>", "'ll", "  ", " \n "]
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(1, 30)))
        assert c.total(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_tokens_are_proved():
    c = token_counts.counter(token_counts.tokenizer_path(token_counts.VOCABULARY))
    assert len(c.whole) > 40_000
    for x in sorted(c.whole)[::500]:
        assert c.merged(x) == 1


# 3 quality rules


def test_quality_measures(spark, docs, odd, empty):
    assert [r[:7] for r in run(spark, "op3_quality_rules")] == [(i, *brute.quality(x)) for i, x in docs]
    got = [(tuple(r.m)[:5], r.base_failed) for r in quality_rules.annotate(odd).collect()]
    assert sorted(got) == sorted((brute.quality(x)[:5], brute.quality(x)[5]) for _, x in ROWS)
    assert quality_rules.annotate(empty).count() == 0 and quality_rules.keep(odd).columns == odd.columns


def test_quality_verdicts(spark):
    good = "The house by the river was old and it had a garden that no one cared for. " + " ".join(f"Then word{i} came to the town." for i in range(20))
    bad = {"symbols": " ".join(f"w{i}%%% the" for i in range(40)), "repeated_words": "buy it now and save a lot today friend " * 20, "length": "too short", "stop_words": " ".join(f"zorb{i}" for i in range(60)), "upper_case": good.upper()}
    rows = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in quality_rules.annotate(rows).collect()}
    assert got["good"].kept and all(k in got[k].broken_rules and not got[k].kept for k in bad)
    assert [r.doc_id for r in quality_rules.keep(rows).collect()] == ["good"]


# 4 near-duplicates


def test_near_dedup_query(spark, docs):
    found = brute.groups([t for _, t in docs], 2)
    assert run(spark, "op4_near_dedup") == [(i, n, docs[g][0], docs[g][0] == i) for (i, _), (n, g) in zip(docs, found, strict=True)]


def family(rng, size, edits):
    base = [f"w{rng.integers(1000)}" for _ in range(60)]
    out = []
    for _ in range(size):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, edits)):
            w[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_of_families(spark):
    """Groups around the threshold, with turns of pivots and the metric's exclusions."""
    rng = np.random.default_rng(5)
    texts = [t for edits in (2, 4, 7, 12) for t in family(rng, 60, edits)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = [(i, n, g) for i, (n, g) in enumerate(brute.groups(texts, 2))]
    rest = near_dedup.REST
    try:
        for near_dedup.REST in (rest, 0):
            got = near_dedup.annotate(rows, shingle=2).select("doc_id", "n_shingles", "component_id").collect()
            assert sorted(map(tuple, got)) == expected
    finally:
        near_dedup.REST = rest


def test_near_dedup_of_a_large_family(spark):
    """Two thousand texts about one, half of them beyond the threshold; some have copies near them but not near the one."""
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(1000)}" for _ in range(80)]
    texts = []
    for k in range(2000):
        w = list(base)
        for at in rng.choice(80, rng.integers(1, 20), replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
        if k % 50 == 0:
            texts.append(" ".join([*w[:-1], "end"]))
    expected = [(i, n, g) for i, (n, g) in enumerate(brute.groups(texts, 2))]
    got = near_dedup.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), shingle=2).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == expected and len({g for *_, g in expected}) > 300


def test_near_dedup_of_clashing_columns_and_null_ids(spark, odd):
    found = near_dedup.annotate(odd.withColumn("mark", F.lit(1)).withColumn("n_shingles", F.lit("mine")), shingle=2)
    assert len(set(found.columns)) == len(found.columns) and dict(found.dtypes)["n_shingles"] == "bigint"
    assert found.count() == len(ROWS) and {r.node for r in found.select("node").collect()} == {"node"}
    rng = np.random.default_rng(4)
    rows = [(None, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 12))) for _ in range(300)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    assert near_dedup.keep(docs, shingle=2).count() == 300
    nodes = near_dedup.annotate(docs, shingle=2)
    assert nodes.count() == 350 and nodes.select("root").distinct().count() == 300


def test_near_dedup_of_odd_rows(spark, odd, empty):
    got = near_dedup.annotate(odd.select("doc_id", "text"), shingle=2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[5].kept and by[6].kept and by[7].n_shingles == 0
    assert by[9].component_id == 8 and not by[9].kept and by[12].component_id == 11 and by[None].component_id == 3
    kept = near_dedup.keep(odd, shingle=2)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [3, 5, 6, 7, 8, 10, 11, 13]
    assert near_dedup.annotate(empty.select("doc_id", "text")).count() == 0 and near_dedup.keep(empty).count() == 0


def test_near_dedup_keeps_unrelated_rows_with_equal_ids(spark):
    rng = np.random.default_rng(11)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(45)]
    rows = [(None, t) for t in own[:40]] + [(None, own[0]), (7, own[40]), (7, own[41]), (7, own[41] + " more"), (2, own[42]), (None, own[42]), (7, own[43]), (9, own[43]), (9, own[44])]
    kept = near_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=2).collect()
    of = lambda i: sorted(r.text for r in kept if r.doc_id == i)
    assert of(None) == sorted(own[:40]) and of(2) == [own[42]] and of(9) == [own[44]]
    assert len(kept) == 45 and len(of(7)) == 3 and {own[40], own[43]} < {*of(7)}


def test_odd_sketches_tell_similarity(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        a, b = rng.integers(0, 2**63, 300, np.uint64), rng.integers(0, 2**63, 300, np.uint64)
        x, y = np.unique(a), np.unique(np.concatenate([a[: 300 - k], b[:k]]))
        rows.append((k, (300 - k) / (300 + k), *(near_dedup.odd_sketch(near_dedup.samples(s)).tolist() for s in (x, y))))
    df = spark.createDataFrame(rows, "k int, true double, a array<long>, b array<long>")
    got = df.select("true", near_dedup.similarity(F.col("a"), F.col("b")).alias("told"), near_dedup.differing(F.col("a"), F.col("b")).alias("bits")).collect()
    assert np.mean([abs(r.true - r.told) for r in got]) < 0.03 and max(r.bits for r in got if r.true >= 0.8) <= near_dedup.bound(80)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (20, 21)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    path = spark.range(40).select((F.col("id") * 7 % 41).alias("a"), ((F.col("id") + 1) * 7 % 41).alias("b"))
    assert {r.root for r in components.components(path).collect()} == {0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 url filters


def judged(url, rules=url_filters.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(brute.LOWER)
    fits = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_url_query(spark):
    urls = dict(duckdb.sql(f"select page_id, url from '{DATA}/pages.parquet'").fetchall())
    got = registry.QUERIES["op5_url_filters"](spark, DATA).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        host, path, rule = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name) and (rule is None or r.verdict == rule.verdict)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/x?y=://z#q", "http://a.example.com/en/", "http://www.example.com/en/a", "http://net/es/", "http://xnet/es/", "http://a.com", "http://a.com/", "x://b.net/fr/?a=1", "x://b.net/fr/?a=1", "http://exa\nmple.com/a"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    for r in url_filters.judge(rows).collect():
        host, path, rule = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else "block" if r.confidence else "allow")
    assert url_filters.judge(rows.filter("page_id < 0")).count() == 0


def url_tokens(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path, _ = judged(url)
    found = {"h:" + x for x in re.split("[.-]", host)} | {"p:" + re.sub("[0-9]+", "0", x) for x in path.translate(brute.LOWER).split("/")}
    return {x for x in found | {"q:" + x.translate(brute.LOWER) for x in re.findall("[?&]([^=&#]+)", rest)} if len(x) > 2}


def mined(labelled):
    """The shortest rules of labelled(tokens, is bad), by counting all subsets."""
    n = len(labelled)
    least = math.ceil(max(url_filters.SUPPORT, url_filters.SUPPORT_ROWS / n) * n - 1e-9)
    common = set.intersection(*(set(t) for t, _ in labelled))
    seen, hit = Counter(), Counter()
    for t, bad in labelled:
        t = sorted(t - common)
        for k in range(1, len(t) + 1):
            for x in combinations(t, k):
                seen[x] += 1
                hit[x] += bad
    base = sum(bad for _, bad in labelled) / n
    good = {x for x, k in hit.items() if k >= least and k / seen[x] >= url_filters.CONFIDENCE and k / seen[x] / base >= url_filters.LIFT}
    return {x for x in good if not any(y in good for k in range(1, len(x)) for y in combinations(x, k))}


def test_mined_verdicts_by_brute_force(spark):
    data = DATA.replace("0.001", "0.01")
    urls = dict(duckdb.sql(f"select page_id, url from '{data}/pages.parquet'").fetchall())
    labelled = [(url_tokens(u), rule.verdict == "block") for u in urls.values() if (rule := judged(u)[2])]
    rules = mined(labelled)
    got = {r.page_id: r.verdict for r in registry.QUERIES["op5_url_filters"](spark, data).collect()}
    unlisted = [i for i, u in urls.items() if not judged(u)[2]]
    expected = {i: "block" if any(t.issuperset(x) for x in rules) else "allow" for i in unlisted for t in (url_tokens(urls[i]),)}
    assert {i: got[i] for i in unlisted} == expected
    assert {"allow", "block"} == set(expected.values())
    # rules of four fifths of the labelled urls, against the rest
    part = [zlib.crc32(" ".join(sorted(t)).encode()) % 5 == 0 for t, _ in labelled]
    rules = mined([x for x, out in zip(labelled, part, strict=True) if not out])
    blocked = [bad for (t, bad), out in zip(labelled, part, strict=True) if out and any(t.issuperset(x) for x in rules)]
    assert len(blocked) >= 10 and sum(blocked) / len(blocked) >= 0.9


def test_mined_rules_match_whole_token_sets(spark):
    labelled = [(["h:spam", "p:win"], "block")] * 30 + [(["h:spam", "p:about"], "allow")] * 30 + [(["h:ok", "p:win"], "allow")] * 30 + [(["h:spam", "p:new"], None)] * 90
    labelled += [(["h:spam", "p:win", "q:a"], "block")] * 30
    rules, names = url_filters.mine(spark.createDataFrame(labelled, "tokens array<string>, verdict string"))
    assert [r.tokens for r in rules.orderBy("tokens").collect()] == [["h:spam", "p:win"], ["q:a"]]
    sets = spark.createDataFrame([(["a", "h:spam", "p:win"],), (["h:spam"],), ([],)], "tokens array<string>")
    assert [r.tokens for r in url_filters.matches(sets, rules, names).collect()] == [["a", "h:spam", "p:win"]]


def test_long_templates_are_mined_by_class(spark):
    """Forty parts that blocked urls share, half of them with allowed ones: two to the forty combinations, but few classes; any part stands for its class."""
    ours, both = [f"p:x{i}" for i in range(20)], [f"p:y{i}" for i in range(20)]
    labelled = [([*ours, *both], "block")] * 60 + [(both, "allow")] * 60 + [(["p:z"], "allow")] * 9 + [([*both, "q:w", "q:v"], "block")] * 20 + [(["q:w", "q:v"], "allow")] * 40
    frame = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    rules, names = url_filters.mine(frame)
    assert [r.tokens for r in rules.orderBy("tokens").collect()] == [["p:x0"], ["p:y0", "q:v"]]
    sets = spark.createDataFrame([(["p:x7"],), (["p:y3"],), (["p:y3", "q:w"],), (["p:y9", "q:v"],), (["p:z"],), (["q:w"],)], "tokens array<string>")
    assert sorted(r.tokens for r in url_filters.matches(sets, rules, names).collect()) == [["p:x7"], ["p:y3", "q:w"], ["p:y9", "q:v"]]
    by_hand = mined([({"p:x0", "p:x1", *(["p:y0", "p:y1"])} if "p:x0" in t else {x for x in t if x in ("p:y0", "p:y1", "q:v", "q:w", "p:z")}, v == "block") for t, v in labelled])
    assert by_hand == {("p:x0",), ("p:x1",), ("p:y0", "q:v"), ("p:y0", "q:w"), ("p:y1", "q:v"), ("p:y1", "q:w")}


def test_a_very_long_url_is_judged(spark):
    long = "http://a.net/es/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    urls = [long] * 40 + ["http://b.org/x"] * 40 + ["http://c.com/y"] * 40
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge(rows).groupBy("host", "verdict").count().collect()
    assert sorted(tuple(r) for r in got) == [("a.net", "block", 40), ("b.org", "allow", 40), ("c.com", "allow", 40)]


# 6 personal data


def test_personal_data_query(spark, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op6_personal_data"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, x in docs:
        found = brute.personal(x)
        written = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
        counts = [sum(n == k for *_, n in found) for k in ("email", "ip", "card", "phone")]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest() and set(written.split(",")) <= {*got[i].spans.split(","), ""}


def test_odd_personal_data(spark, odd, empty):
    texts = [
        "a@b.c_d@e.f", "a@b@c.d.e", "x@y", "@" * 50, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1.2.3", "+1 (((((", "1" * 5000, "1 2 " * 5000, "+1 555 123 4567-", "4111 1111 1111 1111 x 4111-1111-1111-1111  4111",
        "é@x.y 😀 +49 (0) 30 1234567 b@c.de", " ".join(f"1.2.3.{i % 300}" for i in range(900)), "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in personal_data.annotate(rows).select("doc_id", personal_data.written(F.col("base")).alias("b")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == ",".join(f"{n}:{a}:{b}" for a, _, b, n in brute.personal(x)), x
    assert personal_data.annotate(odd).count() == len(ROWS) and personal_data.annotate(empty).count() == 0


def test_weak_spans(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f'so the token = "{key}" was here') for i in range(30)] + [(100, "write to jo (at) host (dot) com"), (101, "plain words only"), (102, f"a@b.{key}")]
    got = {r.doc_id: r.s for r in personal_data.annotate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", personal_data.written(F.col("spans")).alias("s")).collect()}
    assert got[3] == f"secret:16:{16 + len(key)}" and got[101] == "" and got[102].startswith("email:0:") and "secret" not in got[102]


def logistic(x, y, w, reg=1e-3):
    """Weighted logistic regression by Newton's method; the intercept, last, isn't held down."""
    x, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    w, held = w / w.sum(), np.append(np.full(x.shape[1] - 1, reg), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(held + 1e-12), x.T @ (w * (p - y)) + held * beta)
        beta -= step
    return beta


def spans_by_hand(docs):
    """Added spans of docs(id, text), with re, plain expectation-maximisation and numpy."""
    import xxhash

    first = len(personal_data.BASE)
    rows = []
    for i, text in docs:
        for k, w in enumerate(personal_data.WEAK):
            found = list(re.finditer(w.pattern, text or ""))
            ends = [0, *(m.end() for m in found)]
            for at, m in enumerate(found):
                before, after = text[ends[at] : m.start()][-40:], text[m.end() : found[at + 1].start() if at + 1 < len(found) else None][:40]
                votes = {"strict": 1 if re.search(w.strict, m[0]) else -1, "listed": 1 if re.search(w.listed, m[0]) else -1, "context": int(bool(re.search(w.cues, before)))}
                n, f, base = len(m[0]), [k], len(personal_data.WEAK)
                counts = (sum(c in "0123456789" for c in m[0]), sum("A" <= c <= "Z" for c in m[0]), len(set(m[0])))
                for size, v in zip(personal_data.SHAPES, (int(math.log2(n)), *(4 * c // n for c in counts)), strict=True):
                    f.append(base + k * size + min(v, size - 1))
                    base += len(personal_data.WEAK) * size
                sides = re.search(r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*\Z", before)[1], re.match(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", after)[1]
                for word in sides:
                    f.append(base + xxhash.xxh64_intdigest(word.translate(brute.LOWER), seed=42) % personal_data.WORD_BUCKETS)
                    base += personal_data.WORD_BUCKETS
                rows.append((i, m.start(), first + k, m.end(), votes, f))
    assert 0 < len(rows) <= personal_data.SAMPLE_ROWS
    x, p = np.zeros((len(rows), personal_data.N_FEATURES)), np.zeros(len(rows))
    for at, r in enumerate(rows):
        x[at, r[5]] = 1
    for kind in {r[2] for r in rows}:
        mine = [at for at, r in enumerate(rows) if r[2] == kind]
        v = np.array([[rows[at][4][n] for n in personal_data.VOTES] for at in mine])
        prior, right, q = 0.5, np.array([[0.8] * 3, [0.2] * 3]), None
        for turn in range(personal_data.ROUNDS + 1):
            like = np.where(v[:, None] > 0, right, np.where(v[:, None] < 0, 1 - right, 1)).prod(axis=2)
            q = prior * like[:, 0] / (prior * like[:, 0] + (1 - prior) * like[:, 1])
            if turn < personal_data.ROUNDS:
                prior = min(max((q.sum() + 1) / (len(q) + 2), 0.01), 0.99)
                yes = np.array([((s[:, None] * (v > 0)).sum(0) + k) / ((s[:, None] * (v != 0)).sum(0) + 5) for s, k in ((q, 4), (1 - q, 1))])
                right = np.array([np.clip(yes[0], 0.5, 0.99), np.maximum(np.minimum(np.minimum(yes[1], 0.5), yes[0]), 0.01)])
        p[mine] = q
    beta = logistic(np.vstack([x, x]), np.repeat([1.0, 0.0], len(p)), np.concatenate([p, 1 - p]))
    out = {}
    for r, score in zip(rows, x @ beta[:-1] + beta[-1], strict=True):
        if score > 0:
            out.setdefault(r[0], []).append(r[1:4])
    for i, text in docs:
        base, taken = brute.personal(text), []
        for a, kind, b in sorted(out.get(i, [])):
            if not any(x < b and a < y for x, _, y, _ in base) and (not taken or a >= taken[-1][2]):
                taken.append((a, kind, b))
        out[i] = taken
    return out


def planted():
    """Texts with true and false spans of each weak kind."""
    rng = np.random.default_rng(3)
    digit = lambda n: "".join(rng.choice([*"0123456789"], n))
    texts = []
    for i in range(60):
        texts += [
            f'the token = "{rng.bytes(20).hex()}" was used', f"write to user{i} (at) host{i} (dot) com today", f"social security number 1{digit(2)}-2{digit(1)}-3{digit(3)} on file",
            f"iban DE{digit(2)} {digit(4)} {digit(4)} {digit(4)} {digit(4)} {digit(2)} of the account", f"please call (2{digit(2)}) 5{digit(2)}-{digit(4)} now",
            f"a part number 9{digit(2)}-00-{digit(4)} in stock", f"see chapter_{'abcdefgh' * 3}_{'ij' * (i % 5)} there", f"meet [at] noon {i}", f"serial 0{digit(2)}.1{digit(2)}.{digit(4)} of it",
        ]
    return list(enumerate(texts))


def test_added_spans_by_brute_force(spark):
    docs = planted() + [(10**6, "k" + "aB3x9" * 2000 + " key"), (10**6 + 1, None), (10**6 + 2, "api_key=aB3" + "dE5f" * 6 + " sk-proj-Ab12cd34Ef56gh78IJ90")]
    expected = spans_by_hand(docs)
    got = {r.doc_id: [tuple(s) for s in r.spans if s not in r.base] for r in personal_data.annotate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == expected
    kinds = Counter(personal_data.NAMES[k] for i in range(540) for _, k, _ in got[i])
    true = Counter(personal_data.NAMES[k] for i in range(540) if i % 9 < 5 for _, k, _ in got[i])
    assert all(true[w.name] >= 55 for w in personal_data.WEAK) and sum(kinds.values()) - sum(true.values()) <= 20, (kinds, true)
    assert got[10**6] == [(0, personal_data.NAMES.index("secret"), 10001)] and len(got[10**6 + 2]) == 2


# 7 decontamination


def test_decontamination_query(spark, docs):
    found = brute.windows(duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall())
    expected = []
    for i, x in docs:
        n, hit, items = brute.hits(x, found)
        expected.append((i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert run(spark, "op7_decontamination") == expected


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_CHARS, 0])
def test_decontamination_cases(spark, odd, empty, limit):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([1, 3, 7, 12, 13, 14, 30, 60])] + [(50, None), (51, "..."), (52, "same " * 40), (52, "Other text of item fifty two")]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(20)] + [items[6][1].upper(), "pre " + items[7][1] + " post", "same " * 100, items[7][1][:-1], " ".join(items[7][1].split()[3:20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + k, t) for k, (_, t) in enumerate(ROWS)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = brute.windows(items)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.annotate(table, bench, broadcast_chars=limit).collect()}
    assert got == {i: brute.hits(t, found) for i, t in rows}
    kept = decontamination.keep(odd, bench, broadcast_chars=limit)
    assert kept.columns == odd.columns and kept.count() == sum(not (h > 0 and 20 * h >= n) for n, h, _ in (brute.hits(t, found) for _, t in ROWS))
    none = decontamination.annotate(table, bench.filter("item_id < 0"), broadcast_chars=limit)
    assert none.count() == len(rows) and none.filter("n_hit > 0").count() == 0
    assert decontamination.annotate(empty, bench, broadcast_chars=limit).count() == 0


# 8 quality classifier


def test_quality_classifier_agrees_with_unseen_labels(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = registry.QUERIES["op8_quality_classifier"](spark, data).join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in got if r.quality == 1]
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.9 and sum(good) / len(good) > 0.97


def test_quality_classifier_of_odd_rows(spark, odd, empty):
    got = quality_classifier.annotate(odd).collect()
    assert len(got) == len(ROWS) and {r.score for r in got if r.doc_id in (5, 6, 7)} == {0.0}
    assert quality_classifier.annotate(empty).count() == 0


def test_em_finds_the_worse_labeller(spark):
    rng = np.random.default_rng(1)
    truth = np.where(rng.random(4000) < 0.7, 1, -1)
    votes = {v: np.where(rng.random(4000) < q, truth, -truth) for v, q in (("a", 0.95), ("b", 0.9), ("c", 0.6))}
    rows = spark.createDataFrame([tuple(int(x) for x in r) for r in zip(*votes.values(), strict=True)], "a int, b int, c int").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    right, _ = quality_classifier.em(rows, ["a", "b", "c"])
    assert right["a"] > right["c"] + 0.15 and right["b"] > right["c"] + 0.1


def test_weak_labels_by_brute_force(spark):
    """Posteriors by plain expectation-maximisation over all rows; scores by a logistic regression fitted apart."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in quality_classifier.annotate(docs).collect()}
    m = F.col("m")
    votes = quality_classifier.labellers(m)
    rows = quality_rules.annotate(docs, ()).select("doc_id", m["n_words"].alias("n"), *[x.alias(k) for k, x in votes.items()]).collect()
    used = [r for r in rows if r.n > 0]
    v = np.array([[r[k] for k in votes] for r in used])
    prior, right = 0.8, np.full((2, v.shape[1]), 0.8)  # right: how often a labeller votes good of the good, bad of the bad
    for turn in range(quality_classifier.ROUNDS + 1):
        good = np.where(v > 0, right[0], np.where(v < 0, 1 - right[0], 1)).prod(axis=1) * prior
        bad = np.where(v < 0, right[1], np.where(v > 0, 1 - right[1], 1)).prod(axis=1) * (1 - prior)
        p = good / (good + bad)
        if turn < quality_classifier.ROUNDS:
            prior = min(max((p.sum() + 1) / (len(p) + 2), 0.05), 0.95)
            for k, (q, sign) in enumerate(((p, 1), (1 - p, -1))):
                hit, of = (q[:, None] * (v == sign)).sum(0), (q[:, None] * (v != 0)).sum(0)
                right[k] = np.clip((hit + 4) / (of + 5), 0.55, 0.99)
    for r, x in zip(used, p, strict=True):
        assert got[r.doc_id].weak_label == pytest.approx(x, rel=1e-6, abs=1e-9)
    assert all((r.score >= quality_classifier.LEAST) == r.kept for r in got.values())
    words = docs.select("doc_id", quality_classifier.features_of(F.col("text")).alias("t")).collect()
    seen = {w: k for k, w in enumerate(sorted({w for r in words for w in r.t}))}
    x = np.zeros((len(words), len(seen)), np.float32)
    for k, r in enumerate(words):
        x[k, [seen[w] for w in r.t]] = 1
    label = np.array([got[r.doc_id].weak_label for r in words])
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(2000):  # plain gradient steps
        e = 1 / (1 + np.exp(-(x @ w + b))) - label
        w, b = w - 0.02 * (x.T @ e / len(x) + 1e-3 * w), b - 0.02 * e.mean()
    mine = 1 / (1 + np.exp(-(x @ w + b)))
    agree = np.mean([(a >= 0.5) == (got[r.doc_id].score >= 0.5) for a, r in zip(mine, words, strict=True)])
    assert agree >= 0.95


# 9 mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Water is poured by weight until no source is over its limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 5, None: 3}, {"é": 7, "z": 9, "A": 0, "": 4}, {"x": 0}, {"only": 50}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == {s: pytest.approx(t) for s, t in filled(sizes).items()}


def test_mixing_query(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert run(spark, "op9_mixing") == sorted(c.sql(mixing.SQL).fetchall())


def test_mixing_of_odd_rows(spark, odd, empty):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.filter("source IS NULL").count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(odd.repartition(2)).collect()))
    assert mixing.mix(empty).count() == 0


def test_taken_comes_near_the_target(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 5000, "b").otherwise("c").alias("source"))
    target = {r.source: r.target for r in mixing.plan(rows).collect()}
    taken = {r.source: r["count"] * 5 for r in mixing.mix(rows).groupBy("source").count().collect()}
    assert all(taken[s] == pytest.approx(t, rel=0.05) for s, t in target.items())


def test_null_and_repeated_ids_draw_for_themselves(spark):
    """Rows that can't be told apart, or have no id, still come near their target together; blank ones are never taken."""
    text = F.when(F.col("id") % 2 == 0, "the same words again").otherwise(F.concat(F.lit("row "), F.col("id"), F.lit(" of many")))
    rows = spark.range(8000).select(F.when(F.col("id") % 3 == 0, 7).cast("long").alias("doc_id"), text.alias("text"), F.when(F.col("id") < 6000, "a").when(F.col("id") < 7000, "b").otherwise("c").alias("source"), F.lit(1).alias("key"), F.lit(2).alias("nth"))
    rows = rows.unionByName(rows.limit(50).withColumn("text", F.lit(" \t")))
    target = {r.source: r.target for r in mixing.plan(rows).collect()}
    for parts in (2, 5):
        mixed = mixing.mix(rows.repartition(parts))
        taken = {r.source: r["count"] * 4 for r in mixed.groupBy("source").count().collect()}
        assert all(taken[s] == pytest.approx(t, rel=0.05) for s, t in target.items()), (taken, target)
        assert mixed.filter("trim(text) = '\t'").count() == 0
        counts = sorted((str(r[:3]), r["count"]) for r in mixed.groupBy("doc_id", "text", "source").count().collect())
        assert parts == 2 or counts == before
        before = counts


# 10 Katz


def tokens(text):
    return [*brute.find_words(brute.lower(text)), 0]


@pytest.mark.parametrize(("block", "hot"), [(katz.BLOCK_TOKENS, katz.HOT), (997, 50)])
def test_katz(spark, docs, block, hot, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "BUCKET_KEYS", 4000)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    model = brute.Katz([tokens(t) for i, t in docs if not held[i]], lambda n: katz.Discounts(np.array(n)))
    got = registry.QUERIES["op10_katz_scores"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        t = tokens(dict(docs)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(model.uni[x] > 0 for x in t), model.total)
        assert r.base_score == pytest.approx(sum(math.log10((model.uni[x] + 1) / (model.total + len(model.uni) + 1)) for x in t), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(model.q(h, x)) for h, x in zip([1, *t[:-1]], t, strict=True)), rel=1e-9)
    for h in list(model.history)[:20]:
        assert sum(model.q(h, w) for w in model.uni) + model.q(h, "never seen anywhere") == pytest.approx(1, rel=1e-9)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([(1, False, "b a c")], "doc_id long, held_out boolean, text string")
    whole = katz.make_blocks(rows).first()
    assert (whole.sizes, whole.before, whole.n_keys) == ([4], [-1], 4)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 2)
    first, second = sorted(katz.make_blocks(rows).collect(), key=lambda r: r.block)
    assert (first.sizes, first.before, second.sizes) == ([2], [-1], [2])
    assert second.rows == first.rows and katz.unpack(second["keys"], np.uint64)[second.before[0]] == katz.xxhash.xxh64_intdigest("a")


def test_katz_of_odd_rows(spark, odd, empty):
    rows = odd.select("doc_id", "text", katz.held_out(F.col("doc_id")).alias("held_out"))
    got = katz.fit_and_score(rows).collect()
    assert len(got) == len(ROWS) and sorted(r.n_tokens for r in got) == sorted(len(tokens(t)) for _, t in ROWS)
    assert katz.fit_and_score(rows.filter("doc_id < 0")).count() == 0
    alone = katz.fit_and_score(spark.createDataFrame([(1, True, "x y")], "doc_id long, held_out boolean, text string")).first()
    assert (alone.score, alone.base_score, alone.n_known) == (0.0, 0.0, 0)


# the pipeline


def test_pipeline(spark, docs):
    """The stages in turn, with plain Python for each."""
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "benchmark decontamination", "mixing sources", "token output"]
    text = dict(docs)
    kept = sorted(r.doc_id for r in quality_rules.annotate(common.table(spark, DATA, "documents")).filter("kept").collect())
    found = brute.groups([text[i] for i in kept], 5)
    kept = [i for k, i in enumerate(kept) if found[k][1] == k]
    windows = brute.windows(duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall())
    kept = [i for i in kept for n, h, _ in [brute.hits(text[i], windows)] if not (h > 0 and 20 * h >= n)]
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet' where doc_id in ({', '.join(map(str, kept))})")
    copies = {i: taken // size for i, size, _, _, taken in c.sql(mixing.SQL).fetchall()}
    expected, start = [], 0
    for i in sorted(kept):
        ids = reference_ids([text[i]])[0]
        for _ in range(copies[i]):
            expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == expected


def test_stages_keep_columns(spark, odd, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "a text of its own without any id at all")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == odd.columns, name
        out.count()
