"""URL filters: listed rules first, association rules for what no listed rule fits.

Verdicts of the listed rules are the labels. FP-growth mines combinations of url tokens that come
with a blocked label among the labelled urls, allowed or blocked; what no listed rule fits is no
evidence for either. Combinations with enough support, confidence and lift become rules, and a rule
that contains another one is dropped, so that the shortest remain: they reach urls that the list
doesn't. The many tokens of one template are mined as one, so that long urls don't multiply combinations; only tokens that come
together on most urls but not on all still do. An inverted index from tokens to rules finds the rules all of whose tokens an url
has. Token sets are matched once, however many urls share them.

A null url, or one without ://, has an empty host and path and no tokens: it is allowed. Rows
are judged one by one; equal rows get equal verdicts, and very long urls are read whole. Of equally long
listed rules that fit, the first in the list wins. Without blocked urls nothing
is mined, and what no rule fits is allowed; an empty table gives an empty result. Columns other than page_id and url aren't looked
at. The listed rules are compiled into one expression: they are a parameter, LISTED_MOST of them at most.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import lower_ascii, materialize, table

LISTED_MOST = 1000
#: A rule's urls: a share of the labelled ones, and a number, at least; how many of them are blocked; and how much likelier than any.
SUPPORT, SUPPORT_ROWS, CONFIDENCE, LIFT = 0.002, 10, 0.8, 1.05
BLOCKED = "verdict=block"


class Listed(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Listed("com", "/", "allow"),
    Listed("example.com", "/en/", "block"),
    Listed("www.example.com", "/en/", "allow"),
    Listed("net", "/es/", "block"),
    Listed("net", "/fr/", "block"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """name and verdict of the longest listed rule that fits, else null."""
    if len(rules) > LISTED_MOST:
        raise ValueError(f"more than {LISTED_MOST} listed rules")
    dotted = F.concat(F.lit("."), host)
    found = [F.lit(None)]
    for r in sorted(rules, key=lambda r: len(r.name), reverse=True):
        fits = dotted.endswith("." + r.host) & path.startswith(r.path)
        found.append(F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*found[1:]) if len(found) > 1 else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens, sorted: parts of the host, path segments, query keys; numbers are one token."""
    parts = F.transform(F.split(host, "[.-]"), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(lower_ascii(path), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(rest, F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), lower_ascii(x)))
    full = F.filter(F.concat(parts, segments, keys), lambda x: F.length(x) > 2)
    return F.array_sort(F.array_distinct(full))


def judged_by_list(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, tokens, listed (rule and verdict, or null)."""
    cut = pages.select("page_id", after_scheme(F.coalesce(F.col("url"), F.lit(""))).alias("rest"))
    cut = cut.select("page_id", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"), "rest")
    return cut.select("page_id", "host", "path", tokens_of(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"), listed_rule(F.col("host"), F.col("path"), rules).alias("listed"))


def mine(labelled: DataFrame, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, confidence: float = CONFIDENCE, lift: float = LIFT) -> tuple[DataFrame, DataFrame] | None:
    """labelled(tokens, verdict) -> rule_id, tokens, confidence, support of the shortest rules for a block, and token, name: what stands for a token in rules.

    Tokens that the same urls have stand for each other: one of them is mined, and a rule with it holds for each. A
    token that is a rule by itself is in no other shortest rule, and one with too few blocked urls is in none, so both are
    left out of the mining, as are tokens that all labelled urls have, which tell nothing.
    """
    baskets = materialize(labelled.filter("verdict IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "tokens", (F.col("verdict") == "block").alias("bad")), "labelled-urls")
    n, bad = baskets.agg(F.count(F.lit(1)), F.coalesce(F.count_if("bad"), F.lit(0))).first()
    if not bad:
        return None
    least = math.ceil(max(support, support_rows / n) * n - 1e-9)
    extents = baskets.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")
    )
    told = extents.filter((F.col("n") < n) & (F.col("n_bad") >= least))
    same = told.groupBy("n", "n_bad", "x", "y").agg(F.min("token").alias("name"), F.collect_list("token").alias("all"))
    right = F.col("n_bad") / F.col("n")
    alone = (right >= confidence) & (right / (bad / n) >= lift)
    classes = materialize(same.select("name", "all", right.alias("confidence"), (F.col("n_bad") / n).alias("support"), alone.alias("alone")), "url-tokens")
    single = classes.filter("alone").select(F.array("name").alias("tokens"), "confidence", "support")
    names = classes.filter("NOT alone").select("name").distinct()
    left = baskets.select("row", "bad", F.explode("tokens").alias("name")).join(names, "name").groupBy("row").agg(F.collect_set("name").alias("names"), F.first("bad").alias("bad"))
    items = materialize(left.select(F.when(F.col("bad"), F.array_append("names", BLOCKED)).otherwise(F.col("names")).alias("items")), "url-items")
    rules = single
    if kept := items.count():  # fewer than n if some have none of these tokens
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / kept), minConfidence=confidence).fit(items)
        mined = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BLOCKED))) & (F.col("confidence") / (bad / n) >= lift))
        rules = single.unionByName(mined.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * kept / n).alias("support")))
    rules = materialize(rules.withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    return shortest(rules), materialize(classes.select(F.explode("all").alias("token"), "name"), "url-names")


def shortest(rules: DataFrame) -> DataFrame:
    """The rules that contain no other one, found by length: a url has few tokens, so lengths are few."""
    kept = rules.limit(0)
    while length := rules.agg(F.min(F.size("tokens"))).first()[0]:
        level = rules.filter(F.size("tokens") == length)
        kept = kept.unionByName(level)
        longer = rules.filter(F.size("tokens") > length).withColumnRenamed("rule_id", "of")
        held = contained(longer.select("of", "tokens"), level, "of").select("of").distinct()
        rules = materialize(longer.join(held, "of", "left_anti").withColumnRenamed("of", "rule_id").select(*kept.columns), "url-rules")
    return kept


def contained(sets: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, rule_id, confidence: the rules all of whose tokens a row of sets(key, tokens) has, by an index from tokens to rules."""
    index = rules.select("rule_id", F.size("tokens").alias("n"), "confidence", F.explode("tokens").alias("token"))
    met = sets.select(key, F.explode("tokens").alias("token")).join(index, "token")
    return met.groupBy(key, "rule_id", "n", "confidence").agg(F.count(F.lit(1)).alias("hits")).filter("hits = n").select(key, "rule_id", "confidence")


def matches(token_sets: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """token_sets(tokens), distinct -> tokens, confidence of the best rule that they fit: of each of its tokens there is one that stands for it."""
    there = token_sets.select(F.col("tokens").alias("all"), F.explode("tokens").alias("token")).join(names, "token")
    sets = there.groupBy("all").agg(F.collect_set("name").alias("tokens"))
    return contained(sets, rules, "all").groupBy(F.col("all").alias("tokens")).agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, confidence (of the mined rule, if one decided)."""
    seen = judged_by_list(pages, rules)
    mined = mine(seen.select("tokens", F.col("listed.verdict").alias("verdict")), support, support_rows, confidence)
    best = F.lit(None).cast("double")
    if mined is not None:
        open_sets = seen.filter("listed IS NULL").select("tokens").distinct()
        seen = seen.join(materialize(matches(open_sets, *mined), "url-matches"), "tokens", "left")
        best = F.when(F.col("listed").isNull(), F.col("confidence"))
    verdict = F.coalesce(F.col("listed.verdict"), F.when(best.isNotNull(), F.lit("block")), F.lit("allow"))
    return seen.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), best.alias("confidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
