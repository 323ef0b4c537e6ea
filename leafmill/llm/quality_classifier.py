"""Quality classifier from weak labels.

Heuristic labellers vote on every document (+1 good, -1 bad, 0 abstains). Expectation-
maximisation over the counts of vote patterns, taken from all documents, estimates how often
each labeller votes rightly and gives each pattern a posterior. The posteriors of a bounded
sample label a linear scorer over hashed words and shapes of words, which scores every document.

Null and blank texts get score 0 and are not kept. Rows are scored one by one, texts of any length whole; equal rows get
equal scores. Of equal hashes the sample takes each text once. An empty table gives an empty result; without a sample the posterior alone decides.
Columns other than doc_id and text aren't looked at. Labellers that measure related things share what they are right
about, which expectation-maximisation, taking them as independent, counts twice: posteriors are surer than they should be.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import let, lower_ascii, materialize, table, words_of
from leafmill.llm.quality_rules import measures

#: Rows of the training sample at most, buckets of the scorer, and the least score that is kept.
SAMPLE_ROWS, BUCKETS, LEAST = 20_000, 1 << 16, 0.5
#: Rounds of expectation-maximisation.
ROUNDS = 20


def labellers(m: Column) -> dict[str, Column]:
    """Votes by name, over the measures of a text; they overlap on purpose."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    no = F.lit(False)
    return {
        "length": vote(m["n_words"] >= 50, m["n_words"] < 5),
        "symbols": vote(m["symbol_ratio"] < 0.02, m["symbol_ratio"] > 0.3),
        "stop_words": vote(m["stop_ratio"].between(0.1, 0.6), (m["stop_ratio"] < 0.03) & (m["n_words"] >= 20)),
        "repeats": vote(m["repeat_ratio"] < 0.05, m["repeat_ratio"] > 0.3),
        "lines": vote(no, m["dup_line_ratio"] > 0.5),
        "upper_case": vote(m["upper_ratio"] < 0.1, m["upper_ratio"] > 0.4),
        "word_length": vote(m["mean_word_length"].between(4, 6.5), (m["mean_word_length"] < 3) | (m["mean_word_length"] > 7.5)),
    }


def em(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, float], Column]:
    """patterns(votes, n) -> each labeller's accuracy, and the posterior of "good" over the votes.

    patterns has a row per combination of votes at most; each round is one sum over it. The
    start takes most documents to be good and labellers to be better than chance.
    """
    rows = [r.asDict() for r in patterns.collect()]  # 3 ** labellers at most
    prior, right = 0.8, {v: {1: 0.8, -1: 0.8} for v in names}

    def odds(r: dict) -> float:
        x = math.log(prior / (1 - prior))
        for v in names:
            good, bad = right[v][1], right[v][-1]
            x += r[v] and (math.log(good / (1 - bad)) if r[v] > 0 else math.log((1 - good) / bad))
        return max(-500.0, min(500.0, x))

    for _ in range(rounds):
        ps = [1 / (1 + math.exp(-odds(r))) for r in rows]
        total = sum(r["n"] for r in rows)
        prior = min(max((sum(r["n"] * p for r, p in zip(rows, ps, strict=True)) + 1) / (total + 2), 0.05), 0.95)
        for v in names:
            for truth in (1, -1):
                share = [(r["n"] * (p if truth > 0 else 1 - p), r[v]) for r, p in zip(rows, ps, strict=True) if r[v]]
                hit, of = sum(n for n, x in share if x == truth), sum(n for n, _ in share)
                right[v][truth] = min(max((hit + 4) / (of + 5), 0.55), 0.99)
    x = F.lit(math.log(prior / (1 - prior)))
    for v in names:
        good, bad = right[v][1], right[v][-1]
        x = x + F.when(F.col(v) > 0, math.log(good / (1 - bad))).when(F.col(v) < 0, math.log((1 - good) / bad)).otherwise(0.0)
    return {v: (right[v][1] + right[v][-1]) / 2 for v in names}, 1 / (1 + F.exp(-x))


def features_of(text: Column) -> Column:
    """Words, and shapes of words: length, case and the last character if it is no letter."""

    def shape(w: Column) -> Column:
        tail = F.when(F.substring(w, -1, 1).between("a", "z"), "").otherwise(F.regexp_extract(w, r"[^\p{L}\p{N}]+$", 0))  # most words end so
        return F.concat(F.lit(" "), F.least(F.length(w), F.lit(12)).cast("string"), F.when(w == F.upper(w), "A").otherwise("a"), tail)

    def lower(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(lower_ascii(w))  # of ASCII alone both are the same

    return let(words_of(text), lambda words: F.concat(F.transform(words, lower), F.transform(words, shape)))


def annotate(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, least: float = LEAST) -> DataFrame:
    """docs(doc_id, text) -> doc_id, weak_label (the posterior), score, kept."""
    votes = labellers(F.col("m"))
    voted = docs.select("doc_id", "text", measures(F.col("text")).alias("m")).select("doc_id", "text", F.col("m.n_words").alias("n_words"), *[v.alias(k) for k, v in votes.items()])
    names = [*votes]
    voted = materialize(voted.select("doc_id", "n_words", *names, F.xxhash64("doc_id", "text").alias("mark")), "votes")
    patterns = voted.filter("n_words > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    _, posterior = em(patterns, names)
    # the least hashes: a sample that doesn't depend on the order of rows
    sample = voted.filter("n_words > 0").select("mark", posterior.alias("p")).distinct().orderBy(F.xxhash64("mark"), "mark").limit(sample_rows)
    sample = materialize(sample, "sample")
    mark = F.xxhash64("doc_id", "text")
    text = F.col("text")
    hashing = HashingTF(inputCol="tokens", outputCol="raw", numFeatures=buckets, binary=True)
    chosen = hashing.transform(docs.select(text, mark.alias("mark")).join(sample, "mark").dropDuplicates(["mark"]).select(features_of(text).alias("tokens"), "p"))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("side")
    training = chosen.select(F.col("raw").alias("features"), sides).select("features", "side.label", "side.weight").filter("weight > 0.01")
    training = materialize(training, "training")
    keyed = docs.select("doc_id", text, mark.alias("mark"), F.size(words_of(text)).alias("n_words"))
    if training.select("label").distinct().count() < 2:
        scored = keyed.select("doc_id", "mark", "n_words", F.lit(None).cast("double").alias("score"))
    else:
        model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30, aggregationDepth=2).fit(training)
        hashed = hashing.transform(keyed.select("doc_id", "mark", "n_words", features_of(text).alias("tokens"))).withColumnRenamed("raw", "features")
        scored = model.transform(hashed).select("doc_id", "mark", "n_words", vector_to_array("probability")[1].alias("score"))
    labels = voted.select("mark", posterior.alias("weak_label")).groupBy("mark").agg(F.first("weak_label").alias("weak_label"))
    score = F.when(F.col("n_words") > 0, F.coalesce("score", "weak_label")).otherwise(F.lit(0.0))
    return scored.join(labels, "mark").select("doc_id", F.when(F.col("n_words") > 0, F.col("weak_label")).otherwise(F.lit(0.0)).alias("weak_label"), score.alias("score"), (score >= least).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents"))
