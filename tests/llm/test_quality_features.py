"""The features of the quality classifier take the slow paths only where they must, with the same result."""

from pyspark.sql import functions as F

from leafmill.llm import quality_classifier
from leafmill.llm.common import lower_ascii, words_of


def test_features_are_those_of_the_plain_form(spark):
    texts = ["Plain words, end. HERE!", "Ünï ÉCOLE straße. İstanbul", "a1 B2- c_ … 中文。 😀 x😀 --", "  ", "", None, "Z\tZ\x0bzz{ ~ }"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = words_of(F.col("t"))
    shapes = F.transform(words, lambda w: F.concat(F.lit(" "), F.least(F.length(w), F.lit(12)).cast("string"), F.when(w == F.upper(w), "A").otherwise("a"), F.regexp_extract(w, r"[^\p{L}\p{N}]+$", 0)))
    plain = F.concat(F.transform(words, lambda w: lower_ascii(w)), shapes)
    made = df.select(quality_classifier.features_of(F.col("t")).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in made.collect())
    assert made.select("a")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
