"""A feed summary's text is made, stripped and split once."""

from pyspark.sql import functions as F

from leafmill.functions.text import bare, ensure_mark, strip
from leafmill.operators import news


def test_sections_evaluate_their_text_once(spark):
    df = spark.createDataFrame([("一句话摘要 a。 主要观点 b。",)], "t string").select(news.sections(F.reverse("t")).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1 and plan.count("split(") == 1


def test_bare_strips_what_strip_does(spark):
    odd = ["", " ", "a", " a ", "a\n", "　段落。　", "a ", "\x85a b\x0b", "a\n\n", "\ta。", "é ", " x ", "😀 ", " 😀", "​a​"]
    rows = spark.createDataFrame([(x,) for x in [*odd, None]], "t string").select(bare(F.col("t")).alias("a"), strip(F.col("t")).alias("b"), ensure_mark(F.col("t")).alias("m")).collect()
    assert all(r.a == r.b for r in rows)
    assert all(r.m is None if r.b is None else r.m == (r.b if r.b == "" or r.b[-1] in "。！？.!?" else r.b + "。") for r in rows)
