"""Conversations and the context that a question is answered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators import model_output

HISTORY, NEAREST, NAVIGATION = 6, 3, 50


def last_messages(messages: DataFrame, session: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last n messages of each session, with their place from the end."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("back", back).filter(F.col("back") <= n)


def latest_session(sessions: DataFrame, book: str, session: str, at: str) -> DataFrame:
    return sessions.groupBy(book).agg(F.max_by(session, F.struct(at, session)).alias(session))


def neighbours(segments: DataFrame, current: DataFrame, n: int = NEAREST) -> DataFrame:
    """current(book_id, current) -> the n segments nearest to it by number, itself among them but not returned."""
    held = segments.select("book_id", "segment_id", "idx").join(current, "book_id")
    far = F.abs(F.col("idx") - F.col("current"))
    ranked = held.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(far, "idx")))
    return ranked.filter(F.col("place") <= n).filter("idx <> current").select("book_id", "current", "segment_id", "idx")


def context(books: DataFrame, segments: DataFrame, current: DataFrame) -> DataFrame:
    """A text per book to answer from: its title and size, a line with the state of each of the first segments, the current text with
    its summary, and excerpts of the nearest ones, nearest first. Headings and lengths are fixed values.
    """
    number = lambda c: F.concat(F.lit("段 "), (F.col(c) + 1).cast("string"))
    lined = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("t")))), lambda x: x["t"]), "\n\n")
    line = F.concat(F.lit("- ["), number("idx"), F.lit("] "), F.coalesce(F.nullif("label", F.lit("")), number("idx")), F.lit(" ("), F.coalesce("summary_status", F.lit("pending")), F.lit(")"))
    lines = segments.filter(F.col("idx") < NAVIGATION).select("book_id", "idx", line.alias("t")).groupBy("book_id").agg(lined("idx", "t").alias("lines"))
    here = segments.join(current, "book_id").filter("idx = current").select("book_id", F.substring("raw_text", 1, 3000).alias("here"), "summary_json", model_output.summary(F.col("summary_json")).alias("s"))
    told = F.when(model_output.is_valid(F.col("s")), model_output.summary_text(F.col("s"))).otherwise(F.concat(F.lit("摘要: "), F.nullif("summary_json", F.lit(""))))
    here = here.select("book_id", "here", told.alias("told"))
    far = F.abs(F.col("idx") - F.col("current"))
    near = neighbours(segments, current).join(segments.select("segment_id", "raw_text"), "segment_id")
    near = near.select("book_id", "idx", far.alias("far"), F.concat(F.lit("### "), number("idx"), F.lit("\n"), F.substring("raw_text", 1, 400)).alias("t")).groupBy("book_id").agg(lined(F.struct("far", "idx"), "t").alias("near"))
    counts = segments.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    joined = books.select("book_id", "title").join(counts, "book_id").join(lines, "book_id", "left").join(here, "book_id", "left").join(near, "book_id", "left")
    title = F.concat(F.lit("# "), F.coalesce("title", F.lit("Book")))
    parts = (title, F.lit("## L0 书级"), F.concat(F.lit("总段数: "), F.col("n")), F.lit("## L1 段摘要导航"), "lines", F.lit("## L2 当前段原文"), "here", "told", F.lit("## L2 相关段摘录"), "near")
    return joined.select("book_id", F.concat_ws("\n\n", *parts).alias("context"))


def usage(calls: DataFrame) -> DataFrame:
    """calls(call_id, prompt_tokens, completion_tokens, total_tokens, duration_ms) with totals and tokens a second."""
    total = F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    rate = F.bround(F.col("completion_tokens") / F.greatest(F.col("duration_ms"), F.lit(1)) * 1000, 1)
    return calls.select("call_id", total.alias("total_tokens"), rate.alias("tokens_per_s"))


def article_context(articles: DataFrame) -> DataFrame:
    """articles(article_id, title, url, author, published_at, body, p: the parsed summary, card, excerpt) -> what questions about each are answered from.

    The start of the body (fixed length), else what the summary tells, else card and excerpt; headings are fixed values.
    """
    p = F.col("p")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    head = [F.concat(F.lit("# "), F.coalesce("title", F.lit("Article"))), F.concat(F.lit("来源: "), F.coalesce("url", F.lit(""))), F.concat(F.lit("作者: "), text("author")), F.concat(F.lit("发布时间: "), text("published_at"))]
    views = F.when(F.size(p["viewpoints"]) > 0, F.concat(F.lit("主要观点：\n"), F.array_join(F.transform(p["viewpoints"], lambda x: F.concat(F.lit("- "), x)), "\n")))
    told = F.concat_ws("\n", F.nullif(p["one_liner"], F.lit("")), F.nullif(p["detail"], F.lit("")), views)
    rest = F.concat_ws("\n", F.concat(F.lit("\n## 速读卡\n"), text("card")), F.concat(F.lit("\n## 摘要\n"), text("excerpt")))
    body = F.when(text("body").isNotNull(), F.concat(F.lit("\n## 正文\n"), F.substring("body", 1, 12000))).when(told != "", F.concat(F.lit("\n## RSS 结构化摘要\n"), told)).otherwise(F.nullif(rest, F.lit("")))
    return articles.select("article_id", F.concat_ws("\n", *head, body).alias("context"))


def prepared(questions: DataFrame, system: str, about: str = "上下文") -> DataFrame:
    """questions(question_id, message, quote, context, enough, refs: array of (title, url, source)) -> the messages that a model gets.

    Web results are added to the context where that isn't enough; a quote stands before its question.
    """
    web = F.when(~F.col("enough") & (F.size("refs") > 0), F.concat(F.lit("\n\n## 联网检索\n"), F.to_json("refs"))).otherwise("")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    asked = F.when(quote != "", F.concat(F.lit("用户选中的原文:\n「"), quote, F.lit("」\n\n问题: "), F.col("message"))).otherwise(F.col("message"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = F.concat(F.lit(f"{about}:\n"), F.col("context"), web, F.lit("\n\n用户问题: "), asked)
    return questions.select("question_id", F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def turns(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions(session_id, at, message) and answers(session_id, at, raw: what a model said) -> the messages that are stored."""
    from leafmill.operators.model_output import chat_answer

    said = questions.select("session_id", "at", F.lit("user").alias("role"), F.col("message").alias("content"))
    return said.unionByName(answers.select("session_id", "at", F.lit("assistant").alias("role"), chat_answer(F.col("raw"))["answer"].alias("content")))
