"""Fill-in-the-middle: a text cut at two unit boundaries and put together in another order.

A unit is a run of A-Z letters or any other single code point. The number n of units, counted by
a regular expression, and a hash of the document's id say after how many units, a <= b, the
middle begins and ends. Then one match per document does the cutting: a pattern made for the row
takes `unit{a}` as the prefix and `unit{b-a}` as the middle, both possessive, so that the matcher
walks the text once, keeps no state to go back to, and needs no stack; what remains is the suffix. The replacement
writes the pieces in the wanted order at once.

Null and empty texts, and texts that hold a mark themselves, stay as they are (`plain`), and so
does a share of all documents. Texts of any length are cut whole. Rows with equal ids are cut by the same
hash; a null id hashes as the word null. Other columns are carried in a struct, so that no name
clashes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are cut, and of a hundred cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = "1"


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def pattern(first: Column, second: Column) -> Column:
    """Matches a whole text: so many units, so many more, and the rest, as three groups."""
    unit = r"(?:[A-Za-z]++|[^A-Za-z])"
    return F.concat(F.lit(rf"(?s)\A({unit}{{"), first.cast("string"), F.lit(rf"}}+)({unit}{{"), second.cast("string"), F.lit(r"}+)(.*+)\z"))


def transform(docs: DataFrame, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, ...) -> doc (all columns), n, form (plain, psm or spm), output, prefix_chars, middle_chars; narrow."""
    h1, h2, h3, h4 = draws(F.col("doc.doc_id"), seed)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    counted = docs.select(F.struct("*").alias("doc")).select("doc", F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), form.alias("form"))
    ends = counted.select("*", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("a"), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("b"))
    # $1 is the prefix, $2 the middle, $3 the suffix
    order = F.when(F.col("form") == "psm", rf"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(rf"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern(F.col("a"), F.col("b") - F.col("a")), order))
    put = ends.select("doc", "n", "form", output.alias("output"))
    prefix, middle, _ = pieces(F.col("output"), F.col("form"))
    return put.select("*", *[F.when(F.col("form") != "plain", F.char_length(x).cast("long")).alias(name) for name, x in (("prefix_chars", prefix), ("middle_chars", middle))])


def pieces(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a cut text; the marks occur once each, since texts that hold any are plain."""
    psm = form == "psm"
    middle, rest = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    prefix = F.when(psm, F.substring_index(F.substring_index(rest, SUFFIX, 1), PREFIX, -1)).otherwise(F.substring_index(rest, PREFIX, -1))
    suffix = F.when(psm, F.substring_index(rest, SUFFIX, -1)).otherwise(F.substring_index(F.substring_index(rest, PREFIX, 1), SUFFIX, -1))
    return prefix, middle, suffix


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    return F.when(form == "plain", output).otherwise(F.concat(*pieces(output, form)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents
), h AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
         CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
