"""Language codes and their inference from letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import first_filled, once

SAMPLE = 4000
CJK, KANA, LATIN = "[一-鿿]", "[぀-ヿ]", "[A-Za-z]"


def normalise(code: Column) -> Column:
    """The family of a locale code: zh-CN and cmn are zh; blank is null."""
    family = F.split_part(F.lower(F.replace(first_filled(code), F.lit("_"), F.lit("-"))), F.lit("-"), F.lit(1))
    return F.when(family == "cmn", "zh").otherwise(family)


def match(a: Column, b: Column) -> Column:
    return F.coalesce(normalise(a) == normalise(b), F.lit(False))


def infer(text: Column) -> Column:
    """The likely language of a text, null if it has too few letters.

    Latin letters count twice in the total: as Latin and as letters. Each class is counted once, as what a text loses without it.
    """

    def judged(c: Column) -> Column:
        cjk, kana, latin = c["cjk"], c["kana"], c["latin"]
        total = cjk + kana + latin + c["letters"]
        return (
            F.when(total < 20, None)
            .when((kana > cjk) & (kana >= latin), "ja")
            .when((cjk >= latin) & (cjk * 100 >= total * 15), "zh")
            .when(latin * 2 >= total, "en")
            .when(cjk > 0, "zh")
            .when(latin > 0, "en")
        )

    def counted(sample: Column) -> Column:
        n = lambda pattern: F.length(sample) - F.length(F.regexp_replace(sample, pattern, ""))
        return once(F.struct(n(CJK).alias("cjk"), n(KANA).alias("kana"), n(LATIN).alias("latin"), n(r"[\p{L}&&[^一-鿿぀-ヿ]]").alias("letters")), judged)

    return once(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE), counted)


def needs_translation(language: Column, target: Column, inferred: Column) -> Column:
    """The text's language is known, or inferred, and is another than the target."""
    return F.coalesce(F.coalesce(normalise(language), inferred) != normalise(target), F.lit(False))
