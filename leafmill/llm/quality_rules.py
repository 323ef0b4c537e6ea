"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Nulls and blank texts have no words and fail. Every other column of the input is left alone;
measures and verdicts are expressions over the text column, so clashing names can't arise.
Rows are judged one by one: repeated rows get equal verdicts, an empty table an empty result.
Very long texts are handled in n log n time, without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE_CHARS, let, table, words_of

WINDOW = 8

#: Frequent function words of the four languages (fixed values).
STOP_WORDS = (
    "the be to of and that have with in is it for on as was are at by this from or an "
    "der die das und ist nicht von zu mit sich auf für den des ein eine "
    "le la les de et un une que qui dans pour pas du est en "
    "el los las y del por con una se no al lo como"
).split()


class Rule(NamedTuple):
    """A document breaks a rule if the measure is under least or over most."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: Measures are ratios, so that long and short documents meet the same thresholds.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("mean_word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.5),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_words", "repeat_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("upper_case", "upper_ratio", None, 0.5),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.5),
)


def repeat_words(words: Column) -> Column:
    """Words in a window of eight words that occurs twice or more.

    Windows are compared by their 64-bit hashes. Only texts in which two are equal are sorted:
    equal windows then stand side by side, and the positions they cover are added up.
    """
    n = F.size(words)

    def covered(keys: Column) -> Column:
        order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def spread(s: Column) -> Column:
            m = F.size(s)
            before = F.concat(F.array(F.lit(None).cast("long")), F.slice(s["k"], 1, m - 1))
            after = F.concat(F.slice(s["k"], 2, m - 1), F.array(F.lit(None).cast("long")))
            same = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            hit = F.zip_with(s, same, lambda x, y: F.when((x["k"] == y["a"]) | (x["k"] == y["b"]), x["i"]))
            return let(
                F.array_sort(F.filter(hit, lambda i: i.isNotNull())),
                lambda p: F.aggregate(
                    F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(order, spread))

    def doubled(keys: Column, step: int) -> Column:
        """Hashes of spans twice as long: each key with the one step positions on."""
        return F.zip_with(keys, F.slice(keys, step + 1, n), lambda a, b: F.xxhash64(a, b))

    def keyed(hashes: Column) -> Column:
        pairs = let(hashes, lambda k: doubled(k, 1))
        fours = let(pairs, lambda k: doubled(k, 2))
        return let(F.slice(let(fours, lambda k: doubled(k, 4)), 1, n - WINDOW + 1), covered)

    return F.when(n > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), keyed)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of all counts and ratios of a text."""
    full = F.coalesce(text, F.lit(""))
    symbols = F.regexp_count(full, F.lit("[#*$%&|<>]"))
    upper = F.regexp_count(full, F.lit("[A-Z]"))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    spellings = sorted({y for w in STOP_WORDS for y in (w, w.capitalize(), w.upper())})

    def counted(words: Column, rows: Column) -> Column:
        n = F.size(words).cast("long")
        chars = F.length(F.array_join(words, ""))
        ratio = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
        n_stop = F.size(F.filter(words, lambda w: w.isin(spellings)))
        n_dup = (F.size(rows) - F.size(F.array_distinct(rows))).cast("long")
        n_ellipsis = F.size(F.filter(rows, lambda x: F.rtrim(x, F.lit(SPACE_CHARS)).endswith("...") | F.rtrim(x, F.lit(SPACE_CHARS)).endswith("…")))
        return let(
            repeat_words(words),
            lambda r: F.struct(
                n.alias("n_words"),
                chars.cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                n_dup.alias("n_dup_lines"),
                r.alias("n_repeat_words"),
                ratio(chars, n).alias("mean_word_length"),
                ratio(symbols, n).alias("symbol_ratio"),
                ratio(n_stop, n).alias("stop_ratio"),
                ratio(r, n).alias("repeat_ratio"),
                ratio(n_dup, F.size(rows)).alias("dup_line_ratio"),
                ratio(upper, chars).alias("upper_ratio"),
                ratio(n_ellipsis, F.size(rows)).alias("ellipsis_ratio"),
            ),
        )

    return let(words_of(text), lambda w: let(lines, lambda x: counted(w, x)))


def broken(m: Column, rules=RULES) -> Column:
    """The names of the rules that a document with measures m breaks."""
    checks = []
    for rule in rules:
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (m[rule.measure] < F.lit(rule.least))
        if rule.most is not None:
            bad = bad | (m[rule.measure] > F.lit(rule.most))
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*checks))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def annotate(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, measures m, broken_rules, base_failed, kept."""
    judged = docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m", broken(F.col("m"), rules).alias("broken_rules"))
    failed = base_failed(F.col("m"))
    return judged.select("doc_id", "m", "broken_rules", failed.alias("base_failed"), (~failed & (F.size("broken_rules") == 0)).alias("kept"))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs, with all their columns, that break no rule."""
    return docs.filter(let(measures(F.col("text")), lambda m: ~base_failed(m) & (F.size(broken(m, rules)) == 0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    return annotate(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )
