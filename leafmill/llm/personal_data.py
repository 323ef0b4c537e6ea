"""Personal data: fixed patterns, and a classifier of spans trained on the votes of weak labelers.

Four base kinds are what their patterns match, if the check of the kind holds. Candidates for
more kinds come from wider patterns; three labelers vote on each (+1, -1 or 0 for abstention): a strict
pattern, a gazetteer of codes, and cue words before the candidate. Expectation-maximisation
over the counts of vote patterns, of all documents, estimates for each kind how reliable each labeler
is. The posteriors label a bounded sample of candidates, on which a logistic classifier is trained
that sees the span and the words beside it, not the votes. Candidates that it accepts, that
overlap no base span, and of those the leftmost that overlap no other, are added.

Offsets are code points, ends exclusive. Null and empty texts have no spans; an empty table gives an
empty result. Rows are judged one by one; equal rows get equal spans. Columns other than doc_id and text aren't
looked at. Texts are read whole: patterns have loops that don't recurse,
and positions take n sqrt(n) time for n matches.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import let, lower_ascii, materialize, table

CHUNK = 256
#: Candidates that the classifier is trained on at most; buckets of the words on either side; rounds of expectation-maximisation.
SAMPLE_ROWS, WORD_BUCKETS, ROUNDS = 20_000, 64, 15
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


class Kind(NamedTuple):
    name: str
    pattern: str
    #: A text without a match of this has none of the pattern.
    hint: str


#: Possessive loops match what plain ones would: nothing that follows could use a character given back.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\x20-]?[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)


class Weak(NamedTuple):
    name: str
    pattern: str
    hint: str
    strict: str
    listed: str
    cues: str


#: Wider patterns, with the strict pattern, the gazetteer of codes and the cue words that vote on their matches.
WEAK = (
    Weak("masked_email", r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9.-]++(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z]{2,}+)?+", r"[(\[]at[)\]]",
         r"[A-Za-z].*[(\[]dot[)\]]", r"(?i)(?:com|org|net|edu|gov|info|de|fr|es|uk)$", r"(?i)\b(?:mail|email|contact|write|reach|kontakt|courriel|correo)\b"),
    Weak("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
         r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^[0-7]", r"(?i)\b(?:ssn|social|security|id|number|tax)\b"),
    Weak("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}",
         r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){3,}", r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|PL|SE|DK|NO|FI)", r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    Weak("local_phone", r"(?<![0-9+.)(-])(?<![0-9+.)(-]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9]{3}[.-][0-9]{4}",
         r"^\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$", r"^\(?[2-9][0-9]{2}", r"(?i)\b(?:call|phone|tel|fax|mobile|cell|telefon|appel\w*|llam\w*)\b"),
    Weak("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+", "[A-Za-z0-9+/_-]{20}",
         r"^(?:[0-9a-f]{32,}|(?=.*[0-9].*[0-9])(?=.*[a-z])(?=.*[A-Z]).+)$", r"^(?:AKIA|ASIA|sk_|sk-|pk_|ghp_|gho_|xox|[0-9a-f]{40}$|[0-9a-f]{64}$)", r"(?i)\b(?:token|secret|key|password|passwd|pwd|auth|bearer|api_key)\b"),
)
VOTES = ("strict", "listed", "context")
NAMES = [k.name for k in BASE] + [w.name for w in WEAK]
SPAN = "array<struct<start:int,kind:int,end:int>>"
CANDIDATE = "array<struct<start:int,kind:int,end:int,strict:int,listed:int,context:int,f:array<int>>>"
#: Features of a span, all of them flags: kind; kind with length, shares of digits, upper-case letters and distinct characters; words on either side.
SHAPES = (8, 5, 5, 5)
N_FEATURES = len(WEAK) * (1 + sum(SHAPES)) + 2 * WORD_BUCKETS


def located(text: Column, pattern: str, made) -> Column:
    """made(start, end, match, text before it, text after it) of the leftmost non-overlapping matches, in order.

    Matches and the texts between them give the lengths; sums run over chunks, so that no
    array is copied once for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        after = F.transform(F.slice(gaps, 2, F.size(m)), lambda g: F.left(g, F.lit(40)))
        steps = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(F.length(g).alias("gap"), F.length(x).alias("len"), x.alias("m"), F.right(g, F.lit(40)).alias("g")))
        steps = F.zip_with(steps, after, lambda s, r: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), s["m"].alias("m"), s["g"].alias("g"), r.alias("r")))
        empty = F.array().cast("array<struct<a:int,b:int,m:string,g:string,r:string>>")
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def one(s: Column, x: Column) -> Column:
            a = s["at"] + x["gap"]
            b = a + x["len"]
            return F.struct(b.alias("at"), F.array_append(s["out"], F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m"), x["g"].alias("g"), x["r"].alias("r"))).alias("out"))

        def chunk(s: Column, c: Column) -> Column:
            moved = F.transform(c["out"], lambda o: F.struct((o["a"] + s["at"]).alias("a"), (o["b"] + s["at"]).alias("b"), o["m"].alias("m"), o["g"].alias("g"), o["r"].alias("r")))
            return F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], moved).alias("out"))

        def chunked(p: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(CHUNK)), lambda i: F.aggregate(F.slice(p, i + 1, CHUNK), start, one))
            return F.aggregate(parts, start, chunk)["out"]

        return F.when(F.size(m) > 0, let(steps, chunked)).otherwise(empty)

    return F.transform(let(found, placed), lambda o: made(o["a"], o["b"], o["m"], o["g"], o["r"]))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """The check of a base kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    parts = []
    for number, kind in enumerate(BASE):
        made = lambda a, b, m, g, r, n=number, k=kind: F.when(holds(k.name, m), F.struct(a.alias("start"), F.lit(n).alias("kind"), b.alias("end")))
        parts.append(F.when(text.rlike(kind.hint), F.array_compact(located(text, kind.pattern, made))).otherwise(F.array().cast(SPAN)).cast(SPAN))
    return F.array_sort(F.concat(*parts))


def vote(yes: Column, no: int = -1) -> Column:
    return F.when(yes, 1).otherwise(no)


def features(kind: int, m: Column, before: Column, after: Column) -> Column:
    """The features that a span has, as numbers under N_FEATURES."""
    n, at = F.length(m), kind - len(BASE)
    share = lambda x: F.floor(4 * x / n).cast("int")
    digits, upper = n - F.length(F.regexp_replace(m, "[0-9]", "")), n - F.length(F.regexp_replace(m, "[A-Z]", ""))
    sizes = (F.least(F.floor(F.log2(n)).cast("int"), F.lit(SHAPES[0] - 1)), share(digits), share(upper), share(F.size(F.array_distinct(F.split(m, "")))))
    out, base = [F.lit(at)], len(WEAK)
    for size, x in zip(SHAPES, sizes, strict=True):
        out.append(base + at * size + F.least(x, F.lit(size - 1)))
        base += len(WEAK) * size
    for k, word in enumerate((F.regexp_extract(before, r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]*$", 1), F.regexp_extract(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1))):
        out.append(base + k * WORD_BUCKETS + F.pmod(F.xxhash64(lower_ascii(word)), F.lit(WORD_BUCKETS)).cast("int"))
    return F.array(*[x.cast("int") for x in out])


def candidates(text: Column) -> Column:
    """Matches of the wider patterns, each with the labelers' votes and its features; a missing cue is an abstention."""
    parts = []
    for number, w in enumerate(WEAK, len(BASE)):
        made = lambda a, b, m, g, r, n=number, w=w: F.struct(
            a.alias("start"), F.lit(n).alias("kind"), b.alias("end"),
            vote(m.rlike(w.strict)).alias("strict"), vote(m.rlike(w.listed)).alias("listed"), vote(g.rlike(w.cues), 0).alias("context"),
            features(n, m, g, r).alias("f"),
        )
        parts.append(F.when(text.rlike(w.hint), located(text, w.pattern, made)).otherwise(F.array().cast(CANDIDATE)).cast(CANDIDATE))
    return F.array_sort(F.concat(*parts))


def free_of(spans: Column, found: Column) -> Column:
    """The found spans that overlap none of the others."""
    return F.filter(found, lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))


def apart(found: Column) -> Column:
    """Of spans in order of their starts, each that begins at or after the end of the last one taken."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("out"))
    take = lambda s, c: F.struct(c["end"].alias("end"), F.array_append(s["out"], F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))).alias("out"))
    return F.aggregate(found, start, lambda s, c: F.when(c["start"] >= s["end"], take(s, c)).otherwise(s), lambda s: s["out"])


def reliabilities(patterns: list[dict], rounds: int = ROUNDS) -> tuple[float, dict]:
    """Expectation-maximisation over one kind's patterns (votes, n): the prior, and how often each
    labeler votes yes if the candidate is personal data and if not.

    The start takes labelers to be right four times in five, and has the weight of five candidates.
    """
    prior, chance = 0.5, {v: {1: 0.8, 0: 0.2} for v in VOTES}
    for _ in range(rounds):
        ps = [posterior(r, prior, chance) for r in patterns]
        total, yes = sum(r["n"] for r in patterns), sum(r["n"] * p for r, p in zip(patterns, ps, strict=True))
        prior = min(max((yes + 1) / (total + 2), 0.01), 0.99)
        # a vote counts as evidence for the truth it is named for: yes is never likelier without the truth
        for v in VOTES:
            a, b = 0.0, 0.0
            for truth in (1, 0):
                share = [(r["n"] * (p if truth else 1 - p), r[v]) for r, p in zip(patterns, ps, strict=True) if r[v]]
                x = (sum(n for n, y in share if y > 0) + (4 if truth else 1)) / (sum(n for n, _ in share) + 5)
                a, b = (x, b) if truth else (a, x)
            chance[v] = {1: min(max(a, 0.5), 0.99), 0: max(min(b, 0.5, a), 0.01)}
    return prior, chance


def posterior(votes: dict, prior: float, chance: dict) -> float:
    odds = math.log(prior / (1 - prior))
    for v in VOTES:
        if votes[v]:
            yes, no = (chance[v][t] if votes[v] > 0 else 1 - chance[v][t] for t in (1, 0))
            odds += math.log(yes / no)
    return 1 / (1 + math.exp(-odds))


def labelled(found: DataFrame) -> DataFrame | None:
    """f, label, weight: a bounded sample of all candidates, each once for either truth, weighted by its posterior."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    votes = each.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()  # 12 patterns of each kind at most
    if not votes:
        return None
    p = F.lit(None).cast("double")
    for kind in sorted({r.kind for r in votes}):
        mine = [r.asDict() for r in votes if r.kind == kind]
        model = reliabilities(mine)
        for r in mine:
            same = (F.col("kind") == kind) & (F.col("strict") == r["strict"]) & (F.col("listed") == r["listed"]) & (F.col("context") == r["context"])
            p = F.when(same, posterior(r, *model)).otherwise(p)
    # the least hashes: a sample that doesn't depend on the order of rows
    sample = each.select("f", p.alias("p"), F.xxhash64("doc_id", "start", "kind").alias("h")).orderBy("h", "f", "p").limit(SAMPLE_ROWS)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    return materialize(sample.select("f", sides.alias("t")).select("f", "t.*").groupBy("f", "label").agg(F.sum("weight").alias("weight")), "labelled-spans")


def classifier(found: DataFrame):
    """Acceptance as a function of a candidate; None without candidates."""
    rows = labelled(found)
    if rows is None:
        return None
    flags = F.transform(F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), lambda i: F.when(F.array_contains("f", i), 1.0).otherwise(0.0))
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=100, tol=1e-9, standardization=False).fit(rows.select(array_to_vector(flags).alias("features"), "label", "weight"))
    weights = F.array(*map(F.lit, model.coefficients.toArray().tolist()))
    return lambda c: F.aggregate(c["f"], F.lit(float(model.intercept)), lambda total, i: total + F.element_at(weights, i + 1)) > 0


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def annotate(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and all spans as arrays of (start, kind, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = materialize(docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("candidates")), "spans")
    accepts = classifier(found)
    base = F.col("base")
    if accepts is None:
        return found.select("doc_id", "base", base.alias("spans"))
    added = apart(free_of(base, F.filter("candidates", accepts)))
    return found.select("doc_id", "base", F.array_sort(F.concat(base, added)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k.name}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
