"""The text of a search as phrases under AND, OR and NOT, and marked excerpts of what they hit.

Words that stand together must all be found. NOT binds before AND, and AND before OR; words side by side bind before
all three. "..." is a phrase, `title:` or `{title body}:` confine it to fields, `-title:` keeps it out of one, `^`
asks for it at the start, `+` joins phrases, `*` at an end changes nothing, since a trigram index finds parts of
words anyway. A phrase of under three characters has no trigram: beside other words it is left out, as a side of AND, OR or
NOT it finds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "body")
#: Columns of an index that hold no text: a search may name them, and finds nothing there.
BARE = ("book_id", "segment_id", "note_id", "kind")
TOKEN = re.compile(r'[ \t\r\n]+|("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:+*^,-])|(.)', re.S)


NOTHING = ("nothing",)


class Unreadable(ValueError):
    """What is wrong with a query."""


@dataclass
class Phrase:
    grams: list[str]
    fields: tuple[str, ...] = FIELDS
    initial: bool = False


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def trigrams(text: str) -> list[str]:
    text = folded(text)
    return [text[i : i + 3] for i in range(len(text) - 2)]


class _Reader:
    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        for quoted, word, mark, other in TOKEN.findall(query):
            if other == '"':
                raise Unreadable("unterminated string")
            if other:
                raise Unreadable(f'syntax error near "{other}"')
            if quoted:
                self.tokens.append(("text", quoted[1:-1].replace('""', '"')))
            elif word:
                self.tokens.append((word if word in ("AND", "OR", "NOT") else "text", word))
            elif mark:
                self.tokens.append((mark, mark))
        self.at, self.phrases = 0, []

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise Unreadable(f'syntax error near "{self.tokens[self.at][1] if self.at < len(self.tokens) else ""}"')
        self.at += 1
        return self.tokens[self.at - 1][1]

    def expression(self, fields: tuple[str, ...], level: int = 0):
        """Level 0 is OR, 1 AND, 2 NOT, 3 words side by side."""
        if level == 3:
            return self.beside(fields)
        name = ("OR", "AND", "NOT")[level]
        left = self.expression(fields, level + 1)
        while self.peek() == name:
            self.at += 1
            left = (name, left, self.expression(fields, level + 1))
        return left

    def beside(self, fields: tuple[str, ...]):
        out = self.item(fields)
        if out[0] == "group":
            return out[1]
        while self.peek() in ("text", "^", "{", "-"):
            right = self.item(fields)
            if right[0] == "group":
                raise Unreadable('syntax error near "("')
            out = right if out == NOTHING else out if right == NOTHING else ("AND", out, right)
        if self.peek() in ("(", ":", "*", "+", ","):
            self.take("end")
        return out

    def item(self, fields: tuple[str, ...]):
        """A phrase, a phrase of some fields, or an expression in brackets."""
        if self.peek() in ("-", "{") or (self.peek() == "text" and self.peek(1) == ":"):
            fields = tuple(f for f in self.columns() if f in fields)
        if self.peek() == "(":
            self.at += 1
            inner = self.expression(fields)
            self.take(")")
            return "group", inner
        initial = self.peek() == "^"
        self.at += initial
        near = self.at < len(self.tokens) and self.tokens[self.at][1] == "NEAR" and self.peek(1) == "("
        if near:
            raise Unreadable("NEAR isn't supported")
        grams = trigrams(self.take("text"))
        while self.peek() == "+":
            self.at += 1
            grams += trigrams(self.take("text"))
        if self.peek() == "*":
            self.at += 1
        if not grams:
            return NOTHING
        self.phrases.append(Phrase(grams, fields, initial))
        return "phrase", len(self.phrases) - 1

    def columns(self) -> tuple[str, ...]:
        out = self.peek() == "-"
        self.at += out
        names = []
        if self.peek() == "{":
            self.at += 1
            while self.peek() != "}":
                names.append(self.take("text"))
            self.at += 1
        else:
            names.append(self.take("text"))
        self.take(":")
        for n in names:
            if n.lower() not in FIELDS + BARE:
                raise Unreadable(f"no such column: {n}")
        names = [n.lower() for n in names]
        return tuple(f for f in FIELDS if (f in names) != out)


def parse(query: str) -> tuple[tuple, list[Phrase]]:
    """The tree of a query and its phrases; a query without any finds nothing."""
    reader = _Reader(query)
    if not reader.tokens:
        return NOTHING, []
    tree = reader.expression(FIELDS)
    if reader.at < len(reader.tokens):
        raise Unreadable(f'syntax error near "{reader.tokens[reader.at][1]}"')
    return tree, reader.phrases


def holds(tree: tuple, found: list[Column]) -> Column:
    kind, *sides = tree
    if tree == NOTHING:
        return F.lit(False)
    if kind == "phrase":
        return found[sides[0]]
    left, right = (holds(s, found) for s in sides)
    return left & right if kind == "AND" else left | right if kind == "OR" else left & ~right


def snippet(text: Column, phrases: list[tuple[Column, int]], marks: tuple[str, str] = ("[", "]"), dots: str = "…", tokens: int = 10) -> Column:
    """The best part of a text, as long as so many trigrams, with its hits between marks.

    phrases: where each begins in the text, and how many trigrams it has. A window counts 1000 for each phrase that begins
    in it and 1 for each further hit. Windows that might be best begin at a hit, and are then moved to have what they
    hold in the middle; or at the beginning of the sentence of a hit, which counts 100, and 120 if it is the text's.
    """
    n = F.greatest(F.length(text) - 2, F.lit(0))
    hits = F.concat(*[F.transform(places, lambda x: F.struct(x.cast("int").alias("at"), F.lit(k).alias("phrase"), F.lit(size).alias("size"))) for k, (places, size) in enumerate(phrases)])
    hits = F.array_sort(hits)
    # where sentences begin: at the start, and after a full stop or colon and white space
    chars = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    heads = F.regexp_extract_all(text, F.lit(r"(?s)(?:[.:][ \t\n\r]+|[^.:]|[.:](?![ \t\n\r]))"), 0)
    lens = F.transform(heads, F.length)
    ends = F.aggregate(lens, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    after = F.filter(F.transform(heads, lambda h, i: F.when(F.rlike(h, F.lit(r"(?s)\A[.:][ \t\n\r]+\z")), F.get(ends, i + 1))), lambda x: x.isNotNull() & (x < n))
    starts = F.array_union(F.array(F.lit(0)), after)

    def window(start: Column) -> Column:
        inside = F.filter(hits, lambda h: (h["at"] >= start) & (h["at"] < start + tokens))
        score = F.size(inside) + 999 * F.size(F.array_distinct(F.transform(inside, lambda h: h["phrase"])))
        first, last = F.get(inside, F.lit(0))["at"], F.element_at(inside, -1)
        spare = tokens - (last["at"] + last["size"] - first)
        moved = first - F.when(spare >= 0, F.floor(spare / 2)).otherwise(F.ceil(spare / 2)).cast("int")
        moved = F.greatest(F.lit(0), F.least(moved, n - tokens))
        return F.struct(score.cast("int").alias("score"), moved.cast("int").alias("start"))

    def of_hit(hit: Column) -> Column:
        """The windows that a hit offers, in the order in which the first of the best is taken."""
        own = window(hit["at"])
        head = F.coalesce(F.array_max(F.filter(starts, lambda s: s <= hit["at"])), F.lit(0)).cast("int")
        there = F.struct((window(head)["score"] + F.when(head == 0, 120).otherwise(100)).cast("int").alias("score"), head.alias("start"))
        return F.when((n > tokens) & (head < hit["at"]), F.array(own, there)).otherwise(F.array(own))

    found = F.flatten(F.transform(hits, of_hit))
    best = F.aggregate(found, F.struct(F.lit(0).alias("score"), F.lit(0).alias("start")), lambda a, w: F.when(w["score"] > a["score"], w).otherwise(a))

    def shown(start: Column) -> Column:
        end = F.least(start + tokens + 2, F.length(text))
        of = F.filter(hits, lambda h: (h["at"] >= start) & (h["at"] < start + tokens))
        covers = lambda c: F.exists(of, lambda h: (h["at"] <= c) & (c < h["at"] + h["size"] + 2))
        joins = lambda c: F.exists(of, lambda h: (h["at"] < c) & (c < h["at"] + h["size"] + 2))
        one = lambda c: F.concat(
            F.when((c > start) & covers(c - 1) & ~joins(c), marks[1]).otherwise(""), F.when(covers(c) & ~joins(c), marks[0]).otherwise(""), F.get(chars, c)
        )
        body = F.array_join(F.transform(F.sequence(start, end - 1), one), "")
        closed = F.when(covers(end - 1), marks[1]).otherwise("")
        return F.concat(F.when(start > 0, dots).otherwise(""), body, closed, F.when(start + tokens >= n, "").otherwise(dots))

    made = F.element_at(F.transform(F.array(best["start"]), shown), 1)
    short = F.when(F.size(hits) == 0, F.concat(F.substring(text, 1, tokens + 2), F.when(n > tokens, dots).otherwise("")))
    return F.when(F.length(text) == 0, "").otherwise(F.coalesce(short, made))


def read(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries(.., text) with error (null if it can be read) and n_phrases."""

    def each(batches):
        for batch in batches:
            errors, counts = [], []
            for query in batch.column(text).to_pylist():
                try:
                    counts.append(len(parse(query or "")[1]))
                    errors.append(None)
                except Unreadable as problem:
                    counts.append(0)
                    errors.append(str(problem))
            made = [pa.array(errors, pa.string()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "error", "n_phrases"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(each, f"{kinds}, error string, n_phrases int")
