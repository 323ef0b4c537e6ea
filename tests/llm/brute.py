"""Plain Python twins of the operators, for small tables."""

import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
find_words = re.compile(r"[^\x20\x09-\x0D]+").findall
find_letters = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def lower(text):
    return (text or "").translate(LOWER)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = find_words(text)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {p for v in where.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if find_words(x)]
    n = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def shingles(text, k):
    w = find_words(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def groups(texts, k):
    """Component of each text: the least position reachable over links."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and find(i) != find(j) and 100 * (n := len(a & b)) >= 80 * (len(a) + len(b) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def windows(items):
    found = {}
    for item, text in items:
        w = find_letters(lower(text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    return found


def hits(text, found):
    """n_words, n_hit and the items of a text."""
    w, hit, items = find_letters(lower(text)), set(), set()
    for n in {len(k) for k in found}:
        for k in range(len(w) - n + 1):
            if here := found.get(tuple(w[k : k + n])):
                hit.update(range(k, k + n))
                items |= here
    return len(w), len(hit), sorted(items)


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0]))


class Katz:
    """The bigram model of katz.py, over lists of tokens."""

    def __init__(self, texts, discounts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            self.uni.update(t)
            self.bi.update(zip([1, *t[:-1]], t, strict=True))
        self.total = sum(self.uni.values())
        of = lambda c: [Counter(c.values())[r] for r in range(1, 7)]
        self.d1, self.d2 = discounts(of(self.uni)), discounts(of(self.bi))
        self.unseen = sum(self.lost(self.d1, c) for c in self.uni.values()) / self.total if self.total else 1.0
        self.history = {}
        for (h, w), c in self.bi.items():
            n, lost, share = self.history.get(h, (0, 0.0, 0.0))
            self.history[h] = n + c, lost + self.lost(self.d2, c), share + self.p(w)

    @staticmethod
    def lost(d, c):
        return d.loss[min(c, 6) - 1]

    def p(self, w):
        return (self.uni[w] - self.lost(self.d1, self.uni[w])) / self.total if self.uni[w] else self.unseen

    def q(self, h, w):
        if c := self.bi[h, w]:
            return (c - self.lost(self.d2, c)) / self.history[h][0]
        if h not in self.history:
            return self.p(w)
        n, lost, share = self.history[h]
        return lost / n / (1 - share) * self.p(w)
