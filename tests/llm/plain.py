"""Plain versions of the operators, row by row, for the tests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def contamination(text, items, window=10):
    """n_words, hit places, found item ids; items as (id, text)."""
    w = ALNUM.findall(lower(text))
    at = {}
    for name, item in items:
        v = ALNUM.findall(lower(item))
        m = min(window, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            at.setdefault(m, {}).setdefault(tuple(v[i : i + m]), set()).add(str(name))
    hit, found = set(), set()
    for m, windows in at.items():
        for i in range(len(w) - m + 1):
            if names := windows.get(tuple(w[i : i + m])):
                hit.update(range(i, i + m))
                found |= names
    return len(w), hit, found


def items_digest(found):
    return hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def shingle_set(text, size=5):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_components(docs, percent=85):
    """doc_id: (n_shingles, component_id); by all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by.values() for a in ds[:60] for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def passage_cover(docs, length=50):
    """For each document the places of words in a run of `length` words that another document has too."""
    tok = {d: SPACED.findall(lower(t)) for d, t in docs}
    by = {}
    for d, w in tok.items():
        for i in range(len(w) - length + 1):
            by.setdefault(tuple(w[i : i + length]), set()).add(d)
    return {d: {i + k for i in range(len(w) - length + 1) if len(by[tuple(w[i : i + length])]) > 1 for k in range(length)} for d, w in tok.items()}


class Bigrams:
    """Interpolated Witten-Bell model of order three, without quantisation."""

    def __init__(self, texts):
        self.c = [Counter(), Counter(), Counter()]
        for t in texts:
            s = ["<s>", *SPACED.findall(lower(t)), None]
            self.c[0].update(s[1:])
            self.c[1].update(zip(s, s[1:]))
            self.c[2].update(zip(s, s[1:], s[2:]))
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        self.kinds = [Counter(k[:-1] for k in c) for c in self.c[1:]]
        self.mass = [Counter(), Counter()]
        for i in (0, 1):
            for k, n in self.c[i + 1].items():
                self.mass[i][k[:-1]] += n

    def score(self, text):
        """n_tokens, n_known, base, model."""
        from math import log10

        s = ["<s>", *SPACED.findall(lower(text)), None]
        base = model = known = 0
        for i in range(1, len(s)):
            p = (self.c[0][s[i]] + 0.1) / (self.n + 0.1 * (self.v + 1))
            base, known = base + log10(p), known + (self.c[0][s[i]] > 0)
            for k in (1, 2):
                if i >= k and (t := self.kinds[k - 1][tuple(s[i - k : i])]):
                    p = (self.c[k][tuple(s[i - k : i + 1])] + t * p) / (self.mass[k - 1][tuple(s[i - k : i])] + t)
            model += log10(p)
        return len(s) - 1, known, base, model
