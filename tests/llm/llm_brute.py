"""Plain Python versions of the corpus operators, and rows for their edge cases."""

import hashlib
import re
from collections import defaultdict

LONG = " ".join(f"w{i * 7919 % 9973}" for i in range(30_000))

#: (doc_id, text): nulls, empty and blank texts, ties, repeated rows, a very long text.
EDGE = [(1, None), (2, ""), (3, "   \n\t"), (4, "One two three four five six seven eight nine ten."), (5, "one two THREE four five six seven eight nine ten."),
        (5, "one two THREE four five six seven eight nine ten."), (None, "One two three four five six seven eight nine ten."), (7, LONG), (8, LONG + " end"),
        (9, "a"), (10, "é́ 中文 ß İ"), (11, ""), (None, None)]

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["digest", "uid", "block", "n", "sig", "prefix", "a", "b", "key", "token", "keep_id", "component", "line", "host", "v", "path"]


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    return df.withColumns({c: F.lit(c) for c in CLASHING}) if clash else df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def tie(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def near(rows, k, percent):
    """{doc_id: component}."""
    sets, u = [(i, shingles(t, k)) for i, t in rows if i is not None], Union()
    inverted = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        u.find(i)
        both = defaultdict(int)
        for g in s:
            for m in inverted[g]:
                both[m] += 1
            inverted[g].append(n)
        for m, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                u.tie(i, sets[m][0])
    return {i: u.find(i) for i, _ in sets}


def cut(rows, width=50):
    """Per row: the bytes that stay, and the flags of the removed ones."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - width + 1):
                s = b[p:p + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p:p + width]] < i:
                    gone[p:p + width] = b"\1" * width
        out.append((bytes(x for x, g in zip(b, gone) if not g), gone))
    return out


def cut_digest(rows, width=50):
    return [(i, len(g), sum(g), sum(1 for p in range(len(g)) if g[p] and not (p and g[p - 1])), hashlib.sha256(k).hexdigest())
            for (i, _), (k, g) in zip(rows, cut(rows, width))]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
