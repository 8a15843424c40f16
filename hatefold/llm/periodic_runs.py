"""Stretches of words that repeat with a period, by descending-LCP Kruskal.

The suffixes of a text's words are sorted (prefix doubling) and their longest common
prefixes taken. Neighbouring suffixes are united in the order of decreasing LCP by a
union-find whose classes are sorted sets of positions. When two classes unite at LCP
``l``, positions of the one that have a nearest position of the other at distance ``d``
share exactly ``l`` words with it, so ``d + l`` words have period ``d``: if that is a
run, it ends there, and reaches left as far as words ``d`` apart agree. The two first
positions of every run become neighbours at that moment, so no run is missed; of several
periods found for one stretch the smallest is the run's.

Most texts need none of this: a run of ``exponent`` periods has a word n-gram that
occurs ``exponent`` times in the text, or twice at a distance below n. Suffixes of other
classes are never united.

A text is one task's work and takes memory in proportion to it; nothing is shuffled.

Cases: a null, empty or blank text has no words and no runs; repeated rows and null ids
are judged row by row; very long texts are split into words a megabyte at a time; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa

from .common import SpanHash, same_runs, slices, text_buffer

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, runs array<{RUN}>, strongest {RUN}, collapsed string"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in lexicographic order; a suffix precedes those it begins."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    runs = same_runs(codes[order])
    head = np.repeat(runs[:-1], np.diff(runs))  # by place: the first place of its class
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    width, at = 1, np.arange(n)
    while True:
        first = head[at] == at
        at = at[~(first & np.append(first[1:], True))]  # classes of one are done
        if not len(at):
            return order
        pos = order[at]
        key = head[at] * (n + 2) + rank[np.minimum(pos + width, n)] + 1
        by = np.argsort(key, kind="stable")
        order[at] = pos = pos[by]
        runs = same_runs(key[by])
        head[at] = np.repeat(at[runs[:-1]], np.diff(runs))
        rank[pos] = head[at]
        width *= 2


def common_prefixes(codes: list, order: list) -> list:
    """By place: words that the suffix there shares with the one before."""
    n = len(codes)
    place = [0] * n
    for r, i in enumerate(order):
        place[i] = r
    codes, lcp, k = [*codes, -1], [0] * n, 0
    for i, r in enumerate(place):
        if not r:
            k = 0
            continue
        j = order[r - 1]
        while codes[i + k] == codes[j + k]:
            k += 1
        lcp[r] = k
        if k:
            k -= 1
    return lcp


def candidates(codes: np.ndarray, least: int, exponent: int):
    """Flags of the positions whose ``least`` words may begin a period of a run, or None."""
    n = len(codes)
    if n <= least:
        return None
    prints = SpanHash(codes).windows(least)
    ordered = np.sort(prints)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    order = np.argsort(prints, kind="stable")
    runs = same_runs(prints[order])
    near = np.zeros(len(order), bool)
    near[1:] = np.diff(order) < least
    near[runs[:-1]] = False
    good = (np.diff(runs) >= exponent) | np.logical_or.reduceat(near, runs[:-1])
    if not good.any():
        return None
    flags = np.zeros(n, bool)
    flags[order] = np.repeat(good, np.diff(runs))
    return flags


def find_runs(codes: np.ndarray, min_length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` words and
    ``exponent`` (2 or more) periods, by start and period."""
    least = min(max(min_length, exponent * q) - q for q in range(1, min_length + 2))
    flags = candidates(codes, least, exponent)
    if flags is None:
        return []
    order = suffix_order(codes)
    words, after = codes.tolist(), order.tolist()
    lcp = np.array(common_prefixes(words, after))
    joins = np.flatnonzero((lcp >= least) & flags[order])
    joins = joins[np.argsort(-lcp[joins], kind="stable")]

    up, members, seen, found = {}, {}, set(), {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def seed(x, d, shared):
        end = x + d + shared
        if (end, d) in seen or d + shared < min_length:
            return
        seen.add((end, d))
        while x and words[x - 1] == words[x - 1 + d]:
            x -= 1
        found[x, end] = min(d, found.get((x, end), d))

    for r, shared in zip(joins.tolist(), lcp[joins].tolist()):
        x, y = root(r - 1), root(r)
        small, large = members.pop(x, None) or [after[x]], members.pop(y, None) or [after[y]]
        if len(small) > len(large):
            small, large, x, y = large, small, y, x
        up[x] = y
        furthest = shared // (exponent - 1)
        for p in small:
            k = bisect_left(large, p)
            if k and p - large[k - 1] <= furthest:
                seed(large[k - 1], p - large[k - 1], shared)
            if k < len(large) and large[k] - p <= furthest:
                seed(p, large[k] - p, shared)
        if len(small) == 1:
            large.insert(k, p)
        else:
            large += small
            large.sort()  # two ascending stretches: merged
        members[y] = large
    return sorted((s, e - s, d) for (s, e), d in found.items())


class _Numbers(dict):
    """Words numbered by their first occurrence."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _pieces(data: bytes):
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + _PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def strongest(runs):
    """The run of the greatest length / period; ties: smallest start, then period."""
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best


def judge(data: bytes, min_length: int, exponent: int):
    """(runs, the words without the repeats of the runs, joined by one space)."""
    numbers = _Numbers()
    codes = np.array([c for piece in _pieces(data) for c in map(numbers.__getitem__, piece.split())], np.int64)
    runs = find_runs(codes, min_length, exponent)
    if not runs:
        return runs, b" ".join(filter(None, (b" ".join(piece.split()) for piece in _pieces(data))))
    depth = np.zeros(len(codes) + 1, np.int64)
    for s, n, p in runs:
        depth[s + p] += 1
        depth[s + n] -= 1
    kept = codes[np.cumsum(depth[:-1]) == 0]
    return runs, b" ".join(map(list(numbers).__getitem__, kept.tolist()))


def periodic_runs(docs, min_length: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: (doc_id, runs by start and period, strongest run or null, collapsed text).

    Words are what stands between the ASCII spaces. A run is a stretch of words with
    smallest period q, at least ``min_length`` and ``exponent`` * q long, that no word
    beside it continues; ``collapsed`` leaves out what follows a run's first period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: dict(zip(("start", "length", "period"), r))

    def judged(batches):
        for b in batches:
            data, off = text_buffer(b.column(1))
            for i, j in slices(off):
                out = [judge(data[off[k]:off[k + 1]].tobytes(), min_length, exponent) for k in range(i, j)]
                best = [strongest(r) for r, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).cast(pa.int64()), pa.array([list(map(as_row, r)) for r, _ in out], pa.list_(run)),
                     pa.array([x and as_row(x) for x in best], run), pa.array([t.decode() for _, t in out], pa.string())],
                    names=["doc_id", "runs", "strongest", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(judged, SCHEMA)
