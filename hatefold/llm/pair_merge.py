"""Byte-pair merging with a heap and a linked list.

The adjacent pairs of a symbol list stand in a heap by (rank, place); popping
the lowest one merges two neighbours of a doubly linked list and pushes the two
new pairs. A popped pair whose symbols have changed since is stale and skipped.
n symbols take O(n log n), so one very long run of letters is no trap.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush


def merge(symbols: list, rank) -> list:
    """The symbols left after all merges. ``rank(a, b)`` is (order, merged) of a
    mergeable pair, else None; the lowest order goes first, ties to the left."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank(sym[i], sym[i + 1])
        if r is not None:
            heap.append((r[0], i, sym[i], sym[i + 1], r[1]))
    heapify(heap)
    while heap:
        _, i, a, b, new = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = new, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = rank(new, sym[k])
            if r is not None:
                heappush(heap, (r[0], i, new, sym[k], r[1]))
        h = before[i]
        if h >= 0:
            r = rank(sym[h], new)
            if r is not None:
                heappush(heap, (r[0], h, sym[h], new, r[1]))
    return [s for s in sym if s is not None]


def merge_count(symbols: list, rank) -> int:
    """How many symbols ``merge`` would leave: the initial ones minus the merges."""
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = rank.get
    heap, merges = [], 0
    for i in range(n - 1):
        r = get((sym[i], sym[i + 1]))
        if r is not None:
            heap.append((r[0], i, sym[i], sym[i + 1], r[1]))
    heapify(heap)
    while heap:
        _, i, a, b, new = heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        merges += 1
        sym[i], sym[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = get((new, sym[k]))
            if r is not None:
                heappush(heap, (r[0], i, new, sym[k], r[1]))
        h = before[i]
        if h >= 0:
            r = get((sym[h], new))
            if r is not None:
                heappush(heap, (r[0], h, sym[h], new, r[1]))
    return n - merges
