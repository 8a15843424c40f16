"""Which fingerprints occur in more than one place, without dealing out every row.

Rows are packed into blocks; a block sends its fingerprints by hash bucket as one
32-bit array per bucket, each at most twice (twice: the block alone holds it in two
places). A bucket finds those that occur twice and answers each block that has them.
However common a fingerprint is, its bucket reads it twice per block at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import lowest, packed, same_runs

SHARED = "block long, bucket long, prints binary"
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def batch(rows, types, names) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def arrow(rows, types, names) -> pa.Table:
    return pa.Table.from_batches([batch(rows, types, names)])


def bucket_of(prints: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((prints & _LOW) % np.uint64(n_buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray):
    """(bucket, places) of each bucket that occurs."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    runs = same_runs(bucket[order])
    for a, z in zip(runs[:-1], runs[1:]):
        yield int(bucket[order[a]]), order[a:z]


def twice_at_most(prints: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One entry per (print, owner), but two per print at most."""
    order, runs, low = lowest(prints, owner)
    if not len(order):
        return prints
    p = prints[order[runs[:-1]]]
    return np.concatenate([p, p[np.maximum.reduceat(owner[order], runs[:-1]) != low]])


def _twice(table: pa.Table) -> pa.Table:
    prints = [np.frombuffer(p, np.uint32) for p in table.column("prints").to_pylist()]
    every = np.sort(np.concatenate(prints))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    if len(twice):
        for block, bucket, p in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), prints):
            hit = np.unique(p[twice[np.minimum(np.searchsorted(twice, p), len(twice) - 1)] == p])
            if len(hit):
                out.append((block, bucket, packed(hit)))
    return arrow(out, [pa.int64(), pa.int64(), pa.binary()], ["block", "bucket", "prints"])


def shared_prints(held, prints_of, n_buckets: int):
    """(block, bucket, prints) of the fingerprints of ``held`` (one row per block)
    that occur in two places. ``prints_of(row dict)`` -> (block, prints as uint64)."""

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                block, prints = prints_of(row)
                yield batch([(k, block, packed((prints[at] >> _32).astype(np.uint32))) for k, at in by_bucket(bucket_of(prints, n_buckets))],
                            [pa.int64(), pa.int64(), pa.binary()], ["bucket", "block", "prints"])

    return held.mapInArrow(send, "bucket long, block long, prints binary").groupBy("bucket").applyInArrow(_twice, SHARED)


def is_shared(answer: pa.Table, prints: np.ndarray, n_buckets: int) -> np.ndarray:
    """Which of a block's fingerprints its answer (rows of ``shared_prints``) holds."""
    if not answer.num_rows or not len(prints):
        return np.zeros(len(prints), bool)
    have = np.sort(np.concatenate([np.frombuffer(p, np.uint32).astype(np.uint64) << _32 | np.uint64(k)
                                   for k, p in zip(answer.column("bucket").to_pylist(), answer.column("prints").to_pylist())]))
    mine = (prints >> _32 << _32) | bucket_of(prints, n_buckets).astype(np.uint64)
    return have[np.minimum(np.searchsorted(have, mine), len(have) - 1)] == mine
