"""Exact dedup with a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z; the SHA-256 of
the normalised text stands for it. Each input task first folds its own rows into
one entry per digest, so a text that a third of all rows hold reaches its bucket
once per task. The entries are dealt by digest; each task keeps a cuckoo filter
over the digests live in its share, with the stored keys beside it in buckets:

* no hit: the digest is new, it is inserted;
* hit: verified against the stored keys; if it is there and the new row has the
  larger id, the live entry is deleted and the new one inserted;
* overflow: the filter doubles and is refilled from the stored keys.

Cases: null counts as the empty text, and empty texts are equal to each other; of
equal texts the largest id stays, a null id counts as the smallest; of repeated
rows with one id and text exactly one is kept; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from .common import ascii_lower, written

SLOTS = 4
MAX_KICKS = 200

ENTRY = "digest binary, keep_id long, keep_uid long, group_size long, keep_rows long"


class CuckooIndex:
    """A cuckoo filter (4 slots of 16-bit fingerprints) over stored digests. An
    entry of the store is [id, uid, rows, rows with that id]."""

    def __init__(self, buckets: int = 1024):
        self.store: dict[int, list] = {}  # filter bucket hash -> [(digest, entry)]
        self.size = 0
        self._empty(buckets)

    def _empty(self, buckets: int):
        self.mask = buckets - 1
        self.slots = [0] * (buckets * SLOTS)

    @staticmethod
    def _hash(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:10], "little") or 1

    def _places(self, h: int, fp: int) -> tuple[int, int]:
        i = h & self.mask
        return i, (i ^ (fp * 0x5BD1E995)) & self.mask

    def maybe(self, digest: bytes) -> bool:
        h, fp = self._hash(digest)
        i, j = self._places(h, fp)
        return fp in self.slots[i * SLOTS:i * SLOTS + SLOTS] or fp in self.slots[j * SLOTS:j * SLOTS + SLOTS]

    def _put(self, h: int, fp: int) -> bool:
        i, j = self._places(h, fp)
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.slots[s]:
                    self.slots[s] = fp
                    return True
        b = i
        for kick in range(MAX_KICKS):
            s = b * SLOTS + kick % SLOTS
            fp, self.slots[s] = self.slots[s], fp
            b = (b ^ (fp * 0x5BD1E995)) & self.mask
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.slots[s]:
                    self.slots[s] = fp
                    return True
        return False

    def _grow(self):
        buckets = (self.mask + 1) * 2
        while True:
            self._empty(buckets)
            if all(self._put(*self._hash(d)) for kept in self.store.values() for d, _ in kept):
                return
            buckets *= 2

    def find(self, digest: bytes):
        """The verified entry of a live digest, or None."""
        if not self.maybe(digest):
            return None
        return next((e for d, e in self.store.get(self._hash(digest)[0], ()) if d == digest), None)

    def insert(self, digest: bytes, entry: list):
        h, fp = self._hash(digest)
        self.store.setdefault(h, []).append((digest, entry))
        self.size += 1
        if not self._put(h, fp):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        entry = self.find(digest)
        if entry is None:
            return False
        h, fp = self._hash(digest)
        kept = [x for x in self.store[h] if x[0] != digest]
        if kept:
            self.store[h] = kept
        else:
            del self.store[h]
        for b in self._places(h, fp):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slots[s] == fp:
                    self.slots[s] = 0
                    self.size -= 1
                    return True
        raise AssertionError("a stored digest has no fingerprint")

    def live(self):
        for kept in self.store.values():
            yield from kept


def merge_entry(index: CuckooIndex, digest: bytes, new: list):
    """Insert, or fold into the live entry of an equal text."""
    old = index.find(digest)
    if old is None:
        index.insert(digest, new)
        return
    key = lambda e: (e[0] is not None, e[0] or 0, -e[1])  # noqa: E731  the largest id, then the first row
    best = new if key(new) > key(old) else old
    rows = old[2] + new[2]
    same = old[3] + new[3] if old[0] == new[0] else best[3]
    if best is new:
        index.delete(digest)
        index.insert(digest, [new[0], new[1], rows, same])
    else:
        old[2], old[3] = rows, same


def _entries(index: CuckooIndex):
    rows = [(d, *e) for d, e in index.live()]
    for i in range(0, len(rows), 10_000):
        part = list(zip(*rows[i:i + 10_000]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.binary()), *(pa.array(c, pa.int64()) for c in part[1:])],
                                         names=["digest", "keep_id", "keep_uid", "group_size", "keep_rows"])


def _fold_rows(batches, limit=200_000):
    """(digest, id, uid) rows -> one entry per digest and task (or per ``limit`` digests)."""
    index = CuckooIndex()
    for b in batches:
        for digest, doc, uid in zip(*(b.column(k).to_pylist() for k in range(3))):
            merge_entry(index, digest, [doc, uid, 1, 1])
        if index.size >= limit:
            yield from _entries(index)
            index = CuckooIndex()
    yield from _entries(index)


def _fold_entries(batches):
    index = CuckooIndex()
    for b in batches:
        for digest, *entry in zip(*(b.column(k).to_pylist() for k in range(5))):
            merge_entry(index, digest, entry)
    yield from _entries(index)


def digests(docs, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, digest, uid): SHA-256 of each normalised text, and a row number
    that only tells repeated rows apart."""
    text = ascii_lower(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("uid"))


def live_index(rows):
    """The index after all rows: (digest, keep_id, keep_uid, group_size, keep_rows)."""
    return rows.select("digest", "doc_id", "uid").mapInArrow(_fold_rows, ENTRY).repartition("digest").mapInArrow(_fold_entries, ENTRY)


def exact_dedup(docs, id_col: str = "doc_id", text_col: str = "text"):
    """Per row: (doc_id, keep_id, group_size, kept, text_sha256)."""
    rows = written(digests(docs, id_col, text_col), "digests")
    return (rows.join(live_index(rows), "digest")
            .select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_one(docs, id_col: str = "doc_id", text_col: str = "text"):
    """The rows of ``docs`` that stay, with all their columns."""
    index = live_index(digests(docs, id_col, text_col)).select(
        F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("keep_rows").alias("__rows"))
    text = ascii_lower(docs[text_col])
    columns = docs.columns
    kept = docs.join(index, (F.unhex(F.sha2(text, 256)) == F.col("__digest")) & docs[id_col].eqNullSafe(F.col("__keep")))
    once = kept.filter("__rows = 1").select(*columns)
    again = kept.filter("__rows > 1").dropDuplicates(["__digest"]).select(*columns)
    return once.unionByName(again)
