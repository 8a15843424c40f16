"""Helpers shared by the corpus operators: Arrow text buffers, position-free
substring hashes, per-worker caches and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import scratch_path

#: Text is handled in slices of about this many bytes, so that the numpy
#: arrays of one step stay small whatever the size of an Arrow batch. One
#: longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 1000


@contextlib.contextmanager
def small_batches(spark):
    """Arrow batches of BATCH_ROWS rows at most while a job runs (a batch of 10,000
    long documents would be held several times over); the caller's setting returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df, name: str, **options):
    """``df`` as a Parquet table in the cluster's shared folder, read back: cuts
    the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """A-Z lower-cased and nothing else, null as empty (JVM side)."""
    return F.translate(F.coalesce(col, F.lit("")), _UPPER, _UPPER.lower())


def worker_cache(name: str, make):
    """One object per Python worker process, kept from task to task."""
    import pyspark

    store = vars(pyspark).setdefault("_hatefold_worker_cache", {})
    if name not in store:
        store[name] = make()
    return store[name]


#: Small tables that most operators use.
COMMON = ("powers", "mixed-bytes")


def released(run, *keep: str):
    """``run``, a function for ``mapInArrow``, in tasks that leave their worker small.
    Workers live as long as the session, and what one operator leaves there stands beside
    the next one's work: objects cached under other names than ``keep`` and COMMON go
    before the task, and memory that the allocators hold unused goes back before and after it."""

    def task(batches):
        import pyspark

        store = vars(pyspark).setdefault("_hatefold_worker_cache", {})
        for name in store.keys() - {*keep, *COMMON}:
            store.pop(name, None)
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back():
    """Returns unused memory of Arrow and of the C library (where that can) to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (UTF-8 bytes, offsets); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


# ------------------------------------------------------------------ hashing

_MULT = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_INV = pow(_MULT, -1, 1 << 64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    return _mix(x.astype(np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    """In place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = worker_cache("powers", dict)
    if len(have.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _MULT, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        have["up"], have["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have["up"][:n], have["down"][:n]


class SpanHash:
    """64-bit hashes of any spans of a sequence of codes, equal for equal spans
    wherever they stand: prefix sums of code * M**i, shifted back by M**-start."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        if codes.dtype == np.uint8:
            mixed = worker_cache("mixed-bytes", lambda: mix64(np.arange(256, dtype=np.uint64) + _GOLD))[codes]
        else:
            mixed = mix64(codes.astype(np.uint64) + _GOLD)
        mixed *= up[:n]
        np.cumsum(mixed, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, w: int) -> np.ndarray:
        """The hashes of all spans of ``w`` codes, by start."""
        out = self.sums[w:] - self.sums[:-w]
        out *= self.down[:len(out)]
        out += np.uint64(w)
        return _mix(out)


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def lowest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, starts of the runs of equal keys and the end, lowest value of each run)."""
    order = np.argsort(key)
    runs = same_runs(key[order])
    return order, runs, np.minimum.reduceat(value[order], runs[:-1]) if len(order) else value


def same_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end: [s0, s1, ..., n]."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
