"""How far the sources of a language differ in their use of words, by a recount over
minimal perfect hashes.

A first pass counts, exactly, in how many documents of each language a term occurs, and
keeps the frequent terms. These are dealt into shards of some thousand; each shard gets
a minimal perfect hash (levels of bit arrays; a key's slot is the rank of the first bit
that it holds alone) beside its keys in slot order. The hashes are broadcast and a
second pass over all texts adds up dense slots for each group of language and source: a
term's slot counts only if the key stored there is the term. If the hashes together
exceed ``broadcast_bytes``, they are broadcast in as many rounds, each a pass.

Groups are then compared shard by shard in tiles of some sources, so that no
task holds more than two tiles of one shard. Slots are folded in streams, salted first.
All arithmetic is exact: counts up to 9 * 10**15 in 64-bit integers.

Cases: null lang, source and text are ''; a group without terms is compared all the same
and a language without kept terms gives pairs of value 0; documents that share an id are
documents each; very long texts are taken a megabyte at a time; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import SpanHash, mix64, same_runs, written

#: Terms of a shard on average (slots are 16 bits wide), sources of a tile.
SHARD_KEYS = 8192
TILE = 64
SALTS = 16
BROADCAST_BYTES = 64 << 20
#: Counts held by a task before they are folded, and slots before they are sent.
HELD_TERMS, HELD_SLOTS = 200_000, 4_000_000
LEVELS = 48
SCALE = 1_000_000_000

#: Byte -> itself in a term (letters lower-cased, bytes of non-ASCII characters), else a space.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PIECE = 1 << 20


def terms_of(text: str | None):
    """The terms of a text, a list for each megabyte."""
    data = (text or "").encode().translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _strings(keys) -> pa.Array:
    return pa.array(keys, pa.binary()).cast(pa.string())


def _term_documents(batches):
    held, size = {}, 0

    def flush():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), _strings(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = set()
            for terms in terms_of(text):
                own.update(terms)
            counts = held.setdefault(lang, Counter())
            size -= len(counts)
            counts.update(own)
            size += len(counts)
            if size >= HELD_TERMS:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def kept_terms(docs, min_documents: int):
    """(lang, term) of the terms in at least ``min_documents`` documents of the language."""
    return (docs.select("lang", "text").mapInArrow(_term_documents, "lang string, term string, n long")
            .groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_documents).select("lang", "term"))


# ------------------------------------------------------------ perfect hashes

def prints(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of binary keys."""
    keys = keys.cast(pa.large_binary())
    _, ends, data = keys.buffers()
    ends = np.frombuffer(ends, np.int64)[keys.offset:keys.offset + len(keys) + 1]
    if not len(keys):
        return np.zeros(0, np.uint64)
    return SpanHash(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8))(ends[:-1] - ends[0], ends[1:] - ends[0])


def _place(marks: np.ndarray, level: int, width: int) -> np.ndarray:
    return (mix64(marks + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(width)).astype(np.int64)


class PerfectHash:
    """Keys -> slots 0 .. n-1 without gaps. Keys whose 64-bit hashes never part, if any,
    come last and are found by comparison."""

    def __init__(self, widths, bits: np.ndarray, keys: pa.Array):
        self.widths, self.bits, self.keys = widths, bits, keys
        self.rank = np.cumsum(bits, dtype=np.int64) - bits
        placed = int(bits.sum())
        self.rest = {k: placed + i for i, k in enumerate(keys[placed:].to_pylist())}

    @classmethod
    def build(cls, keys: pa.Array, levels: int = LEVELS) -> "PerfectHash":
        keys = keys.cast(pa.binary())
        left, marks = np.arange(len(keys)), prints(keys)
        widths, bits, order = [], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        while len(left) and len(widths) < levels:
            width = 2 * len(left) + 1
            at = _place(marks[left], len(widths), width)
            alone = np.bincount(at, minlength=width) == 1
            sole = alone[at]
            order.append(left[sole][np.argsort(at[sole])])
            left = left[~sole]
            widths.append(width)
            bits.append(alone)
        order = np.concatenate([*order, left])
        return cls(widths, np.concatenate(bits), keys.take(pa.array(order)))

    def slots(self, keys: pa.Array, marks: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        slot = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, width in enumerate(self.widths):
            at = base + _place(marks[left], level, width)
            hit = self.bits[at]
            slot[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + width
        stored = pc.equal(self.keys.take(pa.array(np.maximum(slot, 0))), keys) if len(self.keys) else pa.array([False] * len(keys))
        slot[~stored.to_numpy(zero_copy_only=False)] = -1
        if self.rest:
            for i in np.flatnonzero(slot < 0):
                slot[i] = self.rest.get(keys[i].as_py(), -1)
        return slot

    def packed(self) -> dict:
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(self.keys).to_numpy(zero_copy_only=False))])
        return {"n_keys": len(self.keys), "widths": self.widths, "bits": np.packbits(self.bits).tobytes(),
                "key_ends": offsets.astype(np.int32).tobytes(), "keys": b"".join(self.keys.to_pylist())}

    @classmethod
    def unpacked(cls, row) -> "PerfectHash":
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["widths"])).astype(bool)
        return cls(row["widths"], bits, stored_keys(row))


def stored_keys(row) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), row["n_keys"], [None, pa.py_buffer(row["key_ends"]), pa.py_buffer(row["keys"])])


HASH = "lang string, shard int, n_keys int, widths array<int>, bits binary, key_ends binary, keys binary"
_HASH = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n_keys", pa.int32()), ("widths", pa.list_(pa.int32())), ("bits", pa.binary()), ("key_ends", pa.binary()), ("keys", pa.binary())])


def _deal(batches):
    for b in batches:
        shard = prints(b.column(1)) % b.column(2).to_numpy().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard.astype(np.int32)), b.column(1)], names=["lang", "shard", "term"])


def _build(table: pa.Table) -> pa.Table:
    made = PerfectHash.build(table.column("term").combine_chunks())
    return pa.Table.from_pylist([{"lang": table.column("lang")[0].as_py(), "shard": table.column("shard")[0].as_py()} | made.packed()], _HASH)


def perfect_hashes(kept, sizes):
    """One row per shard of a language's kept terms."""
    return (kept.join(sizes, "lang").select("lang", "term", "n_shards").mapInArrow(_deal, "lang string, shard int, term string")
            .groupBy("lang", "shard").applyInArrow(_build, HASH))


# -------------------------------------------------------------- second pass

CELL = "lang string, source string, shard int, salt int, slots binary, counts binary"


def _cells(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "source", "shard", "salt", "slots", "counts"])


def _cell(lang, source, shard, salt, counts: np.ndarray):
    slots = np.flatnonzero(counts)
    return lang, source, shard, salt, slots.astype(np.uint16).tobytes(), counts[slots].astype(np.int64).tobytes()


def _recount(hashes):
    """``hashes``: a broadcast of (rows of this round's shards, {lang: number of shards})."""

    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        found, shards = hashes.value
        found = {(r["lang"], r["shard"]): PerfectHash.unpacked(r) for r in found}
        held, dense, size, slots_held = {}, {}, 0, 0

        def fold():
            nonlocal slots_held
            for (lang, source), counts in held.items():
                if not counts or lang not in shards:
                    continue
                keys, n = pa.array(list(counts), pa.binary()), np.array(list(counts.values()), np.int64)
                marks = prints(keys)
                shard = (marks % np.uint64(shards[lang])).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                runs = same_runs(shard[order])
                for a, z in zip(runs[:-1], runs[1:]):
                    at = order[a:z]
                    own = found.get((lang, int(shard[at[0]])))
                    if own is None:
                        continue
                    slot = own.slots(keys.take(pa.array(at)), marks[at])
                    cell = lang, source, int(shard[at[0]])
                    if cell not in dense:
                        dense[cell] = np.zeros(len(own.keys), np.int64)
                        slots_held += len(own.keys)
                    dense[cell][slot[slot >= 0]] += n[at[slot >= 0]]
                    if slots_held >= HELD_SLOTS:
                        yield from flush()
            held.clear()

        def flush():
            nonlocal slots_held
            rows = [_cell(*cell, salt, counts) for cell, counts in dense.items() if counts.any()]
            dense.clear()
            slots_held = 0
            for i in range(0, len(rows), 64):
                yield _cells(rows[i:i + 64])

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                counts = held.get((lang, source))
                if counts is None:
                    counts = held[lang, source] = Counter()
                for terms in terms_of(text):
                    size -= len(counts)
                    counts.update(terms)
                    size += len(counts)
                    if size >= HELD_TERMS:
                        yield from fold()
                        size, counts = 0, held.setdefault((lang, source), Counter())
        yield from fold()
        yield from flush()

    return run


def _fold(batches):
    """Adds up the cells of equal keys that follow each other."""
    here, total, rows = None, None, []
    for b in batches:
        for *key, slots, counts in zip(*(b.column(c).to_pylist() for c in range(6))):
            slots = np.frombuffer(slots, np.uint16)
            if key != here:
                if here:
                    rows.append(_cell(*here, total))
                    if len(rows) >= 64:
                        yield _cells(rows)
                        rows = []
                here, total = key, np.zeros(0, np.int64)
            if len(slots) and slots[-1] >= len(total):
                total = np.append(total, np.zeros(slots[-1] + 1 - len(total), np.int64))
            total[slots] += np.frombuffer(counts, np.int64)
    if here:
        yield _cells([*rows, _cell(*here, total)])


def folded(cells, keep):
    """Cells with equal ``keep`` columns added up; the other key columns become null."""
    columns = [F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("shard", "int"), ("salt", "int"))]
    return cells.repartition(*keep).select(*columns, "slots", "counts").sortWithinPartitions(*keep).mapInArrow(_fold, CELL)


def rounds(hashes, limit: int):
    """Lists of (lang, shard), each of about ``limit`` bytes at most. A shard of some
    thousand terms is one small row here."""
    out, size = [[]], 0
    for r in hashes.select("lang", "shard", (F.length("keys") + F.length("key_ends") + F.length("bits")).alias("size")).orderBy("lang", "shard").toLocalIterator():
        if out[-1] and size + r["size"] > limit:
            out.append([])
            size = 0
        out[-1].append((r["lang"], r["shard"]))
        size += r["size"]
    return out


def recount(docs, hashes, sizes, broadcast_bytes: int = BROADCAST_BYTES):
    """(lang, source, shard, slots, counts): the occurrences of the stored terms in each
    group, slots without any left out."""
    spark, cells = docs.sparkSession, None
    for keys in rounds(hashes, broadcast_bytes):
        if not keys:
            return spark.createDataFrame([], CELL)
        low, high = keys[0], keys[-1]
        key = F.struct("lang", "shard")
        rows = hashes.filter((key >= F.struct(F.lit(low[0]).alias("lang"), F.lit(low[1]).alias("shard"))) & (key <= F.struct(F.lit(high[0]).alias("lang"), F.lit(high[1]).alias("shard")))).collect()
        langs = {r["lang"] for r in rows}
        n_shards = {r["lang"]: r["n_shards"] for r in sizes.join(hashes.select("lang").distinct(), "lang").toLocalIterator() if r["lang"] in langs}
        sent = spark.sparkContext.broadcast(([r.asDict() for r in rows], n_shards))
        part = folded(folded(docs.select("lang", "source", "text").mapInArrow(_recount(sent), CELL), ["lang", "source", "shard", "salt"]), ["lang", "source", "shard"])
        cells = part if cells is None else cells.unionByName(part)
    return cells


# --------------------------------------------------------------- comparison

def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), a thousand at a time."""
    whole, left, below = np.zeros_like(counts), counts + 2, total + 2 * terms
    for _ in range(3):
        left = left * 1000
        whole, left = whole * 1000 + left // below, left % below
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compare(top: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next((r for r in rows if r["source"] is None), None)
        groups = [r for r in rows if r["source"] is not None]
        if not groups:
            return _FOUND.empty_table()
        n_keys = groups[0]["n_keys"] or 0
        counts = np.zeros((len(groups), n_keys), np.int64)
        for i, r in enumerate(groups):
            if r["slots"]:
                counts[i, np.frombuffer(r["slots"], np.uint16)] = np.frombuffer(r["counts"], np.int64)
        p = np.array([shares(c, r["total"], r["terms"]) for c, r in zip(counts, groups)]).reshape(counts.shape)
        lang, names, tiles = groups[0]["lang"], [r["source"] for r in groups], np.array([r["tile"] for r in groups])
        within, out = groups[0]["one"] == groups[0]["two"], []
        for i in range(len(groups)):
            value = divergence(p, p[i]).sum(axis=1)
            others = np.flatnonzero((tiles != tiles[i]) | within)
            out += [(lang, names[i], "pair", names[j], int(value[j])) for j in others if j != i]
        if head is not None and n_keys:
            overall = np.zeros(n_keys, np.int64)
            overall[np.frombuffer(head["slots"], np.uint16)] = np.frombuffer(head["counts"], np.int64)
            q = shares(overall, head["total"], head["terms"])
            keys = stored_keys(head)
            for i in range(len(groups)):
                more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                f = divergence(p[i, more], q[more])
                if len(more) > top:
                    tie = np.partition(f, -top)[-top]
                    more, f = more[f >= tie], f[f >= tie]
                best = sorted(zip((-f).tolist(), keys.take(pa.array(more)).to_pylist()))[:top]
                out += [(lang, names[i], "term", k.decode(), -v) for v, k in best]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, _FOUND.types)], schema=_FOUND)

    return run


def audit(docs, min_documents: int = 10, top: int = 10, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, tile: int = TILE):
    """(lang, source, part, item, value, rank). ``pair``: every other source of the
    language and how far the two differ; ``term``: the ``top`` terms that a source uses
    more than its language does. Ranks by falling value, then item."""
    if not 0 < shard_keys <= 1 << 15:
        raise ValueError("shard_keys must leave room in 16-bit slots")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), "text")
    kept = written(kept_terms(docs, min_documents), "terms")
    sizes = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")).withColumn("n_shards", F.ceil(F.col("terms") / shard_keys).cast("int")), "vocabularies")
    hashes = written(perfect_hashes(kept, sizes), "hashes")
    cells = written(recount(docs, hashes, sizes, broadcast_bytes).select("lang", "source", "shard", "slots", "counts", F.expr("length(counts) div 8").alias("n")), "slots")

    totals = written(cells.mapInArrow(_totals, "lang string, source string, total long").groupBy("lang", "source").agg(F.sum("total").alias("total")), "totals")
    n_tiles = F.ceil(F.col("sources") / tile).cast("int")
    sources = docs.select("lang", "source").distinct()
    langs = (sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(totals.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang", "left")
             .join(sizes, "lang", "left").select("lang", n_tiles.alias("tiles"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
                                                 F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("n_shards", F.lit(1)).alias("n_shards")))
    langs = written(langs, "languages")
    # Each group has a cell in every shard of its language, be it without counts.
    groups = (sources.join(langs, "lang").join(totals, ["lang", "source"], "left")
              .select("lang", "source", "terms", "tiles", F.coalesce("total", F.lit(0)).alias("total"), F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"),
                      F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)).alias("shard")))
    full = groups.join(cells.drop("n"), ["lang", "source", "shard"], "left").join(hashes.select("lang", "shard", "n_keys"), ["lang", "shard"], "left")
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    names = ["lang", "shard", "one", "two", "source", "terms", "total", "tile", "n_keys", "slots", "counts", "key_ends", "keys"]
    empty = [F.lit(None).cast("binary").alias(c) for c in ("key_ends", "keys")]
    sides = full.select("*", others).select("*", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), *empty).select(*names)
    overall = folded(cells.drop("n").withColumn("salt", F.lit(0)), ["lang", "shard"]).select("lang", "shard", "slots", "counts")
    heads = (overall.join(hashes.drop("widths", "bits"), ["lang", "shard"]).join(langs, "lang").select("*", others)
             .select("lang", "shard", F.col("other").alias("one"), F.col("other").alias("two"), F.lit(None).cast("string").alias("source"), "terms", F.col("lang_total").alias("total"),
                     F.col("other").alias("tile"), "n_keys", "slots", "counts", "key_ends", "keys").select(*names))
    found = written(sides.unionByName(heads).groupBy("lang", "shard", "one", "two").applyInArrow(_compare(top), "lang string, source string, part string, item string, value long"), "found")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def _totals(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([int(np.frombuffer(c, np.int64).sum()) for c in b.column(4).to_pylist()], pa.int64())], names=["lang", "source", "total"])
