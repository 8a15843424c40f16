"""Near-duplicate join on word n-grams by a grouped prefix join.

Two documents link when the Jaccard similarity of their sets of word n-grams
(64-bit hashes) is at least ``percent`` / 100. The steps:

1. Equal sets are one class; its smallest id stands for it.
2. All sets are sorted by one order: rare n-grams by hash, frequent ones last, by
   count. (Frequent: in ``min_count`` texts; blocks of texts send their n-grams to be
   counted, as 32 bits each. The order only steers the work: any order gives the same
   links. The ``FREQUENT`` most frequent ones are broadcast, 16 MB at most.) Two linked
   sets share an n-gram among the first n - ceil(percent * n / 100) + 1 of each.
3. Classes with identical prefixes and size collapse into one group. Only n-grams
   that stand in the prefixes of two groups are dealt out (``shared``).
4. Group pairs are filtered by size, by the places of the shared n-gram and by the
   number of n-grams that the prefixes share, and expanded to their members: first to
   one of each component, then, where components still differ, to all. A parity bitmap of each set bounds the overlap of a
   pair from above (a differing bit stands for at least one n-gram that only one
   side has); pairs that can still link are verified over the whole texts. First
   each n-gram's groups are compared with its smallest group alone, and then with other
   single ones while lists stay long; that is linear and joins most groups of copies.
   Links make components, and only pairs of different components remain. No link between different components is lost.

Cases: null and empty texts, and texts without words, have empty sets and link with
nothing; fewer than n words are one n-gram; a null id links with nothing and has no
component; rows that share an id are one node, linked if any of their texts is;
repeated rows are returned each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import SpanHash, mix64, packed, released, slices, small_batches, text_buffer, written
from .components import components
from .shared import arrow, batch, bucket_of, by_bucket, is_shared, shared_prints, twice_at_most

FREQUENT = 1 << 21
COUNTED = 1 << 20
BLOCK_TOKENS = 1 << 19
BUCKET_TOKENS = 1 << 20
MIN_BITS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(buf: np.ndarray, off: np.ndarray):
    """(hash, document number) of the words of the texts, in order."""
    low = _LOWER[buf]
    inside = ~_BLANK[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    a, z = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return SpanHash(low)(a, z), np.searchsorted(off, a, "right") - 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int):
    """(hashes, bounds): document d has the distinct, sorted hashes[bounds[d]:bounds[d + 1]]."""
    n_docs = len(off) - 1
    if off[-1] == off[0]:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    words, doc = word_hashes(buf[off[0]:off[-1]], off - off[0])
    n = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(n_docs), count)
    at = np.arange(len(of)) + np.repeat(begin - (np.cumsum(count) - count), count)
    size = np.minimum(n, k)[of]
    sets = mix64(size.astype(np.uint64))
    for j in range(k):
        more = size > j
        sets = np.where(more, mix64(sets * np.uint64(0x9E3779B97F4A7C15) + words[np.where(more, at + j, 0)]), sets)
    order = np.argsort(sets)
    order = order[np.argsort(of[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")]
    sets, of = sets[order], of[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (of[1:] != of[:-1])
    sets, of = sets[new], of[new]
    return sets, np.searchsorted(of, np.arange(n_docs + 1))


def _often(grams: np.ndarray, min_count: int):
    """(gram, count) of what occurs ``min_count`` times or more; sorts ``grams`` in place."""
    grams.sort()
    last = len(grams) - min_count + 1
    if last <= 0:
        return grams[:0], np.zeros(0, np.int64)
    begins = grams[:last] == grams[min_count - 1:]
    begins[1:] &= grams[1:last] != grams[:last - 1]
    often = grams[:last][begins]
    return often, np.searchsorted(grams, often, "right") - np.flatnonzero(begins)


def gram_id(grams: np.ndarray, n_buckets: int) -> np.ndarray:
    """32 bits and the bucket of each n-gram, by which it is counted and ordered."""
    return (grams >> np.uint64(32) << np.uint64(32)) | bucket_of(grams, n_buckets).astype(np.uint64)


def frequent_order(docs, text_col: str, k: int, min_count: int = 4) -> tuple[np.ndarray, int]:
    """(ids, number of buckets) of the most frequent n-grams, rarest first: those above
    the lowest count, by eighths of a power of two, that leaves FREQUENT of them at most.
    Each block of texts sends its n-grams once, with their counts up to 255 there."""
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    n_buckets = max(64, n_bytes // (8 * BUCKET_TOKENS))

    def send(batches):
        from pyspark import TaskContext

        # one buffer, sorted in place, in which only the used part takes memory
        block, held, size = TaskContext.get().partitionId() << 32, np.empty(COUNTED, np.uint64), 0

        def out():
            grams, n = _often(held[:size], 1)
            n = np.minimum(n, 255).astype(np.uint8)
            prints = (grams >> np.uint64(32)).astype(np.uint32)
            rows = [(bucket, block, packed(prints[at]), packed(n[at])) for bucket, at in by_bucket(bucket_of(grams, n_buckets))]
            return batch(rows, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "block", "prints", "n"])

        for b in batches:
            buf, off = text_buffer(b.column(0))
            for i, j in slices(off):
                grams = shingle_sets(buf, off[i:j + 1], k)[0]
                while len(grams):
                    part, grams = grams[:COUNTED - size], grams[COUNTED - size:]
                    held[size:size + len(part)] = part
                    size += len(part)
                    if size == COUNTED:
                        yield out()
                        block, size = block + 1, 0
        if size:
            yield out()

    def count(rows: pa.Table) -> pa.Table:
        prints = np.concatenate([np.frombuffer(p, np.uint32) for p in rows.column("prints").to_pylist()])
        times = np.concatenate([np.frombuffer(p, np.uint8) for p in rows.column("n").to_pylist()])
        often, n = _often(np.repeat(prints, times), min_count)
        level = np.floor(np.log2(np.maximum(n, 1)) * 8).astype(np.int64)
        bucket = rows.column("bucket")[0].as_py()
        return arrow([(bucket, at, len(of), packed(often[of])) for at, of in by_bucket(level)],
                     [pa.int64()] * 3 + [pa.binary()], ["bucket", "level", "n", "prints"])

    counts = written(docs.select(text_col).mapInArrow(released(send), "bucket long, block long, prints binary, n binary")
                     .groupBy("bucket").applyInArrow(count, "bucket long, level long, n long, prints binary"), "gram-counts")
    cut, room = None, FREQUENT
    for at, n in sorted(counts.groupBy("level").agg(F.sum("n")).collect(), reverse=True):  # some 500 levels at most
        if n > room:
            break
        cut, room = at, room - n
    if cut is None:
        return np.zeros(0, np.uint64), n_buckets
    top = counts.filter(F.col("level") >= cut).select("bucket", "level", "prints").toPandas()
    ids = np.concatenate([np.frombuffer(p, np.uint32).astype(np.uint64) << np.uint64(32) | np.uint64(b) for b, p in zip(top["bucket"], top["prints"])])
    return ids[np.lexsort((ids, np.repeat(top["level"].to_numpy(), [len(p) // 4 for p in top["prints"]])))], n_buckets


class GramOrder:
    """Sort keys of n-grams: rare ones by hash, frequent ones after them by rank."""

    def __init__(self, frequent: np.ndarray, n_buckets: int):
        self.n_buckets = n_buckets
        self.order = np.argsort(frequent).astype(np.uint32)
        self.sorted = frequent[self.order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(frequent >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        keys = grams >> np.uint64(1)
        maybe = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        if len(maybe):
            g = gram_id(grams[maybe], self.n_buckets)
            at = np.minimum(np.searchsorted(self.sorted, g), len(self.sorted) - 1)
            hit = self.sorted[at] == g
            keys[maybe[hit]] = np.uint64(1 << 63) | self.order[at[hit]].astype(np.uint64)
        return keys


def parity_bitmaps(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, bounds): a bitmap per set; bit h is the parity of the n-grams
    hashed to it. A set has at least as many bits as n-grams, by powers of two, and
    the xor of a bitmap's halves is the bitmap of half the size."""
    n = np.diff(bounds)
    bits = MIN_BITS << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / MIN_BITS)), 0).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(bits)])
    of = np.repeat(np.arange(len(n)), n)
    cell = start[:-1][of] + ((sets >> np.uint64(30)).astype(np.int64) & (bits[of] - 1))
    odd = (np.bincount(cell, minlength=int(start[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), start // 64


def prefixes(docs, frequent, id_col, text_col, k, percent):
    """(doc_id, n, sig, prefix, bits): size, 128-bit signature, prefix (as 32-bit
    hashes, which only steer the search) and parity bitmap of each set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        order = GramOrder(*shared.value)
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in slices(off):
                sets, bounds = shingle_sets(buf, off[i:j + 1], k)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sums = [np.zeros(j - i, np.uint64) for _ in range(2)]
                if len(some):
                    for s, salt in zip(sums, (0x243F6A8885A308D3, 0x13198A2E03707344)):
                        s[some] = np.add.reduceat(mix64(sets ^ np.uint64(salt)), bounds[:-1][some])
                keys = order(sets)
                of = np.repeat(np.arange(j - i), n)
                by_key = np.argsort(keys)
                by_key = by_key[np.argsort(of[by_key].astype(np.uint16 if j - i < 1 << 16 else np.int64), kind="stable")]
                keys = (mix64(keys[by_key]) >> np.uint64(32)).astype(np.uint32)
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                rows = [packed(keys[a:a + m]) for a, m in zip(bounds[:-1].tolist(), length.tolist())]
                sig = np.ascontiguousarray(np.stack(sums, 1))
                words, at = parity_bitmaps(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()).slice(i, j - i), pa.array(n, pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary()),
                     pa.array(rows, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words))],
                    names=["doc_id", "n", "sig", "prefix", "bits"])

    return docs.select(id_col, text_col).mapInArrow(released(run), "doc_id long, n long, sig binary, prefix binary, bits array<long>")


def _blocks_of_groups(groups):
    """Packs (gid, n, prefix) rows into blocks."""

    def run(batches):
        from pyspark import TaskContext

        serial, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            return batch([(serial, packed(np.array([h[0] for h in held], np.int64)), packed(np.array([h[1] for h in held], np.int64)),
                           packed(np.array([len(h[2]) // 4 for h in held], np.int64)), b"".join(h[2] for h in held))],
                         [pa.int64()] + [pa.binary()] * 4, ["block", "gids", "ns", "sizes", "tokens"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(3))):
                held.append(row)
                size += len(row[2]) // 4
                if size >= BLOCK_TOKENS:
                    yield out()
                    serial, held, size = serial + 1, [], 0
        if held:
            yield out()

    return groups.select("gid", "n", "prefix").mapInArrow(released(run), "block long, gids binary, ns binary, sizes binary, tokens binary")


def _postings(groups):
    """(token, gid, n, place) of the prefix n-grams that two groups share."""
    total = groups.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    n_buckets = max(64, -(-total // 4 // BUCKET_TOKENS))
    held = written(_blocks_of_groups(groups), "groups")

    def prints_of(row):
        tokens, sizes = np.frombuffer(row["tokens"], np.uint32), np.frombuffer(row["sizes"], np.int64)
        return row["block"], twice_at_most(mix64(tokens), np.repeat(np.arange(len(sizes)), sizes))

    def expand(block: pa.Table, answer: pa.Table) -> pa.Table:
        types, names = [pa.int64()] * 4, ["token", "gid", "n", "place"]
        if not block.num_rows or not answer.num_rows:
            return arrow([], types, names)
        row = block.to_pylist()[0]
        tokens, sizes = np.frombuffer(row["tokens"], np.uint32), np.frombuffer(row["sizes"], np.int64)
        at = np.flatnonzero(is_shared(answer, mix64(tokens), n_buckets))
        of = np.repeat(np.arange(len(sizes)), sizes)[at]
        place = at - (np.cumsum(sizes) - sizes)[of]
        return pa.Table.from_arrays([pa.array(tokens[at].astype(np.int64)), pa.array(np.frombuffer(row["gids"], np.int64)[of]),
                                     pa.array(np.frombuffer(row["ns"], np.int64)[of]), pa.array(place)], names=names)

    shared = shared_prints(held, prints_of, n_buckets)
    return held.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(expand, "token long, gid long, n long, place long")


def _room(percent):
    """Whether the sets x and y (columns n, bits) can link by their bitmaps."""
    xor = lambda u, v: F.zip_with(u, v, lambda p, q: p.bitwiseXOR(q))
    half = lambda u: xor(F.slice(u, F.lit(1), F.shiftright(F.size(u), 1)), F.slice(u, F.shiftright(F.size(u), 1) + 1, F.shiftright(F.size(u), 1)))
    x, y = F.col("x.bits"), F.col("y.bits")
    differ = (F.when(F.size(x) == F.size(y), xor(x, y)).when(F.size(x) == F.size(y) * 2, xor(half(x), y))
              .when(F.size(x) * 2 == F.size(y), xor(x, half(y))).otherwise(F.array().cast("array<long>")))
    apart = F.aggregate(differ, F.lit(0), lambda s, c: s + F.bit_count(c))
    both = F.col("x.n") + F.col("y.n")
    return (both - apart) * (100 + percent) >= both * 2 * percent


def _possible(pairs, bits, percent):
    """The different pairs (a, b) whose bitmaps leave room for a link."""
    return (pairs.distinct().join(bits.alias("x"), F.col("a") == F.col("x.rep")).join(bits.alias("y"), F.col("b") == F.col("y.rep"))
            .filter(_room(percent)).select("a", "b").distinct())


MAX_MARKS = 1 << 26


def _texts_of(texts, ends):
    """The rows (doc_id, text) whose id is among ``ends``, and a few others: by a bitmap of
    the hashed ids, 16 bits an id and 8 MB at most, so that only these texts are dealt out."""
    ends = written(ends.distinct(), "ends")
    n_bits = min(MAX_MARKS, 1 << max(16, (16 * ends.count()).bit_length()))

    def place(ids):
        return (mix64(ids.view(np.uint64)) & np.uint64(n_bits - 1)).astype(np.int64)

    def mark(batches):
        for b in batches:
            at = np.unique(place(b.column(0).to_numpy()))
            words, first = np.unique(at >> 6, return_index=True)
            if len(words):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = ends.mapInArrow(released(mark), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    marks = np.zeros(n_bits >> 6, np.uint64)
    marks[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        for b in batches:
            at = place(b.column(0).to_numpy())
            yield b.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return written(texts.filter("doc_id IS NOT NULL").mapInArrow(released(run), "doc_id long, text string"), "texts")


def _verified(pairs, bits, texts, k, percent):
    """The pairs (a, b) whose texts link. Rows of b meet the text of a in slices of at
    most about 64 pairs per (a, salt), read as a stream, so no node is a hot group."""
    pairs = written(_possible(pairs, bits, percent), "pairs")
    count = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).alias("parts"))
    salted = pairs.join(count, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")))
    right = salted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "text")
    left = (count.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
            .join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text"))
    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        here, own = None, []
        for batch_ in batches:
            buf, off = text_buffer(batch_.column(4))
            a, salt, role, b = (batch_.column(c).to_numpy() for c in range(4))
            for i, j in slices(off):
                sets, bounds = shingle_sets(buf, off[i:j + 1], k)
                found = []
                for r in range(i, j):
                    mine = sets[bounds[r - i]:bounds[r - i + 1]]
                    if role[r] == 0:
                        if here != (a[r], salt[r]):
                            here, own = (a[r], salt[r]), []
                        own.append(mine)
                    elif here == (a[r], salt[r]):
                        for other in own:
                            if len(mine) and len(other):
                                both = int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())
                                if 100 * both >= percent * (len(mine) + len(other) - both):
                                    found.append((int(a[r]), int(b[r])))
                                    break
                if found:
                    yield batch(found, [pa.int64()] * 2, ["a", "b"])

    return written(dealt.mapInArrow(released(run), "a long, b long"), "links")


def _size_fits(x, y, percent):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _expanded(pairs, named):
    """(a, b): the classes of two groups that are of different components."""
    p, q = named.alias("p"), named.alias("q")
    return (pairs.join(p, F.col("g") == F.col("p.gid")).join(q, F.col("h") == F.col("q.gid"))
            .filter((F.col("p.part") != F.col("q.part")) & ((F.col("g") != F.col("h")) | (F.col("p.rep") < F.col("q.rep"))))
            .select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")))


#: Lists are long while the sum of their squared lengths is over so many times the postings.
LONG = 8
ROUNDS = 2


def _mixed(postings, of_group):
    """The postings of the n-grams whose groups are of more than one component."""
    left = postings.join(of_group, "gid")
    mixed = left.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("token")
    return left.join(mixed, "token")


def _star(rows, by, percent):
    """(a, b): for each n-gram, its group that comes first by ``by`` with each group that
    is not wholly of the same component."""
    centre = rows.groupBy("token").agg(F.min_by(F.struct("gid", "n", "low", "high"), by).alias("c"))
    apart = (F.col("low") != F.col("c.low")) | (F.col("high") != F.col("c.high")) | (F.col("low") != F.col("high"))
    return (rows.join(centre, "token").select("*", F.col("c.n").alias("m")).filter((F.col("gid") != F.col("c.gid")) & apart & _size_fits("m", "n", percent))
            .select(F.least("gid", "c.gid").alias("a"), F.greatest("gid", "c.gid").alias("b")))


#: Shared n-grams of a group that decide where a pair of groups is formed.
LEAD = 16


def _group_pairs(left, postings, groups, bits, percent):
    """(g, h): the pairs of groups of different components whose classes may link.

    Two groups meet at each n-gram that their prefixes share, but form a pair only where
    neither of their LEAD lowest n-grams tells of a lower one in common (there they meet
    as well). Then all the n-grams that two prefixes share are counted: of the set whose
    prefix ends first, these and what follows its prefix bound the overlap."""
    lead = left.groupBy("gid").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LEAD).alias("lead"))  # no more than a prefix is long
    # the bitmap of a group of one is that of its member, folded to four words, as it
    # travels with every n-gram; the whole bitmaps follow in _possible
    fold = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate(
        F.filter("bits", lambda x, k: k % 4 == i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
    alone = bits.select(F.col("rep").alias("gid"), fold.alias("bits"))
    left = left.join(alone, "gid").join(lead, "gid").withColumn("bits", F.when(F.col("members") == 1, F.col("bits")))
    left = written(left.drop("members"), "meetings")
    x, y = left.alias("x"), left.alias("y")
    overlap = (F.least("x.place", "y.place") + 1
               + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) - 1)
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid"))
                    & ((F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high")))
                    & _size_fits("x.n", "y.n", percent)
                    & (overlap * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
                    & (F.coalesce(F.array_min(F.array_intersect("x.lead", "y.lead")), F.col("x.token")) >= F.col("x.token"))
                    & (F.col("x.bits").isNull() | F.col("y.bits").isNull() | _room(percent)))
             .select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct())
    pairs = written(pairs, "meeting")
    ends = pairs.select(F.col("g").alias("gid")).union(pairs.select(F.col("h").alias("gid"))).distinct()
    sides = written(postings.join(ends, "gid", "left_semi").groupBy("gid").agg(F.collect_list("token").alias("tokens"))
                    .join(groups.select("gid", "n", (F.octet_length("prefix") / 4).cast("long").alias("length")), "gid"), "sides")
    u, v = sides.alias("u"), sides.alias("v")
    # n-grams of one prefix that share their 32 bits are one element of the intersection
    alike = lambda c: F.size(c) - F.size(F.array_distinct(c))
    both = F.size(F.array_intersect("u.tokens", "v.tokens")) + F.greatest(alike(F.col("u.tokens")), alike(F.col("v.tokens")))
    most = both + F.greatest(F.col("u.n") - F.col("u.length"), F.col("v.n") - F.col("v.length"))
    return (pairs.join(u, F.col("g") == F.col("u.gid")).join(v, F.col("h") == F.col("v.gid"))
            .filter(most * (100 + percent) >= (F.col("u.n") + F.col("v.n")) * percent).select("g", "h"))


def near_duplicates(docs, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, n_shingles, component_id) of every row."""
    rows = written(prefixes(docs, frequent_order(docs, text_col, k), id_col, text_col, k, percent), "prefixes")
    classes = written(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "sig").agg(
        F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "classes")
    bits = classes.select("rep", "n", "bits")
    groups = classes.groupBy("n", "prefix").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
    postings = written(_postings(groups), "postings")
    members = written(classes.withColumn("key", F.md5("prefix")).join(
        groups.filter("members > 1").select("n", F.md5("prefix").alias("key"), "gid"), ["n", "key"]).select("rep", "gid"), "members")

    # no other text can be of a pair
    texts = _texts_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                      postings.select("gid").union(members.select("rep")))

    # links with each n-gram's smallest group, and of each group with its smallest class
    star = _star(postings.withColumns({"low": F.col("gid"), "high": F.col("gid")}), F.col("gid"), percent)
    n_postings = postings.count()
    inner = members.filter("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    links = _verified(star.union(inner), bits, texts, k, percent)

    # pairs of groups of different components only
    def parted(links, part=None):
        """The links as stars; (rep, gid, part): the component of each class; and the span
        of each group's components. ``part``: the stars of earlier links."""
        part = written(components(links if part is None else links.union(part)).select(F.col("component").alias("a"), F.col("node").alias("b")), "components")
        named = written(classes.select("rep", "n").join(members.select("rep", F.col("gid").alias("g")), "rep", "left")
                        .select("rep", F.coalesce("g", "rep").alias("gid"))
                        .join(part, F.col("rep") == F.col("b"), "left").select("rep", "gid", F.coalesce("a", "rep").alias("part")), "parts")
        return part, named, named.groupBy("gid").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members"))

    # long lists of groups that are still apart: each list is compared with another of its
    # groups, ROUNDS times (that steers the work; what stays apart forms pairs below)
    stars, named, of_group = parted(links)
    for turn in range(1, ROUNDS + 2):
        mixed = written(_mixed(postings, of_group), "mixed")
        squares = mixed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
        if turn > ROUNDS or squares <= LONG * n_postings:
            break
        more = _verified(_star(mixed, F.xxhash64("gid", F.lit(turn)), percent), bits, texts, k, percent)
        if more.isEmpty():
            break
        stars, named, of_group = parted(more, stars)
    pairs = written(_group_pairs(mixed, postings, groups, bits, percent), "group-pairs")
    # one class of each component of a group first: what these join needs no expansion
    one = named.groupBy("gid", "part").agg(F.min("rep").alias("rep"))
    more = _verified(_expanded(pairs, one), bits, texts, k, percent)
    if not more.isEmpty():
        stars, named, of_group = parted(more, stars)
    g, h = of_group.select(*[F.col(c).alias(f"g_{c}") for c in of_group.columns]), of_group.select(*[F.col(c).alias(f"h_{c}") for c in of_group.columns])
    apart = (pairs.join(g, F.col("g") == F.col("g_gid")).join(h, F.col("h") == F.col("h_gid"))
             .filter("(g_low <> h_low OR g_high <> h_high OR g_low <> g_high) AND (g_members > 1 OR h_members > 1)").select("g", "h"))
    own = of_group.filter("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    rest = written(apart.union(own), "apart")  # a pair of groups of one has had its turn
    links = stars if rest.isEmpty() else stars.union(_verified(_expanded(rest, named), bits, texts, k, percent))
    # rows that share an id but not the set: one node
    several = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sig").alias("l"), F.max("sig").alias("h")).filter("l <> h")
    same_id = rows.join(several, "doc_id").join(classes.select("n", "sig", "rep"), ["n", "sig"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    part = components(links.union(same_id))

    named = classes.select("n", "sig", "rep").join(part, F.col("rep") == F.col("node"), "left").select(
        "n", "sig", F.coalesce("component", "rep").alias("component"))
    of_class = named.groupBy("n", "sig").agg(F.min("component").alias("component"))
    return (rows.drop("prefix", "bits").join(of_class, ["n", "sig"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))
