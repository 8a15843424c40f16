"""Removal of repeated passages by longest-previous-factor arrays.

Each byte covered by a string of ``width`` bytes that also starts in a document
with a smaller id is removed; the first document keeps its copy. Strings are
judged on the input, never cross documents, and overlaps count.

A suffix array over a whole corpus fits no task, so the work is dealt by content:

1. Documents are packed into blocks of a few MB (written once, compressed).
2. Every window of ``width`` bytes has an anchor: its ``gram``-byte string with the
   lowest hash (the leftmost of equal ones). Equal windows have equal anchors, and
   about one position in 16 is one. 32-bit fingerprints of the blocks' distinct
   anchors are dealt by hash; those that two documents share go back to their blocks.
3. A block sends, for each shared anchor, the context: the bytes of all windows that
   have that anchor. Equal contexts of one block are sent once, with the smallest id,
   so a passage that a third of all documents hold costs one row per block.
4. Per part of a hash bucket the distinct contexts form one text, in the order of their
   smallest ids. Its windows are put in suffix order (ranks by doubling, from 5 bytes up to
   width), with the longest common prefix of each neighbour pair. From a window, the
   previous and the next one in that order with a smaller document give its longest previous
   factor; with ``width`` bytes or more, the window is a copy of an earlier document's.
   One bit per window goes back to the block.
5. The blocks cut the bytes out.

Cases: a null text is empty; a text shorter than ``width`` stays as it is; a row
with a null id has no order, keeps its text and removes nothing elsewhere; rows
with one id do not remove each other's text, both may be cut; an empty table gives
no rows. Other columns pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SpanHash, lowest, mix64, packed, released, slices, text_buffer, written
from .shared import arrow, bucket_of, by_bucket, is_shared, shared_prints, twice_at_most

WIDTH = 50
GRAM = 20

BLOCK = "block long, ids binary, known binary, sizes binary, text binary, extra binary"

#: Text bytes whose anchors and contexts meet in one task.
BUCKET_BYTES = 16 << 20


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks(docs, id_col: str, text_col: str):
    """Documents as rows of a few MB of text: ids, byte counts, compressed text and
    the other columns (an Arrow stream)."""
    others = [c for c in docs.columns if c != text_col]
    # positions, not names, address the columns below, so clashing names are harmless
    chosen = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"), *[docs[c] for c in others])

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def out():
            nonlocal held, size, serial
            ids = np.concatenate([h[0] for h in held])
            row = [serial, ids.tobytes(), np.concatenate([h[1] for h in held]).tobytes(), np.concatenate([h[2] for h in held]).tobytes(),
                   _zip(b"".join(h[3] for h in held)), _zip(_ipc(pa.Table.from_batches([h[4] for h in held]).combine_chunks().to_batches()[0]))]
            held, size, serial = [], 0, serial + 1
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, [pa.int64()] + [pa.binary()] * 5)],
                                              names=["block", "ids", "known", "sizes", "text", "extra"])

        for b in batches:
            buf, off = text_buffer(b.column(1))
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rest = b.select(list(range(2, b.num_columns)))
            for i, j in slices(off):
                if size and size + off[j] - off[i] > SLICE_BYTES:
                    yield out()
                held.append((ids[i:j], known[i:j], np.diff(off[i:j + 1]).astype(np.int64), buf[off[i]:off[j]].tobytes(), rest.slice(i, j - i)))
                size += off[j] - off[i]
                if size >= SLICE_BYTES // 2:
                    yield out()
        if held:
            yield out()

    return chosen.mapInArrow(released(run), BLOCK)


class Block:
    """A block's windows, grouped by their anchors."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, text: bytes, width: int, gram: int):
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.raw = _unzip(text) if text else b""
        self.width = width
        n = len(self.raw)
        none = np.zeros(0, np.int64)
        self.doc = self.low = self.high = self.at = none
        self.anchor = self.context = np.zeros(0, np.uint64)
        if n < width:
            return
        spans = SpanHash(np.frombuffer(self.raw, np.uint8))
        grams = spans.windows(gram)
        key = grams & np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(len(key), dtype=np.uint64)
        place = _sliding_min(key, width - gram + 1)  # of each window: hash and place of its anchor
        place &= np.uint64(0xFFFFFFFF)
        room = np.where(self.known, np.diff(self.off) - width + 1, 0)
        room = np.maximum(room, 0)
        if not room.sum():
            return
        window = np.arange(room.sum()) + np.repeat(self.off[:-1] - (np.cumsum(room) - room), room)
        doc = np.repeat(np.arange(len(room)), room)
        at = place[window].astype(np.int64)
        begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        ends = np.r_[begins[1:], len(window)] - 1
        self.doc, self.low, self.high, self.at = doc[begins], window[begins], window[ends], at[begins]
        self.anchor = grams[self.at]
        self.context = spans(self.low, self.high + width) ^ mix64((self.at - self.low).astype(np.uint64))

    def owners(self):
        """The id of each group's document, and the smallest id with the same context."""
        owner = self.ids[self.doc]
        first = np.empty(len(owner), np.int64)
        order, runs, low = lowest(self.context, owner)
        first[order] = np.repeat(low, np.diff(runs))
        return owner, first


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of all stretches of w values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        a = np.minimum(a[:-step], a[step:])
        done += step
    return a


def _n_buckets(docs, text_col: str) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(64, -(-total // BUCKET_BYTES))


def _anchor_prints(width, gram):
    def prints_of(row):
        x = Block(row["ids"], row["known"], row["sizes"], row["text"], width, gram)
        return row["block"], twice_at_most(x.anchor, x.doc)

    return prints_of


def _contexts(width, gram, n_buckets):
    def run(block: pa.Table, shared: pa.Table) -> pa.Table:
        types, names = [pa.int64(), pa.int64(), *[pa.binary()] * 5], ["bucket", "block", "keys", "parts", "firsts", "sizes", "text"]
        rows = []
        if block.num_rows and shared.num_rows:
            row = block.to_pylist()[0]
            x = Block(row["ids"], row["known"], row["sizes"], row["text"], width, gram)
            bucket = bucket_of(x.anchor, n_buckets)
            hit = is_shared(shared, x.anchor, n_buckets)
            # each context once; which of its equal copies is sent does not matter
            at = np.flatnonzero(hit)
            at = at[np.unique(x.context[at], return_index=True)[1]]
            _, first = x.owners()
            parts = (x.anchor >> np.uint64(40)).astype(np.uint8)
            for k, part in by_bucket(bucket[at]):
                g = at[part]
                low, high = x.low[g], x.high[g] + width
                rows.append((k, row["block"], packed(x.context[g]), packed(parts[g]), packed(first[g]), packed((high - low).astype(np.uint16)),
                             _zip(b"".join([x.raw[a:z] for a, z in zip(low.tolist(), high.tolist())]))))
        return arrow(rows, types, names)

    return run


def prefix_ranks(text: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks) by doubling from 5 bytes to ``width``: of every suffix with so
    many bytes, the rank of its first ``length`` bytes; equal prefixes rank equally."""
    n = len(text)
    have = min(5, width)
    key = np.zeros(max(n - have + 1, 0), np.uint64)
    for k in range(have):
        key = key << np.uint64(8) | text[k:n - have + 1 + k]
    levels = [(have, _dense(key, 8 * have))]
    while have < width and len(levels[-1][1]):
        rank = levels[-1][1]
        step, bits = min(have, width - have), int(rank.max()).bit_length()
        have += step
        levels.append((have, _dense(rank[:-step].astype(np.uint64) << np.uint64(bits) | rank[step:].astype(np.uint64), 2 * bits)))
    return levels


def suffix_order(text: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``start`` in suffix order, by their first ``width`` bytes and
    then by place, and each one's longest common prefix with the one before (``width``
    at most; the first has none)."""
    levels = prefix_ranks(text, width)
    rank = levels[-1][1][start]
    low = np.uint64(len(start).bit_length())
    order = (np.sort(rank.astype(np.uint64) << low | np.arange(len(start), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    lcp = np.full(len(start), width, np.int64)
    lcp[:1] = 0
    differ = np.flatnonzero(rank[order[1:]] != rank[order[:-1]]) + 1
    a, b = start[order[differ - 1]], start[order[differ]]
    same = np.zeros(len(differ), np.int64)
    for length, ranks in reversed(levels[:-1]):
        fits = np.flatnonzero(same + length <= width)
        equal = ranks[a[fits] + same[fits]] == ranks[b[fits] + same[fits]]
        same[fits[equal]] += length
    go = np.arange(len(differ))
    while len(go):  # fewer bytes than the shortest ranked prefix
        go = go[same[go] < width]
        go = go[text[a[go] + same[go]] == text[b[go] + same[go]]]
        same[go] += 1
    lcp[differ] = same
    return order, lcp


def _to_smaller(owner: np.ndarray, lcp: np.ndarray, width: int) -> np.ndarray:
    """Along a suffix order, the common prefix of each suffix with the previous one of
    a smaller owner. Pointers jump over stretches of owners that are not smaller, all at
    once; a suffix whose common prefix has fallen below ``width`` ends there."""
    n = len(owner)
    to, least = np.arange(n) - 1, lcp.copy()
    go = np.flatnonzero(least >= width)  # the first has no common prefix, so none points before it
    go = go[owner[to[go]] >= owner[go]]
    while len(go):
        over = to[go]
        beyond, with_it = to[over], least[over]  # read before any pointer of the round moves
        least[go] = np.minimum(least[go], with_it)
        to[go] = beyond
        go = go[least[go] >= width]
        go = go[owner[to[go]] >= owner[go]]
    return least


def previous_factors(text: np.ndarray, start: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For each suffix at ``start``, the longest prefix (``width`` bytes at most) that
    also starts with a smaller owner: the larger of the common prefixes with the
    previous and the next smaller owner in suffix order. Where it is below ``width``
    the value is a bound from above and itself below ``width``."""
    order, lcp = suffix_order(text, start, width)
    along = owner[order]
    before = _to_smaller(along, lcp, width)
    after = _to_smaller(along[::-1], np.r_[lcp[1:], 0][::-1], width)[::-1] if len(order) else before
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _dense(key: np.ndarray, bits: int) -> np.ndarray:
    """Ranks of keys of so many bits. Key and place are sorted as one word if they fit."""
    low = np.uint64(len(key).bit_length())
    if bits + int(low) <= 64:
        s = np.sort(key << low | np.arange(len(key), dtype=np.uint64))
        order, s = (s & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), s >> low
    else:
        order = np.argsort(key)
        s = key[order]
    out = np.zeros(len(key), np.uint32)
    out[order[1:]] = np.cumsum(s[1:] != s[:-1])
    return out


def _masks(keys, firsts, sizes, begin, text, width):
    """Bit j of a context: its window j also starts in a smaller document than its ``first``."""
    # distinct contexts, each with the smallest id of all blocks, laid out by that id
    order, runs, first = lowest(keys, firsts)
    by_id = np.argsort(first, kind="stable")
    chosen, first = order[runs[:-1]][by_id], first[by_id]
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(place, np.diff(runs))
    n = sizes[chosen]
    ends = np.cumsum(n)
    flat = text[np.arange(ends[-1]) + np.repeat(begin[chosen] - (ends - n), n)]
    room = n - width + 1
    head = np.cumsum(room) - room
    start = np.arange(room.sum()) + np.repeat((ends - n) - head, room)
    copied = previous_factors(flat, start, np.repeat(first, room), width) >= width
    mask = np.zeros(len(chosen), np.uint64)
    for j in range(int(room.max())):
        has = room > j
        mask[has] |= copied[head[has] + j].astype(np.uint64) << np.uint64(j)
    # where a smaller document has the whole context, all its windows are copies
    return np.where(first[which] < firsts, np.uint64(2 ** 64 - 1), mask[which])


def _earlier(width):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        parts = np.concatenate([np.frombuffer(r["parts"], np.uint8) for r in rows])
        firsts = np.concatenate([np.frombuffer(r["firsts"], np.int64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint16) for r in rows]).astype(np.int64)
        counts = np.array([len(r["keys"]) // 8 for r in rows])
        text = np.frombuffer(b"".join(_unzip(r["text"]) for r in rows), np.uint8)
        begin = np.cumsum(sizes) - sizes
        mask = np.zeros(len(keys), np.uint64)
        # equal windows have equal anchors, hence equal parts: each part is a text of its own
        for _, at in by_bucket(parts):
            mask[at] = _masks(keys[at], firsts[at], sizes[at], begin[at], text, width)
        out, ends = [], np.cumsum(counts)
        for r, a, z in zip(rows, (ends - counts).tolist(), ends.tolist()):
            at = a + np.flatnonzero(mask[a:z])
            if len(at):
                out.append((r["block"], packed(keys[at]), packed(mask[at])))
        return arrow(out, [pa.int64(), pa.binary(), pa.binary()], ["block", "keys", "masks"])

    return run


def _cut(width, gram, finish):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return finish(None, None, None)
        row = block.to_pylist()[0]
        x = Block(row["ids"], row["known"], row["sizes"], row["text"], width, gram)
        cover = np.zeros(len(x.raw) + 1, np.int32)
        if len(x.low):
            mask = np.zeros(len(x.low), np.uint64)
            if answers.num_rows:
                keys = np.concatenate([np.frombuffer(p, np.uint64) for p in answers.column("keys").to_pylist()])
                masks = np.concatenate([np.frombuffer(p, np.uint64) for p in answers.column("masks").to_pylist()])
                order = np.argsort(keys)
                at = order[np.minimum(np.searchsorted(keys[order], x.context), len(keys) - 1)]
                mask = np.where(keys[at] == x.context, masks[at], np.uint64(0))
            # a larger id than the block's first with this very context: every window is a repeat
            owner, first = x.owners()
            mask = np.where(owner > first, np.uint64(2 ** 64 - 1), mask)
            for j in range(width - gram + 1):
                s = x.low[(mask >> np.uint64(j) & np.uint64(1) == 1) & (x.low + j <= x.high)] + j
                cover[s] += 1  # windows are distinct places, so no index repeats
                cover[s + width] -= 1
        return finish(x, np.cumsum(cover)[:-1] > 0, row["extra"])

    return run


def _pipeline(docs, id_col, text_col, width, gram, finish, schema):
    if not gram < width <= gram + 63:
        raise ValueError("gram must be below width, by 63 at most")
    n_buckets = _n_buckets(docs, text_col)
    held = written(blocks(docs, id_col, text_col), "blocks")
    of_block = held.groupBy("block")
    shared = shared_prints(held.drop("extra"), _anchor_prints(width, gram), n_buckets)
    contexts = of_block.cogroup(shared.groupBy("block")).applyInArrow(
        _contexts(width, gram, n_buckets), "bucket long, block long, keys binary, parts binary, firsts binary, sizes binary, text binary")
    answers = contexts.groupBy("bucket").applyInArrow(_earlier(width), "block long, keys binary, masks binary")
    return of_block.cogroup(answers.groupBy("block")).applyInArrow(_cut(width, gram, finish), schema)


def repeat_digest(docs, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 4 + [pa.string()]

    def finish(x, cover, _):
        rows = []
        if x is not None:
            raw = np.frombuffer(x.raw, np.uint8)
            for k, (a, z) in enumerate(zip(x.off[:-1].tolist(), x.off[1:].tolist())):
                c = cover[a:z]
                n = int(c.sum())
                spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if n else 0
                kept = raw[a:z][~c].tobytes() if n else x.raw[a:z]
                rows.append((int(x.ids[k]) if x.known[k] else None, z - a, n, spans, hashlib.sha256(kept).hexdigest()))
        return arrow(rows, types, names)

    return _pipeline(docs.select(id_col, text_col), id_col, text_col, width, gram, finish,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM):
    """``docs`` with the repeated bytes cut out of the text, all other columns kept,
    plus n_removed. A character of which a part was cut goes as a whole."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{text_col}` string", "`__removed` long"])
    names = [*(f.name for f in others), text_col, "__removed"]

    def finish(x, cover, extra):
        if x is None:
            return None
        raw = np.frombuffer(x.raw, np.uint8)
        texts, removed = [], []
        for a, z in zip(x.off[:-1].tolist(), x.off[1:].tolist()):
            c = cover[a:z]
            n = int(c.sum())
            removed.append(n)
            texts.append((raw[a:z][~c].tobytes() if n else x.raw[a:z]).decode("utf-8", "ignore"))
        rest = pa.ipc.open_stream(_unzip(extra)).read_all().combine_chunks()
        return pa.Table.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=names)

    def finish_or_none(x, cover, extra):
        t = finish(x, cover, extra)
        return t if t is not None else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    out = _pipeline(docs, id_col, text_col, width, gram, finish_or_none, schema)
    return out.select(*[F.col(c) for c in docs.columns], F.col("__removed"))
