"""Line dedup by a segment-partition edit join.

Lines (between line feeds, compared by code points) are repeats of each other when
they are equal, or when links of at most ``max_edits`` insertions, deletions or
substitutions join them; of each class the first line stays, by document id and line
number. Lines shorter than ``min_exact`` stay, and lines shorter than ``min_near``
are compared for equality only, as short lines resemble each other by chance. With
``chars_per_edit`` the edits follow the length: one for each so many code points of
the shorter line, ``max_edits`` at most.

1. A line is cut into max_edits + 1 segments (by the edits of its length). A line with
   at most max_edits edits holds one of them unchanged, near its place: every line probes the segments of
   lines of its own and slightly smaller length, at the few places where a match can
   be part of a full alignment. Keys of segments and probes hash (length, segment
   number, substring).
2. Keys that two lines share, and lines that occur twice, are found block by block
   (``shared``); only these lines leave their block.
3. Candidates are verified by banded bit-parallel edit distance over whole lines:
   first each key's lines against its most common one (of copies with edits, the
   original), then those pairs of a segment and a probe whose lines are still in
   different components and whose 3-grams differ in no more than the edits allow.

Cases: null and empty texts have one empty line, which stays; rows with a null id
are returned, without part in any comparison; rows that share an id are ordered by
line number, and equal lines of repeated rows count as repeats within the document;
an empty table gives no rows; other columns are not read by ``repeated_lines`` and
pass through ``drop_repeated_lines``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import SpanHash, mix64, written
from .components import components
from .shared import arrow, batch, is_shared, shared_prints, twice_at_most
from .suffix_dedup import _n_buckets, _unzip, blocks

POSTING = "token long, key binary, role int, text string, bits array<long>, doc_id long, line long"
GRAM_BITS = 256


class Lines:
    """The lines of a block: documents, numbers, code-point spans, 128-bit keys."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, text: bytes, min_exact: int):
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        raw = _unzip(text) if text else b""
        self.text = raw.decode()
        size = np.frombuffer(sizes, np.int64)
        begin = np.cumsum(size) - size
        cp = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        off = np.append(np.searchsorted(lead, begin), len(cp))
        feeds = np.flatnonzero(cp == 10)
        # a line begins at each document's start and after each line feed
        a = np.concatenate([off[:-1], feeds + 1])
        doc = np.concatenate([np.arange(len(size)), np.searchsorted(off, feeds, "right") - 1])
        order = np.lexsort((a, doc))
        self.doc, self.a = doc[order], a[order]
        new = np.r_[True, self.doc[1:] != self.doc[:-1]] if len(order) else np.zeros(0, bool)
        last = np.r_[new[1:], True] if len(order) else new
        self.z = np.where(last, off[1:][self.doc], np.r_[self.a[1:], 0] - 1) if len(order) else self.a
        self.number = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else self.a
        self.size = self.z - self.a
        use = self.known[self.doc] & (self.size >= min_exact)
        if use.any():  # lines of white space alone stay
            blank = np.concatenate([[0], np.cumsum(~np.isin(cp, [9, 10, 11, 12, 13, 32, 0xA0, 0x3000]))])
            use &= blank[self.z] > blank[self.a]
        self.doc, self.a, self.z, self.number, self.size = (x[use] for x in (self.doc, self.a, self.z, self.number, self.size))
        self.spans = SpanHash(cp)
        self.low = self.spans(self.a, self.z)  # stands for a line within its block

    def keys(self, at: np.ndarray) -> list[bytes]:
        """128-bit keys of lines: digests of their UTF-8 bytes."""
        return [hashlib.md5(self.text[a:z].encode(), usedforsecurity=False).digest() for a, z in zip(self.a[at].tolist(), self.z[at].tolist())]

    def prints(self) -> np.ndarray:
        """Fingerprints of whole lines, apart from those of segments."""
        return mix64(self.low ^ np.uint64(0x6C696E65))

    def grams(self, at: np.ndarray) -> np.ndarray:
        """GRAM_BITS parity bits of the 3-grams of lines, as words."""
        n = np.maximum(self.size[at] - 2, 0)
        of = np.repeat(np.arange(len(at)), n)
        start = np.arange(len(of)) + np.repeat(self.a[at] - (np.cumsum(n) - n), n)
        cell = of * GRAM_BITS + (self.spans(start, start + 3) & np.uint64(GRAM_BITS - 1)).astype(np.int64)
        odd = (np.bincount(cell, minlength=len(at) * GRAM_BITS) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.int64).reshape(len(at), -1)

    def distinct(self, min_size: int) -> np.ndarray:
        """One place for each different line of at least ``min_size`` code points."""
        at = np.flatnonzero(self.size >= min_size)
        return at[np.unique(self.low[at], return_index=True)[1]]

    def tokens(self, at: np.ndarray, max_edits: int, chars_per_edit: int = 0):
        """(hash, line, role) of the segments (role 1) and probes (role 0)."""
        out, lines, roles = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for shorter in range(max_edits + 1):
            edits = allowed_edits(self.size[at] - shorter, max_edits, chars_per_edit)
            for k in range(max(shorter, 1) if chars_per_edit else max_edits, max_edits + 1):
                some = at[edits == k]
                size, start, parts = self.size[some], self.a[some], k + 1
                length = size - shorter  # of the lines whose segments are probed
                base, longer = length // parts, length % parts
                place = np.zeros(len(some), np.int64)
                for i in range(parts):  # the last ``longer`` segments have one more
                    width = base + (i >= parts - longer)
                    tag = mix64((length * parts + i).astype(np.uint64))
                    # offsets that leave i edits before the segment and the rest behind it
                    for shift in range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1):
                        a = place + shift
                        ok = (a >= 0) & (a + width <= size) & (length > 0)
                        out.append(mix64(self.spans(start[ok] + a[ok], start[ok] + a[ok] + width[ok]) ^ tag[ok]))
                        lines.append(some[ok])
                        roles.append(np.full(int(ok.sum()), int(shorter == 0 and shift == 0), np.int32))
                    place = place + width
        return np.concatenate(out), np.concatenate(lines), np.concatenate(roles)


def allowed_edits(size: np.ndarray, max_edits: int, chars_per_edit: int) -> np.ndarray:
    """Edits by which a line may differ from another that is not shorter."""
    return np.minimum(size // chars_per_edit, max_edits) if chars_per_edit else np.full(len(size), max_edits)


def _lines(row, min_exact):
    return Lines(row["ids"], row["known"], row["sizes"], row["text"], min_exact)


def within_edits(pairs: list[tuple[str, str]], max_edits: int) -> np.ndarray:
    """Which pairs of lines are at most ``max_edits`` edits apart. Many pairs of
    similar length are taken at once. Bit o of level e says that the first i
    characters of one line and the first i + o - max_edits of the other are at most
    e edits apart; one step over i moves all diagonals of the band together."""
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    i = 0
    while i < len(order):
        j, longest = i, 0
        while j < len(order) and (j == i or (j - i + 1) * max(longest, len(pairs[order[j]][0])) <= 1 << 21 and len(pairs[order[j]][0]) <= 2 * len(pairs[order[i]][0]) + 16):
            longest = max(longest, len(pairs[order[j]][0]))
            j += 1
        part = order[i:j]
        out[part] = _banded([pairs[k] for k in part], longest, max_edits)
        i = j
    return out


def _banded(pairs, longest, k):
    n, width = len(pairs), 2 * k + 1
    a = np.full((n, longest), 0xFFFFFFFF, np.uint32)
    b = np.full((n, longest + 2 * k + 1), 0xFFFFFFFE, np.uint32)  # b[:, j + k] is character j
    la, lb = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r, (x, y) in enumerate(pairs):
        x, y = np.frombuffer(x.encode("utf-32-le"), "<u4"), np.frombuffer(y.encode("utf-32-le"), "<u4")
        la[r], lb[r] = len(x), len(y)
        a[r, :len(x)] = x
        if abs(len(x) - len(y)) <= k:
            b[r, k:k + len(y)] = y
    match = np.zeros((n, longest), np.uint32)
    for o in range(width):
        match |= (a == b[:, o:o + longest]).astype(np.uint32) << np.uint32(o)
    match = np.ascontiguousarray(match.T)
    full, one = np.uint32((1 << width) - 1), np.uint32(1)
    level = [np.full(n, 1 << k, np.uint32)]
    for _ in range(k):
        level.append((level[-1] | level[-1] << one) & full)
    done = np.zeros((k + 1, n), np.uint32)
    for e in range(k + 1):
        done[e] = np.where(la == 0, level[e], 0)
    ends = np.argsort(la, kind="stable")
    at = np.searchsorted(la[ends], 1)
    for i in range(longest):
        m = match[i]
        new = [level[0] & m]
        for e in range(1, k + 1):
            new.append(((level[e] & m) | level[e - 1] | level[e - 1] >> one | new[e - 1] << one) & full)
        level = new
        while at < n and la[ends[at]] == i + 1:
            for e in range(k + 1):
                done[e, ends[at]] = level[e][ends[at]]
            at += 1
    o = lb - la + k
    ok = (o >= 0) & (o < width)
    return ok & ((done[k] >> np.where(ok, o, 0).astype(np.uint32)) & one).astype(bool)


def _postings(held, n_buckets, max_edits, min_exact, min_near, chars_per_edit):
    """Rows of three kinds: (token, key, role) of the shared keys, (key, text, bits) of
    their lines, and (key, doc_id, line) of every line that can be a repeat: its
    fingerprint or one of its keys occurs in another place."""

    def prints_of(row):
        x = _lines(row, min_exact)
        tokens, lines, _ = x.tokens(x.distinct(min_near), max_edits, chars_per_edit)
        return row["block"], np.concatenate([twice_at_most(tokens, x.low[lines]), twice_at_most(x.prints(), np.arange(len(x.low)))])

    def expand(block: pa.Table, answer: pa.Table) -> pa.Table:
        if not block.num_rows or not answer.num_rows:
            return empty
        x = _lines(block.to_pylist()[0], min_exact)
        tokens, lines, roles = x.tokens(x.distinct(min_near), max_edits, chars_per_edit)
        hit = np.flatnonzero(is_shared(answer, tokens, n_buckets))
        at, which = np.unique(lines[hit], return_inverse=True)
        some = np.flatnonzero(is_shared(answer, x.prints(), n_buckets) | np.isin(x.low, x.low[at]))
        one, of = np.unique(x.low[some], return_index=True, return_inverse=True)[1:]
        line_keys = x.keys(some[one])  # one digest for each different line
        keys = [line_keys[i] for i in of[np.searchsorted(some, at)].tolist()]

        def rows(**columns):
            n = len(columns["key"])
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in empty.schema], schema=empty.schema)

        posts = rows(token=pa.array(tokens[hit].view(np.int64)), key=pa.array([keys[i] for i in which.tolist()], pa.binary()), role=pa.array(roles[hit], pa.int32()))
        texts = rows(key=pa.array(keys, pa.binary()), bits=pa.array(x.grams(at).tolist(), pa.list_(pa.int64())),
                     text=pa.array([x.text[a:z] for a, z in zip(x.a[at].tolist(), x.z[at].tolist())], pa.string()))
        seen = rows(key=pa.array(line_keys, pa.binary()).take(pa.array(of)), doc_id=pa.array(x.ids[x.doc[some]]), line=pa.array(x.number[some].astype(np.int64)))
        return pa.Table.from_batches([posts, texts, seen])

    empty = pa.schema([("token", pa.int64()), ("key", pa.binary()), ("role", pa.int32()), ("text", pa.string()), ("bits", pa.list_(pa.int64())),
                       ("doc_id", pa.int64()), ("line", pa.int64())]).empty_table()
    held = held.drop("extra")
    shared = shared_prints(held, prints_of, n_buckets)
    return held.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(expand, POSTING)


def _verified(pairs, texts, max_edits, chars_per_edit):
    held = (pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches):
        for b in batches:
            both = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            edits = allowed_edits(np.array([min(len(x), len(y)) for x, y in both], np.int64), max_edits, chars_per_edit)
            ok = np.zeros(len(both), bool)
            for k in np.unique(edits[edits > 0]).tolist():
                at = np.flatnonzero(edits == k)
                ok[at] = within_edits([both[i] for i in at.tolist()], k)
            yield b.select([0, 1]).filter(pa.array(ok))

    return written(held.mapInArrow(run, "a binary, b binary"), "links")


def line_classes(rows, max_edits: int, chars_per_edit: int):
    """(node, component) of the lines that near links join, by key, from their postings."""
    texts = written(rows.filter("text IS NOT NULL").groupBy("key").agg(F.first("text").alias("text"), F.first("bits").alias("bits")), "line-texts")
    posts = (rows.filter("token IS NOT NULL").groupBy("token", "key").agg(F.max("role").alias("role"), F.count(F.lit(1)).alias("blocks")))
    # keys that one line alone has, in several blocks, are of no use
    many = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
    posts = written(posts.join(many, "token"), "line-keys")

    # a key's most common line with that segment against all others that have or probe it
    centre = posts.filter("role = 1").groupBy("token").agg(F.max(F.struct("blocks", "key"))["key"].alias("c"))
    star = posts.join(centre, "token").filter("key <> c").select(F.least("c", "key").alias("a"), F.greatest("c", "key").alias("b"))
    links = _verified(star.distinct(), texts, max_edits, chars_per_edit)
    part = written(components(links), "line-components")
    named = posts.join(part, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key")).drop("node", "component")
    mixed = named.groupBy("token").agg(F.min("part").alias("l"), F.max("part").alias("h")).filter("l < h").select("token")
    named = written(named.join(mixed, "token").join(texts.select("key", "bits", F.length("text").alias("size")), "key"), "line-mixed")
    x, y = named.filter("role = 1").alias("x"), named.alias("y")
    edits = F.least(F.floor(F.least("x.size", "y.size") / chars_per_edit), F.lit(max_edits)) if chars_per_edit else F.lit(max_edits)
    # an edit changes three 3-grams at most on either side
    apart = F.aggregate(F.zip_with("x.bits", "y.bits", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, c: s + c)
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part")) & (apart <= 6 * edits))
             .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")))
    return components(links.union(_verified(pairs.distinct(), texts, max_edits, chars_per_edit)))


def _removed(held, n_buckets, max_edits, min_exact, min_near, chars_per_edit):
    """(doc_id, line, near): the lines to remove; near: the first of the class is another line."""
    rows = written(_postings(held, n_buckets, max_edits, min_exact, min_near, chars_per_edit), "line-postings")
    part = line_classes(rows, max_edits, chars_per_edit)
    seen = rows.filter("line IS NOT NULL").select("key", "doc_id", "line")
    # per different line first, so that a very common one is one row per task
    firsts = seen.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("own"), F.count(F.lit(1)).alias("times"))
    firsts = firsts.join(part, F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key"))
    firsts = written(firsts.select("key", "part", "own", "times"), "line-firsts")
    of_class = firsts.groupBy("part").agg(F.min("own").alias("keep"), F.sum("times").alias("n")).filter("n > 1")
    repeated = firsts.join(of_class, "part").select("key", "keep", (F.col("own") != F.col("keep")).alias("near"))
    return (seen.join(repeated, "key").filter(F.struct("doc_id", "line") > F.col("keep")).select("doc_id", "line", "near"))


def repeated_lines(docs, max_edits: int = 2, min_exact: int = 12, min_near: int = 40, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = 0):
    """(doc_id, n_lines, n_removed, n_near, removed_lines) of every row; line numbers
    begin at 0, removed_lines ascends."""
    held = written(blocks(docs.select(id_col, text_col), id_col, text_col), "line-blocks")
    gone = _removed(held, _n_buckets(docs, text_col), max_edits, min_exact, min_near, chars_per_edit)
    per_doc = gone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("near"), 1)).alias("n_near"),
                                         F.sort_array(F.collect_list("line")).alias("removed_lines"))

    def counts(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, known, size = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("known", bool), ("sizes", np.int64)))
                feeds = np.concatenate([[0], np.cumsum(np.frombuffer(_unzip(row["text"]), np.uint8) == 10)])
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known), pa.array(feeds[ends] - feeds[ends - size] + 1)], names=["doc_id", "n_lines"])

    every = held.drop("extra").mapInArrow(counts, "doc_id long, n_lines long")
    zero = F.lit(0).cast("long")
    return (every.join(per_doc, "doc_id", "left")
            .select("doc_id", "n_lines", F.coalesce("n", zero).alias("n_removed"), F.coalesce("n_near", zero).alias("n_near"),
                    F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines")))


def drop_repeated_lines(docs, max_edits: int = 2, min_exact: int = 12, min_near: int = 40, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = 0):
    """``docs`` with the repeated lines taken out of the text, all other columns kept."""
    gone = (repeated_lines(docs, max_edits, min_exact, min_near, id_col, text_col, chars_per_edit).dropDuplicates(["doc_id"])
            .select(F.col("doc_id").alias("__id"), F.col("removed_lines").alias("__gone")))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("__gone", i.cast("long"))), "\n")
    out = docs.join(gone, F.col(id_col).cast("long") == F.col("__id"), "left")
    text = F.when(F.size("__gone") > 0, kept).otherwise(F.col(text_col)).alias(text_col)
    return out.select(*[text if c == text_col else F.col(c) for c in docs.columns])
