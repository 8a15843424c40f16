"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

No regular expression runs over the text. Code points are classed by a table
(letter, number, white space, other), look-ahead turns them into symbols, and
each symbol is a transition function on the eight states of the pattern's
automaton. Composition of such functions is associative, so all texts of a slice
are scanned together: blocks are composed column by column, the blocks' own
functions are scanned in the same way, and a second pass with the known entry
states marks the piece boundaries. A text's first character resets the state, so
one scan holds many texts and no piece crosses from one text to the next.

The slices between boundaries go through cached pair merging. Decoding uses
the byte offsets of the vocabulary: ids -> bytes.

Cases: a null or empty text has no ids and decodes to no bytes; a null id stays
null; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa

from .common import slices, text_buffer, worker_cache
from .pair_merge import merge

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64

# Character classes.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States: in a run of letters / numbers / others / white space; after a space that
# begins the next piece; one or two letters of a contraction to come; piece ended.
IN_L, IN_N, IN_O, IN_W, LEAD, ONE, TWO, ENDED = range(8)

# Symbols: a class, with what look-ahead tells.
S_L, S_N, S_O, S_ONE, S_TWO, S_INNER, S_LEAD, S_ALONE = range(8)
RESET = 8  # added to a symbol at a text's first character

BLOCK = 64


def class_table() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            t[cp] = LETTER
        elif major == "N":
            t[cp] = NUMBER
    t[WHITE_SPACE] = WHITE
    t[0x20] = SPACE
    return t


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins at this character)."""
    if symbol in (S_L, S_N, S_O):
        if state == TWO:
            return ONE, False
        if state == ONE:
            return ENDED, False
        run = {S_L: IN_L, S_N: IN_N, S_O: IN_O}[symbol]
        return run, state not in (run, LEAD)
    if symbol in (S_ONE, S_TWO):  # an apostrophe that may open a contraction
        if state in (IN_O, LEAD):
            return IN_O, False
        return (ONE if symbol == S_ONE else TWO), True
    if symbol == S_INNER:  # white space before white space, or the last of a text
        return IN_W, state != IN_W
    return (LEAD if symbol == S_LEAD else ENDED), True


def transition_tables() -> tuple[np.ndarray, np.ndarray]:
    nxt, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(8):
        for state in range(8):
            nxt[symbol, state], begins[symbol, state] = _step(state, symbol)
            nxt[RESET + symbol, state], begins[RESET + symbol, state] = _step(ENDED, symbol)[0], True
    return nxt, begins


def symbols(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """``cp``: code points of texts one after another; ``first``: where one begins."""
    n = len(cp)
    kind = classes[cp]
    blank = kind >= SPACE
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    next_blank = np.ones(n, bool)  # the end of a text counts as white space
    next_blank[:-1] = blank[1:] | last[:-1]
    out = np.choose(np.minimum(kind, SPACE), [S_L, S_N, S_O, S_INNER]).astype(np.uint8)
    out[(kind == SPACE) & ~next_blank] = S_LEAD
    out[(kind == WHITE) & ~next_blank] = S_ALONE
    at = np.flatnonzero((cp == 0x27) & ~last)
    if len(at):  # 's 't 'm 'd take one letter, 're 've 'll two
        a = cp[at + 1]
        inside = at + 2 < n
        b = np.where(inside & ~last[at + 1], cp[np.minimum(at + 2, n - 1)], 0)
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = S_ONE
        out[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = S_TWO
    out[first] += RESET
    return out


def states_before(sym: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The state before each symbol, by a blocked scan over function composition."""
    n = len(sym)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, 255, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.intp)
    table = np.vstack([nxt, np.arange(8, dtype=np.uint8)[None]])  # the last one: identity, for the padding
    grid[grid == 255] = 16
    composed = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for column in grid:  # composed[r] = function of the block's symbols so far
        composed = table[column[:, None], composed]
    entry = _exclusive_scan(composed)
    out = np.empty((BLOCK, rows), np.uint8)
    state = entry
    for j, column in enumerate(grid):
        out[j] = state
        state = table[column, state]
    return out.T.reshape(-1)[:n]


def _exclusive_scan(functions: np.ndarray) -> np.ndarray:
    """Entry state of each block, given each block's function; doubling over blocks."""
    n = len(functions)
    acc = functions
    d = 1
    while d < n:
        acc = np.concatenate([acc[:d], np.take_along_axis(acc[d:], acc[:-d].astype(np.intp), 1)])
        d *= 2
    out = np.full(n, ENDED, np.uint8)
    out[1:] = acc[:-1, ENDED]
    return out


def piece_starts(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    nxt, begins = transition_tables()
    sym = symbols(cp, first, classes)
    return np.flatnonzero(begins[sym, states_before(sym, nxt)])


class Codec:
    """Ranks of a tiktoken file: bytes -> id, merged lowest rank first."""

    def __init__(self, spec: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line)}
        by_id = {i: t for t, i in self.ranks.items()}
        size = max(by_id) + 1
        lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.token_offset = np.concatenate([[0], np.cumsum(lengths)])
        self.classes = class_table()
        self.cache: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def _rank(self, a: bytes, b: bytes):
        r = self.ranks.get(a + b)
        return None if r is None else (r, a + b)

    def piece_ids(self, piece: bytes) -> list[int]:
        one = self.ranks.get(piece)
        if one is not None:
            return [one]
        return [self.ranks[t] for t in merge([piece[i:i + 1] for i in range(len(piece))], self._rank)]

    def encode_slices(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian uint32 bytes."""
        cache = self.cache
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = np.array(self.piece_ids(p), "<u4").tobytes()
                if len(p) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[p] = ids
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of any id sequence, gathered through the vocabulary's offsets."""
        a = self.token_offset[ids]
        n = self.token_offset[ids + 1] - a
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - n), n)
        return self.token_bytes[at].tobytes()

    def pieces(self, buf: np.ndarray, off: np.ndarray):
        """Byte offsets of all piece starts of the texts, and of the end."""
        text = buf[off[0]:off[-1]].tobytes()
        cp = np.frombuffer(text.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        lead = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # byte offset of each code point
        first = np.zeros(len(cp), bool)
        begin = off[:-1][off[1:] > off[:-1]] - off[0]
        first[np.searchsorted(lead, begin)] = True
        return text, np.append(lead[piece_starts(cp, first, self.classes)], len(text))

    def __call__(self, buf: np.ndarray, off: np.ndarray):
        """Of each text: its ids as uint32 bytes."""
        if off[-1] == off[0]:
            return [b""] * (len(off) - 1)
        text, starts = self.pieces(buf, off)
        s = starts.tolist()
        ids = self.encode_slices([text[a:z] for a, z in zip(s, s[1:])])
        cut = np.searchsorted(starts, off - off[0]).tolist()
        return [b"".join(ids[a:z]) for a, z in zip(cut, cut[1:])]


def _codec(spec, key) -> Codec:
    return worker_cache(key, lambda: Codec(spec.value))


def encode(docs, ranks: str, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, ids array<int>) of every whole text: the operator's own output."""
    return _map(docs, ranks, id_col, text_col, "doc_id long, ids array<int>",
                lambda codec, ids: [pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))])


def decode(encoded, ranks: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """(doc_id, text binary) of the output of ``encode``; null ids give no bytes."""
    spark = encoded.sparkSession
    with open(ranks, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        codec = _codec(spec, f"codec:{ranks}")
        for b in batches:
            out = [codec.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, text binary")


def codec_digest(docs, ranks: str, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both."""

    def digests(codec, ids):
        arrays = [np.frombuffer(x, "<u4") for x in ids]
        decimal = worker_cache("decimals", lambda: [str(i) for i in range(len(codec.token_offset))])
        return [pa.array([len(x) for x in arrays], pa.int64()),
                pa.array([hashlib.sha256(",".join([decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in arrays]),
                pa.array([hashlib.sha256(codec.decode(x.astype(np.int64))).hexdigest() for x in arrays])]

    return _map(docs, ranks, id_col, text_col, SCHEMA, digests)


def _map(docs, ranks, id_col, text_col, schema, columns):
    spark = docs.sparkSession
    with open(ranks, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    key, names = f"codec:{ranks}", [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        codec = _codec(spec, key)
        for b in batches:
            buf, off = text_buffer(b.column(1))
            for i, j in slices(off):
                ids = codec(buf, off[i:j + 1])
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).slice(i, j - i), *columns(codec, ids)], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
