"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task streams its documents, tokenises them and packs groups of about
``group_tokens`` tokens, so nothing is shuffled and no group grows with the
data. In a group, a document of n tokens is cut into whole sequences and a rest.
The rests are taken in descending size; each goes to the sequence of the lowest
estimated cost (linear * n + quadratic * n**2 over its pieces: attention does
not cross documents) that has room for it. What fits nowhere whole is cut at the
room of the cheapest open sequence. The sequences' room equals the tokens of the
group exactly: whole sequences, the odd tokens passing on to the next group, and
at the end of a task sequences of powers of two, which need no padding.

Cases: a null or empty text is its end token alone; a null id stays null;
repeated rows are packed each; other columns are not read; an empty table gives
no rows. ``sequence_id`` = partition number * 2**32 + running number: unique, and
the same when a lost task runs again over the same rows.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa

from .common import released, worker_cache
from .token_counts import byte_symbols

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")

CACHE_ENTRIES = 300_000
CACHE_LENGTH = 64


class WordIds:
    """Token ids (little-endian uint32 bytes) of whole texts under a tokenizers
    JSON whose pre-tokeniser never joins across white space. Texts are cut at
    spaces and line feeds, and the ids of short pieces between them cached.

    A new piece of Latin letters with plain punctuation after them is made of the
    ids of the lower-cased word and of the punctuation, if the file has the
    pre-tokeniser for which that holds; all others go through the whole tokenizer."""

    SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?%$#&*|;:]*)")
    #: Fixed value: the split into letters, single digits and symbols after which SIMPLE holds.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        parsed = json.loads(spec)
        steps = [x.get("type") for x in (parsed.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.simple = "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and split[:1] == [self.SPLIT] and len(split) == 2
        self.symbols = str.maketrans({chr(b): c for b, c in byte_symbols().items()})

    def part(self, part: str) -> bytes:
        """A word or a run of punctuation, straight through the vocabulary's merges."""
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > CACHE_ENTRIES:
                self.parts = {"": b""}
            tokens = self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.symbols))
            ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        out, hard = {}, []
        for p in pieces:
            m = self.SIMPLE.fullmatch(p) if self.simple and len(p) <= CACHE_LENGTH else None
            if m:
                out[p] = self.part(m[1].lower()) + self.part(m[2])
            else:
                hard.append(p)
        if hard:
            for p, e in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)):
                out[p] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[str]):
        cache = self.cache
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            new = [w for w in set(words) if w not in cache]
            if new:
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                    new = list(set(words))
                cache.update(self.learn(new))
            ids = b"".join([cache[w] for w in words])
            for w in new:
                if len(w) > CACHE_LENGTH:
                    del cache[w]
            yield ids


def tail_rooms(n: int) -> list[int]:
    """n < capacity tokens as sequences of powers of two, which are not padded."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def assign(lengths: list[int], rooms: list[int], linear: float = 1.0, quadratic: float = 1.0 / 4096):
    """Pieces (item, start, length, sequence, offset): items in descending length,
    each to the sequence with the lowest cost so far that has room for it, or cut
    at the room of the cheapest open one. sum(lengths) must equal sum(rooms)."""
    room, cost, fill = np.array(rooms, np.int64), np.zeros(len(rooms)), np.zeros(len(rooms), np.int64)
    out = []
    todo = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    while todo:
        n, item, start = heapq.heappop(todo)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
        s = int(np.where(fits, cost, np.inf).argmin())
        take = min(n, int(room[s]))
        out.append((item, start, take, s, int(fill[s])))
        room[s] -= take
        fill[s] += take
        cost[s] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(todo, (take - n, item, start + take))
    return out


class _Packer:
    def __init__(self, capacity: int, group_tokens: int, first_sequence: int):
        self.capacity, self.group_tokens, self.sequence = capacity, group_tokens, first_sequence
        self.held, self.tokens = [], 0  # (id, ids, start, end, doc_tokens)

    def add(self, doc, ids: bytes):
        n = len(ids) // 4
        self.held.append((doc, ids, 0, n, n))
        self.tokens += n

    def flush(self, last: bool):
        """The pieces of the whole sequences that are held; the odd tokens stay
        held (the end of the last document), or fill short sequences if last."""
        cap, odd, keep = self.capacity, self.tokens % self.capacity, []
        if not last:
            while odd:  # the odd tokens are fewer than a sequence
                doc, ids, a, z, n = self.held.pop()
                cut = max(a, z - odd)
                keep.append((doc, ids, cut, z, n))
                odd -= z - cut
                if cut > a:
                    self.held.append((doc, ids, a, cut, n))
        whole, rests = [], []  # whole sequences; (held item, start, length)
        for k, (_, _, a, z, _) in enumerate(self.held):
            for s in range(a, z - cap + 1, cap):
                whole.append((k, s, cap))
            if (z - a) % cap:
                rests.append((k, z - (z - a) % cap, (z - a) % cap))
        total = sum(r[2] for r in rests)
        rooms = [cap] * (total // cap) + tail_rooms(total % cap)
        pieces = [(k, s, n, j, 0) for j, (k, s, n) in enumerate(whole)]
        for item, start, n, s, offset in assign([r[2] for r in rests], rooms):
            k, base, _ = rests[item]
            pieces.append((k, base + start, n, len(whole) + s, offset))
        rows = [(self.held[k][0], s, n, zlib.crc32(self.held[k][1][4 * s:4 * (s + n)]), self.held[k][4],
                 self.sequence + j, offset) for k, s, n, j, offset in pieces]
        self.sequence += len(whole) + len(rooms)
        self.held = keep[::-1]
        self.tokens = sum(z - a for _, _, a, z, _ in self.held)
        return rows


def pack(docs, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_tokens: int = 1 << 21,
         id_col: str = "doc_id", text_col: str = "text"):
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    key, end = f"words:{tokenizer}", np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ids_of = worker_cache(key, lambda: WordIds(spec.value))
        packer = _Packer(capacity, group_tokens, TaskContext.get().partitionId() << 32)

        def flush(last):
            if rows := packer.flush(last):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), ids_of([t or "" for t in b.column(1).to_pylist()])):
                packer.add(doc, ids + end)
                if packer.tokens >= group_tokens:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(id_col, text_col).mapInArrow(released(run, key), SCHEMA)
