"""Token counts of a byte-level BPE vocabulary, by heap-and-linked-list merging.

A text is cut at the vocabulary's special strings (one token each), then by the
byte-level pattern; a piece costs its bytes minus the merges made in it
(``pair_merge.merge_count``). No identifiers are produced. Words repeat, so a
bounded cache per worker keeps the counts of short pieces between spaces.

Cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null;
repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import json

import pyarrow as pa

from .common import worker_cache
from .pair_merge import merge_count

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: The pre-tokenisation pattern that byte-level vocabularies
#: without one of their own use, and the split of bytes into printable symbols.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_ENTRIES = 400_000
CACHE_LENGTH = 64


def byte_symbols() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Counter:
    """Token counts of texts under one tokenizers-JSON byte-level BPE file."""

    def __init__(self, spec: str):
        import regex

        spec = json.loads(spec)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        chars = byte_symbols()
        self.symbol = [vocab[chars[b]] for b in range(256)]
        self.findall = regex.compile(BYTE_LEVEL_PATTERN).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = special
        self.split_special = regex.compile("|".join(map(regex.escape, special))).split if special else None
        self.beside = regex.compile(r" \s|\s ").search
        self.words: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        return merge_count([self.symbol[b] for b in piece.encode()], self.ranks)

    def plain(self, text: str) -> int:
        return sum(map(self.piece, self.findall(text)))

    def word(self, word: str) -> int:
        n = self.plain(word)
        if len(word) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = n
        return n

    def stretch(self, text: str) -> int:
        """Tokens of a text without special strings. A single space between two
        visible characters always begins a piece, so the text can be cut there."""
        if self.beside(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        get, total = self.words.get, self.plain(first)
        for w in rest:
            w = " " + w
            n = get(w)
            total += self.word(w) if n is None else n
        return total

    def __call__(self, text: str) -> int:
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special(text)
            return sum(map(self.stretch, parts)) + len(parts) - 1
        return self.stretch(text)


def token_counts(docs, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``vocabulary``: path of a tokenizers JSON with a byte-level BPE model. It is
    read here once and travels with the task as a few hundred kB of JSON.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    key = f"counter:{vocabulary}"

    def run(batches):
        count = worker_cache(key, lambda: Counter(spec.value))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
