"""Token counts, byte-level codec and packing against the public libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import EDGE, frame
from tokenizers import Tokenizer

from hatefold.llm import bpe_codec, packing, token_counts
from hatefold.llm.common import text_buffer
from hatefold.llm.pair_merge import merge, merge_count

BYTE, WORD, RANKS = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
TRICKY = st.text(st.sampled_from(list("ab 'srevlmdtT\n\t\r\x0b 　.,1½é中ß́İΣ%&|<>")), max_size=60)


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe_codec.Codec(f.read())


@pytest.fixture(scope="module")
def tiktoken_of(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    with open(BYTE, encoding="utf-8") as f:
        return token_counts.Counter(f.read())


@pytest.fixture(scope="module")
def word_ids():
    with open(WORD, encoding="utf-8") as f:
        return packing.WordIds(f.read())


BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(TRICKY, st.booleans())
def test_counts_equal_the_library(counter, text, special):
    text = text + "<|endoftext|>" + text if special else text
    assert counter(text) == len(BYTE_LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(TRICKY, max_size=6))
def test_codec_equals_the_library(codec, tiktoken_of, texts):
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec(*text_buffer(pa.array(texts, pa.string())))]
    assert ids == [tiktoken_of.encode_ordinary(t) for t in texts]
    assert [codec.decode(np.array(x, np.int64)).decode() for x in ids] == texts


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_word_ids_equal_the_library(word_ids, text):
    for t in (text, text + "<|endoftext|>"):
        assert np.frombuffer(next(word_ids([t])), "<u4").tolist() == WORD_LIBRARY.encode(t, add_special_tokens=False).ids


def test_scan_over_many_blocks(codec, tiktoken_of):
    text = "ab  c'd\n\n" * 5000 + "x" * 3000 + " " * 3000
    ids = codec(*text_buffer(pa.array([text, "", None, "'s", text])))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [tiktoken_of.encode_ordinary(t) for t in (text, "", "", "'s", text)]


def test_merging_ties_and_stale_pairs():
    ranks = {("a", "a"): (0, "aa"), ("aa", "a"): (1, "aaa"), ("aa", "aa"): (2, "aaaa")}
    for n in range(12):
        naive = ["a"] * n
        while True:
            best = min((ranks[p] + (i,) for i, p in enumerate(zip(naive, naive[1:])) if p in ranks), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            naive[best[2]:best[2] + 2] = [best[1]]
        assert merge(["a"] * n, lambda x, y: ranks.get((x, y))) == naive
    assert merge_count([1] * 100_000, {}) == 100_000


def test_count_query_edges(spark):
    rows = token_counts.token_counts(frame(spark, EDGE), BYTE, limit=5).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t in EDGE)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.token_counts(frame(spark, []), BYTE).collect() == []


def test_codec_query_edges(spark, tiktoken_of):
    rows = bpe_codec.codec_digest(frame(spark, EDGE), RANKS).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(x := tiktoken_of.encode_ordinary(t or "")), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe_codec.codec_digest(frame(spark, []), RANKS).collect() == []


def test_encode_then_decode(spark):
    docs = frame(spark, EDGE)
    back = bpe_codec.decode(bpe_codec.encode(docs, RANKS), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.text)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in EDGE)


def check_pieces(pieces, texts, capacity=4096):
    """Each id in exactly one piece, digests and gapless offsets, no padding."""
    ids = {i: np.array([*WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length > 0 and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and at & (at - 1) == 0


def test_pack_pieces(spark):
    random.seed(4)
    texts = {i: " ".join(random.choice(["alpha", "be", "gamma42", "δ", "x.y!"]) for _ in range(random.choice([0, 1, 5, 300, 9000]))) for i in range(60)} | {99: None}
    for parts in (1, 3):
        docs = frame(spark, list(texts.items())).repartition(parts)
        check_pieces(packing.pack(docs, WORD).collect(), texts)
        check_pieces(packing.pack(docs, WORD, group_tokens=6000).collect(), texts)
    assert packing.pack(frame(spark, []), WORD).collect() == []
    rows = packing.pack(frame(spark, [(None, "a"), (1, "b"), (1, "b")]), WORD).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == [("1", 2), ("1", 2), ("None", 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_assignment_fills_every_room(lengths):
    total = sum(lengths)
    rooms = [256] * (total // 256) + packing.tail_rooms(total % 256)
    got = packing.assign(lengths, rooms)
    assert sorted(sum((list(range(s, s + n)) for i, s, n, *_ in got if i == k), []) for k in range(len(lengths))) == sorted(list(range(n)) for n in lengths)
    for s, room in enumerate(rooms):
        assert sum(n for *_, n, q, _ in got if q == s) == room


def test_lowest_cost_sequence_first():
    got = packing.assign([6, 5, 4, 3, 2], [10, 10])
    assert [(i, s) for i, _, _, s, _ in got] == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 1)] or sum(n for *_, n, s, _ in got if s == 0) == 10
