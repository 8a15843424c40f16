"""Periodic runs, source divergence and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_brute import CLASHING, EDGE, LONG, frame, lower
from pyspark.sql import functions as F

from hatefold.llm import chat_format, periodic_runs, queries, source_divergence

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# ------------------------------------------------------------ periodic runs

def brute_runs(words, least=6, exponent=4):
    found, codes = {}, np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, len(words) // max(exponent, 1) + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]]).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) > 0), np.flatnonzero(np.diff(same) < 0)):
            if e - s >= max(least, exponent * q) - q:
                found.setdefault((int(s), int(e) + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text, rewrite):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(kept)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(0, 30), st.integers(1, 8), st.sampled_from([(6, 4), (2, 2), (3, 2), (9, 3), (1, 2)]))
def test_runs_equal_brute_force(words, a, p, rule):
    looped = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    codes = np.unique(looped, return_inverse=True)[1].astype(np.int64)
    assert periodic_runs.find_runs(codes, *rule) == brute_runs(looped, *rule)


def test_suffixes_in_order():
    random.seed(2)
    for n in (1, 2, 7, 60):
        codes = [random.randrange(3) for _ in range(n)]
        order = periodic_runs.suffix_order(np.array(codes)).tolist()
        assert order == sorted(range(n), key=lambda i: codes[i:])
        shared = periodic_runs.common_prefixes(codes, order)
        for r in range(1, n):
            a, b = codes[order[r - 1]:], codes[order[r]:]
            assert shared[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_strongest_run_is_exact():
    assert periodic_runs.strongest([(9, 10**17 + 1, 10**16), (3, 10**17, 10**16)]) == (9, 10**17 + 1, 10**16)
    assert periodic_runs.strongest([(0, 8, 2), (4, 12, 3), (5, 4, 1)]) == (0, 8, 2)


def test_run_query_edges(spark, tmp_path):
    random.seed(5)
    rows = EDGE + [(i, " ".join(random.choice("ab") for _ in range(random.randrange(60)))) for i in range(20, 60)]
    rows += [(70, "x " * 5000), (71, ("y z\n" * 9 + "q ") * 4 + LONG), (72, "é é " * 6), (73, "\x1c " * 6), (74, "A a " * 3 + "A a")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(map(str, got)) == sorted(str(brute_row(i, t, True)) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 20
    plain = periodic_runs.periodic_runs(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), len(r.runs), sha(r.collapsed)) for r in plain) == sorted((str(i), (b := brute_row(i, t, False))[1], b[-1]) for i, t in rows)
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_run_query_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_runs, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries.op11(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (b := brute_row(d, t, True))[1:2] + b[5:] for d, t in docs}
    assert sum(n > 0 for n, *_ in got.values()) > 5


def test_words_are_cut_by_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PIECE", 7)
    data = b"  ab cd  ab cd\tab cd ab cd a\x0bb\n"
    assert periodic_runs.judge(data, 6, 4) == ([(0, 8, 2)], b"ab cd a b")


# -------------------------------------------------------- source divergence

def brute_audit(rows, least, top):
    """rows of (lang, source, text)."""
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for g, s, t in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for g, s, terms in docs:
        seen[g].update(set(terms))
    kept = {g: {t for t, n in c.items() if n >= least} for g, c in seen.items()}
    for g, s, terms in docs:
        for t in [None, *terms]:
            if t is None or t in kept[g]:
                count[g, s][t] += t is not None
                count[g, None][t] += t is not None
    def p(key):  # noqa: E306
        total, v = sum(count[key].values()), len(kept[key[0]])
        return {t: 1 + 10**9 * (count[key][t] + 2) // (total + 2 * v) for t in kept[key[0]]}
    share, out = {k: p(k) for k in count}, []
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for g, s in count:
        if s is None:
            continue
        pairs = [(o, sum(f(share[g, s][t], share[g, o][t]) for t in kept[g])) for h, o in count if h == g and o not in (None, s)]
        terms = [(t, f(share[g, s][t], share[g, None][t])) for t in kept[g] if count[g, s][t] and share[g, s][t] > share[g, None][t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            out += [(g, s, part, i, v, r) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit], 1)]
    return sorted(out)


def audit_rows(seed, n=120, sources=9):
    random.seed(seed)
    words = [f"{x}{y}" for x in ("a", "É", "zz", "中") for y in "bcdefghijkl"]
    rows = [(random.choice(["en", "fr", None]), random.choice([f"s{k}" for k in range(sources)] + [None]), " ".join(random.choice(words[:random.choice([5, 44])]).title() + random.choice(["", ".", "1", "_"]) for _ in range(random.randrange(12)))) for _ in range(n)]
    return rows + [("xx", "one", "alone"), ("xx", "two", None), ("xx", None, ""), ("solo", "s", "word"), ("en", "quiet", None), ("en", "big", "ab " * 50_000)]


@pytest.mark.parametrize("options", [{}, {"shard_keys": 3, "tile": 2, "broadcast_bytes": 60}, {"shard_keys": 5, "tile": 4, "top": 2, "min_documents": 4}])
def test_audit_equals_brute_force(spark, options):
    rows = audit_rows(len(options))
    docs = spark.createDataFrame([(g, s, t) for g, s, t in rows], "lang string, source string, text string").repartition(5)
    docs = docs.withColumns({c: F.lit(c) for c in CLASHING if c not in docs.columns} | {"doc_id": F.lit(1), "shard": F.lit("x"), "total": F.lit(0), "terms": F.lit(0)})
    options = {"min_documents": 3, "top": 10} | options
    got = source_divergence.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, options["min_documents"], options["top"])


def test_audit_edges(spark, monkeypatch):
    schema = "lang string, source string, text string"
    assert source_divergence.audit(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, s, None) for s in ("a", "b", "b", None)]
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in source_divergence.audit(spark.createDataFrame(rows, schema)).collect()) == [
        ("", "a", 0, 1), ("", "b", 0, 2), ("a", "", 0, 1), ("a", "b", 0, 2), ("b", "", 0, 1), ("b", "a", 0, 2)]
    for name, small in (("HELD_TERMS", 7), ("HELD_SLOTS", 9), ("_PIECE", 16)):  # folded and sent many times
        monkeypatch.setattr(source_divergence, name, small)
    rows = audit_rows(9, 60, 3)[:-1]
    got = source_divergence.audit(spark.createDataFrame(rows, schema), min_documents=3).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 3, 10)


@pytest.mark.parametrize("levels", [0, 1, source_divergence.LEVELS])
def test_perfect_hash_is_minimal_and_verified(levels):
    keys = [f"k{i}é".encode() for i in range(999)] + [b"", b"a" * 500]
    made = source_divergence.PerfectHash.build(pa.array(keys, pa.binary()), levels)
    made = source_divergence.PerfectHash.unpacked(made.packed())
    asked = pa.array(keys + [f"x{i}".encode() for i in range(5000)], pa.binary())
    slots = made.slots(asked, source_divergence.prints(asked)).tolist()
    assert sorted(slots[:len(keys)]) == list(range(len(keys))) and set(slots[len(keys):]) == {-1}
    assert made.slots(asked[:0], source_divergence.prints(asked[:0])).tolist() == []


def test_shares_are_exact():
    counts, total, terms = np.array([0, 1, 10**15, 3 * 10**15 - 7]), 4 * 10**15, 12345
    assert source_divergence.shares(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]


# ---------------------------------------------------------- chat formatting

BITS = ["<s>", "</s>", "[INST]", " [/INST] ", "<<SYS>>\n", "\n<</SYS>>\n\n", "\\", "<", "[", "\n", " ", "é", "<<ROLE>>", "s>", "/", "INST]", "SYS>>", "a", "😀", "\r"]
SAID = st.lists(st.sampled_from(BITS), max_size=6).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a\nb<s>\\n"]), SAID), max_size=6))
def test_turns_come_back(turns):
    text = "".join(a + chat_format.escape(t) + z for (r, t), (a, z) in zip(turns, (chat_format.marks(r) for r, _ in turns)))
    assert chat_format.read_turns(text) == turns


def chat_rows(n=40):
    random.seed(8)
    said = lambda: random.choice([None, "", "".join(random.choice(BITS) for _ in range(random.randrange(30)))])
    rows = [(c, k, random.choice(["user", "assistant", "system", None, "tool"]), said()) for c in [*range(n), None, -3] for k in range(random.choice([1, 2, 9]))]
    rows += [(500, k, "assistant" if k % 2 else "user", f"turn {k} <s>") for k in range(3000)] + [(501, 0, "assistant", LONG), (501, None, "user", "first")]
    return rows + [(502, 0, "user", "same")] * 3 + [(503, 4, "assistant", "only é😀")]


def brute_chats(rows):
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((-1 if k is None else k, r is not None, r or "", t is not None, t or ""))
    out = []
    for c, turns in by.items():
        turns = [(x[2], x[4]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(a) + len(chat_format.escape(t)) + len(z) for (r, t), (a, z) in zip(turns, (chat_format.marks(r) for r, _ in turns)))
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size))
    return sorted(out, key=str)


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("part_bytes", [chat_format.PART_BYTES, 300])
def test_chat_digest_equals_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat_format, "PART_BYTES", part_bytes)
    rows = chat_rows()
    turns = spark.createDataFrame(rows, CHAT).repartition(7).withColumns({c: F.lit(c) for c in [*CLASHING, "section", "part"]})
    assert sorted(map(tuple, chat_format.chat_digest(turns).collect()), key=str) == brute_chats(rows)
    assert chat_format.chat_digest(spark.createDataFrame([], CHAT)).collect() == []


def test_sections_and_parts_make_up_the_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_BYTES", 2000)
    rows = chat_rows(6)
    parts = chat_format.format_chats(spark.createDataFrame(rows, CHAT).repartition(3), turns_per_section=100).collect()
    assert len({p.section for p in parts if p.conv_id == 500}) == 30
    by = defaultdict(list)
    for p in sorted(parts, key=lambda p: (p.section, p.part)):
        by[p.conv_id].append(p)
    want = {c: (n, t, k, loss, size) for c, n, t, k, loss, size in brute_chats(rows)}
    assert set(by) == set(want)
    for c, own in by.items():
        text = "".join(p.text for p in own)
        turns = chat_format.read_turns(text)
        loss = "".join(chat_format.unescape(p.text[s:s + n]) for p in own for s, n in zip(p.loss_start, p.loss_length))
        assert (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)) == want[c]
        assert sum(p.n_turns for p in own) == len(turns)


def test_control_conversation(spark):
    rows = queries.op13(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()
    said = "</s>[INST] ok [/INST]"
    assert [tuple(r) for r in rows] == [(-7, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said), 2 * (len(said) + 3) + 24)]
