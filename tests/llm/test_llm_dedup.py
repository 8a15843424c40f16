"""Exact, near, passage and line dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from llm_brute import EDGE, LONG, Union, cut, cut_digest, edits, frame, lower, near, shingles

from hatefold.llm import exact_dedup, jaccard_join, line_dedup, suffix_dedup
from hatefold.llm.components import components


def varied(seed=7, n=151):
    """Documents with near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "é") for b in ("n", "st", "ra", "x", "voo", "z")]
    passage = " ".join(rng.choice(words) for _ in range(20))
    hot = " ".join(rng.choice(words) for _ in range(60))
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:  # near copies of one text
            w = hot.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind < 0.5 and docs:
            w = rng.choice(docs)[1].split(" ")
            w[rng.randrange(len(w))] = rng.choice(words).upper()
            text = " ".join(w)
        else:
            text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            text += "\n" + passage + "\n" + passage[:40]
        docs.append((i * 3 % n + 1, text))
    return docs


# ------------------------------------------------------------------- exact

def test_cuckoo_index_inserts_deletes_and_grows():
    index, digests = exact_dedup.CuckooIndex(buckets=2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        assert index.find(d) is None
        index.insert(d, [i, 0, 1, 1])
    assert index.mask + 1 > 2 and all(index.find(d)[0] == i for i, d in enumerate(digests))
    for d in digests[::2]:
        assert index.delete(d)
    assert not index.delete(digests[0]) and [index.find(d) is None for d in digests] == [i % 2 == 0 for i in range(3000)]
    assert index.size == 1500 == sum(1 for _ in index.live()) == sum(s != 0 for s in index.slots)
    index.insert(digests[0], [0, 0, 1, 1])
    assert index.find(digests[0]) == [0, 0, 1, 1]


def test_exact_dedup_edges(spark):
    rows = [*EDGE, *[(100 + i, "Hot") for i in range(50)]]
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(5)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted((str(i), str(best[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def test_keep_one_keeps_all_columns(spark):
    docs = frame(spark, EDGE)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), lower(r.text)) for r in kept.collect()) == sorted(
        (str(i), t) for t, i in {t: max((i for i, u in EDGE if lower(u) == t and i is not None), default=None) for t in {lower(u) for _, u in EDGE}}.items())


# -------------------------------------------------------------------- near

def check_near(spark, rows, k, percent):
    got = jaccard_join.near_duplicates(frame(spark, rows).repartition(4), k, percent).collect()
    want = near(rows, k, percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        (str(i), len(shingles(t, k)), str(want.get(i))) for i, t in rows)
    return want


def test_near_duplicates_equal_brute_force(spark):
    rows = varied()
    for k, percent in ((3, 90), (5, 80), (1, 60)):
        part = check_near(spark, rows, k, percent)
        assert len(set(part.values())) < len(part)


def test_near_duplicates_exactly_at_the_threshold(spark):
    base = [f"w{i}" for i in range(21)]  # 19 three-word shingles
    rows = [(5, " ".join(base)), (3, " ".join(base[:-1])), (9, " ".join(base[:-2])), (1, " ".join(base[2:-2]))]
    check_near(spark, rows, 3, 90)
    check_near(spark, [(1, " ".join(base[:11])), (2, " ".join(base[:12]))], 3, 90)


def test_rows_that_share_an_id_are_one_node(spark):
    check_near(spark, varied(n=90), 3, 90)  # each id three times


def test_near_duplicates_edges(spark):
    check_near(spark, EDGE, 3, 90)
    assert jaccard_join.near_duplicates(frame(spark, []), 3, 90).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(29, 100), (500, 501), (501, 501), (None, 4), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    u = Union()
    for a, b in links:
        if a is not None and a != b:
            u.tie(a, b)
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- passages

def test_repeats_equal_brute_force(spark):
    rows = varied(3)
    got = [tuple(r) for r in suffix_dedup.repeat_digest(frame(spark, rows).repartition(4)).collect()]
    assert sorted(got) == sorted(cut_digest(rows)) and sum(r[2] for r in got) > 0


def test_repeats_at_the_width(spark):
    s = "".join(chr(97 + i * i % 23) for i in range(120))
    rows = [(4, s[:50]), (2, "x" + s[:50] + "y"), (7, s[:49]), (8, s[1:50] + "?"), (9, s[30:90]), (10, s[35:85] + s[35:85]), (3, s[35:85]), (11, "aaaa" * 40), (12, "aaaa" * 30)]
    got = [tuple(r) for r in suffix_dedup.repeat_digest(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(cut_digest(rows))


def test_previous_factors_equal_brute_force():
    rng = np.random.default_rng(1)
    for turn in range(300):
        n, width = int(rng.integers(1, 120)), int(rng.integers(1, 60))
        text = rng.integers(0, int(rng.integers(1, 4)), n).astype(np.uint8)
        if n < width:
            continue
        start = np.sort(rng.choice(n - width + 1, size=int(rng.integers(1, n - width + 2)), replace=False))
        owner = rng.integers(0, 6, len(start))
        if turn % 2:
            owner = np.sort(owner)
        windows = [text[a:a + width].tobytes() for a in start]
        common = lambda i, j: next((k for k in range(width) if windows[i][k] != windows[j][k]), width)
        order, lcp = suffix_dedup.suffix_order(text, start, width)
        assert order.tolist() == sorted(range(len(start)), key=lambda i: (windows[i], i))
        assert lcp.tolist() == [0, *map(common, order[:-1], order[1:])]
        for i, got in enumerate(suffix_dedup.previous_factors(text, start, owner, width).tolist()):
            want = max((common(i, j) for j in range(len(start)) if owner[j] < owner[i]), default=0)
            assert got == want if want >= width else want <= got < width


def test_repeats_edges(spark):
    got = [tuple(r) for r in suffix_dedup.repeat_digest(frame(spark, EDGE).repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, cut_digest(EDGE)))
    assert suffix_dedup.repeat_digest(frame(spark, [])).collect() == []
    docs = frame(spark, EDGE)
    cleaned = suffix_dedup.remove_repeats(docs)
    assert cleaned.columns == [*docs.columns, "__removed"]
    assert sorted((str(r.doc_id), r.text, r.digest) for r in cleaned.collect()) == sorted(
        (str(i), k.decode("utf-8", "ignore"), "digest") for (i, _), (k, _) in zip(EDGE, cut(EDGE)))


# ------------------------------------------------------------------- lines

def brute_lines(rows, k=2, min_exact=12, min_near=40):
    seen, u = defaultdict(list), Union()
    for i, t in rows:
        if i is not None:
            for n, line in enumerate((t or "").split("\n")):
                if len(line) >= min_exact and line.strip():
                    seen[line].append((i, n))
                    u.find(line)
    texts = sorted(x for x in seen if len(x) >= min_near)
    for a in range(len(texts)):
        for b in range(a):
            if abs(len(texts[a]) - len(texts[b])) <= k and edits(texts[a], texts[b]) <= k:
                u.tie(texts[a], texts[b])
    first = {}
    for x, places in seen.items():
        first[u.find(x)] = min([first.get(u.find(x), min(places)), *places])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        out.append((str(i), len(lines), [n for n, x in enumerate(lines) if i is not None and x in seen and (i, n) > first[u.find(x)]]))
    return sorted(out)


def line_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(38, 60))) for _ in range(12)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 4)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                p, op = rng.randrange(len(s)), rng.random()
                s[p:p + (op < 0.6)] = [] if op < 0.3 else [rng.choice("abcx")]
            lines.append("".join(s))
        rows.append((i * 7 % 80, "\n".join([*lines, "short", "a line of mid", ""])))
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    got = line_dedup.repeated_lines(frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.removed_lines) for r in got) == brute_lines(rows)
    assert all(r.n_removed == len(r.removed_lines) >= r.n_near for r in got) and sum(r.n_near for r in got) > 0


def test_lines_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n  \t        \n"), (None, "a line of the size of more than forty characters"), (4, "a line of the size of more than forty characters"),
            (5, "a line of the size of more than forty character"), (6, LONG), (7, LONG[:-1]), (8, "tie tie tie tie\ntie tie tie tie")]
    got = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.removed_lines) for r in got) == sorted(
        (str(i), len((t or "").split("\n")), {5: [0], 7: [0], 8: [1]}.get(i, [])) for i, t in rows)
    assert line_dedup.repeated_lines(frame(spark, [])).collect() == []
    docs = frame(spark, rows)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        (str(i), {5: "", 7: "", 8: "tie tie tie tie"}.get(i, str(t))) for i, t in rows)


def test_short_lines_of_the_query_equal_brute_force(spark, tmp_path):
    from hatefold.llm.queries import QUERIES

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (1, 2, 4, 8, 9, 10, 11, 12, 15, 18, 19, 20, 21, 22, 28, 39, 41)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                p, op = rng.randint(0, len(s)), rng.random()
                s[p:p + (op < 0.6)] = [] if op < 0.3 else [rng.choice("abcx")]
            lines.append("".join(s))
        rows.append((i * 7 % 120, "\n".join([*lines, "Les.", " "])))
    frame(spark, rows, clash=False).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()
    seen, u = defaultdict(list), Union()
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                seen[line].append((i, n))
    texts = sorted(seen)
    for a, x in enumerate(texts):
        u.find(x)
        for y in texts[:a]:
            allowed = min(len(x), len(y)) // 10
            if allowed and abs(len(x) - len(y)) <= 2 and edits(x, y) <= min(allowed, 2):
                u.tie(x, y)
    first = {}
    for x, places in seen.items():
        first[u.find(x)] = min([first.get(u.find(x), min(places)), *places])
    want = sorted((i, [n for n, x in enumerate(t.split("\n")) if x in seen and (i, n) > first[u.find(x)]]) for i, t in rows)
    assert sorted((r.doc_id, r.removed_lines) for r in got) == want
    assert sum(r.n_near for r in got) > 0


def test_banded_edit_distance():
    rng, pairs = random.Random(2), []
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            p, op = rng.randint(0, len(b)), rng.random()
            b[p:p + (op < 0.6)] = [] if op < 0.3 else [rng.choice("abc")]
        pairs.append((a, "".join(b)))
    for k in (1, 2, 3):
        assert line_dedup.within_edits(pairs, k).tolist() == [edits(a, b) <= k for a, b in pairs]


def test_often_equals_counting():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 50, 5000):
        for span in (1, 2, 10, 900):
            grams = r.integers(0, span, n).astype(np.uint64)
            values, counts = np.unique(grams, return_counts=True)
            often, times = jaccard_join._often(grams.copy(), 4)
            assert often.tolist() == values[counts >= 4].tolist() and times.tolist() == counts[counts >= 4].tolist()


def test_order_counts_ngrams_over_all_tasks(spark):
    rows = [(i, f"often met here w{i} x{i} y{i}") for i in range(6)]  # at most one in each task
    ids, n_buckets = jaccard_join.frequent_order(frame(spark, rows).repartition(6, "doc_id"), "text", 3)
    text = np.frombuffer(b"often met here", np.uint8)
    gram = jaccard_join.shingle_sets(text, np.array([0, len(text)]), 3)[0]
    assert ids.tolist() == jaccard_join.gram_id(gram, n_buckets).tolist()
    keys = jaccard_join.GramOrder(ids, n_buckets)(np.concatenate([gram, gram + np.uint64(1 << 50)]))
    assert keys[0] >= 1 << 63 > keys[1]


def test_texts_of_pairs_only(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, "no id"), (7, None)]
    ends = spark.createDataFrame([(i,) for i in range(0, 2000, 50)] + [(7,), (7,)], "gid long")
    got = [(r.doc_id, r.text) for r in jaccard_join._texts_of(frame(spark, rows), ends).collect()]
    assert len(got) < 100 and len(got) == len(set(got))
    assert {(i, f"text {i}") for i in [*range(0, 2000, 50), 7]} | {(7, None)} <= set(got)


def test_components_of_other_types(spark):
    links = [(b"c", b"b"), (b"b", b"a"), (b"x", b"y"), (None, b"z"), (b"z", b"z")]
    got = {bytes(r.node): bytes(r.component) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x"}
