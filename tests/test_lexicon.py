import random
import re

from pyspark.sql import functions as F

from hatefold.operators import lexicon as LX
from hatefold.plans import fixed_values as FV

FORMS = ["ab", "aba", "aa", "c.", "*a"]


def _lexicon(spark, forms_by_seed, types=None):
    rows = []
    for i, (seed, forms) in enumerate(forms_by_seed):
        rows.append((seed, i, forms, [], (types or {}).get(seed, "profanity"), []))
    return spark.createDataFrame(rows, LX.LEXICON_SCHEMA)


def _expected(texts, forms_by_seed):
    out = set()
    for doc_id, text in texts:
        for seed_ord, (seed, forms) in enumerate(forms_by_seed):
            for form_ord, form in enumerate(forms):
                for m in re.finditer(re.escape(form), text):
                    out.add((doc_id, seed, form, form_ord, m.start(), m.end()))
    return out


def _actual(df):
    return {(r["doc_id"], r["seed"], r["form"], r["form_ord"], r["start"], r["end"]) for r in df.collect()}


def _random_texts(n=200, seed=7):
    rnd = random.Random(seed)
    alphabet = "aabc.*\n é"
    return [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))) for i in range(n)]


def test_matches_equal_finditer_with_overlaps(spark):
    texts = _random_texts()
    forms_by_seed = [("s0", ["ab", "aba"]), ("s1", ["aa"]), ("s2", ["c.", "*a"]), ("s3", ["aba"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    m = LX.match_lexicon(df, _lexicon(spark, forms_by_seed))
    got = _actual(LX.explode_matches(m).select("doc_id", "seed", "form", "form_ord", "start", "end"))
    assert got == _expected(texts, forms_by_seed)


def test_distributed_path_equals_inline_path(spark):
    texts = _random_texts(120, seed=3)
    forms_by_seed = [("s0", ["ab", "aba"]), ("s1", ["aa"]), ("s2", ["c.", "*a"]), ("s3", ["aba"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lex = _lexicon(spark, forms_by_seed)
    a = LX.match_lexicon(df, lex)
    b = LX.match_lexicon(df, lex, max_inline_forms=0)
    ea = {(r["doc_id"], tuple(tuple(x) for x in r["matches"])) for r in a.collect()}
    eb = {(r["doc_id"], tuple(tuple(x) for x in r["matches"])) for r in b.collect()}
    assert ea == eb
    got = _actual(LX.explode_matches(b).select("doc_id", "seed", "form", "form_ord", "start", "end"))
    assert got == _expected(texts, forms_by_seed)


def test_regex_metacharacters_and_null_text(spark):
    forms_by_seed = [("q", ["a\\E.b", "(x)", "\\Q"])]
    texts = [(1, "a\\E.b and (x) \\Q"), (2, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    m = LX.match_lexicon(df, _lexicon(spark, forms_by_seed))
    got = _actual(LX.explode_matches(m).select("doc_id", "seed", "form", "form_ord", "start", "end"))
    assert got == _expected([(1, texts[0][1])], forms_by_seed)


def test_trie_prefers_longest_and_closure():
    pat = LX.trie_pattern(["ab", "aba", "b"])
    assert re.fullmatch(pat, "aba")
    assert LX.prefix_closure(["ab", "aba", "b"])["aba"] == ["ab", "aba"]


def test_looks_like_insult_default_rules(spark):
    cases = {
        "개새끼": True,       # banned prefix
        "개념": False,        # safe word
        "개발자": False,      # exception prefix + safe syllable
        "2019년": False,      # year with 년
        "x 2020 y": False,    # bare year
        "2020이": False,      # Unicode word boundary: no \b between 0 and 이
        "２０２０년": False,  # full-width digits are \d under (?U)
        "ㅋ": False,          # too short
        "12345": False,       # digits
        "정신병자": True,     # fragment
        "hello": False,
        "　병신　": True,  # stripped with Unicode whitespace
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", LX.looks_like_insult(F.col("t")).alias("v")).collect()}
    for k, v in cases.items():
        py = _python_insult(k)
        assert got[k] == v == py, k


def _python_insult(token):
    """Independent statement of the heuristic: ordered reject rules, then the
    first matching banned prefix decides, then fragments."""
    t = token.strip()
    rejects = (len(t) < 2, t in FV.SAFE_WORDS, re.search(FV.YEAR_PATTERN, t) is not None, t.isdigit())
    if any(rejects):
        return False
    prefix = next((p for p in FV.BAN_PREFIX if t.startswith(p)), None)
    if prefix is not None:
        follower = t[len(prefix):len(prefix) + 1]
        return not (prefix == FV.EXCEPTION_PREFIX and follower in FV.SAFE_AFTER_EXCEPTION_PREFIX)
    return any(f in t for f in FV.FRAGMENTS) and re.match(FV.YEAR_PREFIX_PATTERN, t) is None


def test_clean_terms_last_duplicate_wins(spark):
    rows = [(" 병신 ", "5", 0), ("병신", "7", 1), ("씨발", "2", 2), ("미친놈", "x", 3), ("개념", "9", 4),
            ("병신", "1", 5)]
    df = spark.createDataFrame(rows, "term string, cnt string, pos long")
    df = df.withColumn("freq", LX.parse_count(F.col("cnt")))
    got = {r["term"]: (r["freq"], r["pos"]) for r in LX.clean_terms(df, pos_col="pos").collect()}
    # "병신" at pos 5 has freq 1 < 3 and is skipped; pos 1 wins over pos 0; first position kept
    assert got == {"병신": (7, 0)}


def test_parse_count(spark):
    df = spark.createDataFrame([("3",), ("3.7",), ("abc",), (None,), (" 12 ",)], "c string")
    assert [r[0] for r in df.select(LX.parse_count(F.col("c"))).collect()] == [3, 3, 1, 1, 12]


def test_merge_lexicon(spark):
    manual = _lexicon(spark, [("시발", ["시발", "씨발"]), ("병신", ["병신"])])
    manual = manual.withColumn("jamo", F.when(F.col("seed") == "시발", F.array(F.lit("ㅅㅂ")))
                               .otherwise(F.array().cast("array<string>")))
    mined = spark.createDataFrame([("씨발", 5, 0), ("ㅅㅂ", 4, 1), ("병신아", 3, 2), ("시발", 9, 3)],
                                  "term string, freq long, pos long")
    merged = LX.merge_lexicon(manual, mined).collect()
    seeds = [(r["seed"], r["type"], r["canonical"]) for r in sorted(merged, key=lambda r: r["seed_ord"])]
    assert seeds == [("시발", "profanity", ["시발", "씨발"]), ("병신", "profanity", ["병신"]),
                     ("병신아", FV.AUTO_TYPE, ["병신아"])]


def test_mine_terms(spark):
    df = spark.createDataFrame([(1, "Ab ab, c1c! é"), (2, None)], "doc_id long, text string")
    got = {r["term"]: r["freq"] for r in LX.mine_terms(df).collect()}
    assert got == {"ab": 2, "c": 2, "é": 1}


def test_prefix_sum(spark):
    from hatefold.functions.text import prefix_sum
    import itertools
    arrs = [[], [5], [1, 2, 3], list(range(1, 40)), [0] * 7]
    df = spark.createDataFrame([(a,) for a in arrs], "a array<int>")
    got = [r[0] for r in df.select(prefix_sum(F.col("a"))).collect()]
    assert got == [list(itertools.accumulate(a)) for a in arrs]


def test_many_repeats_of_one_form(spark):
    text = "ab" * 20000 + "x"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lex = _lexicon(spark, [("s", ["ab", "ba"])])
    m = LX.explode_matches(LX.match_lexicon(df, lex)).select("doc_id", "seed", "form", "form_ord", "start", "end")
    assert _actual(m) == _expected([(1, text)], [("s", ["ab", "ba"])])


def test_matches_property(spark):
    from hypothesis import given, settings, strategies as st

    alphabet = st.sampled_from(list("ab.*\n"))
    texts_st = st.lists(st.text(alphabet, max_size=20), min_size=1, max_size=12)
    forms_st = st.lists(st.text(alphabet, min_size=1, max_size=3), min_size=1, max_size=4, unique=True)

    @settings(max_examples=12, deadline=None)
    @given(texts_st, forms_st)
    def check(texts, forms):
        rows = list(enumerate(texts))
        forms_by_seed = [("s", forms)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        m = LX.match_lexicon(df, _lexicon(spark, forms_by_seed))
        got = _actual(LX.explode_matches(m).select("doc_id", "seed", "form", "form_ord", "start", "end"))
        assert got == _expected(rows, forms_by_seed)

    check()


def test_form_counts(spark):
    texts = _random_texts(80, seed=11) + [(999, "")]
    forms_by_seed = [("s0", ["ab", "aba"]), ("s1", ["aa"]), ("s3", ["aba"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    m = LX.match_lexicon(df, _lexicon(spark, forms_by_seed))
    got = {}
    for r in m.select("doc_id", LX.form_counts(F.col("matches")).alias("c")).collect():
        for c in r["c"]:
            got[(r["doc_id"], c["seed"], c["form"])] = c["n"]
    want = {}
    for doc_id, seed, form, _, _, _ in _expected(texts, forms_by_seed):
        want[(doc_id, seed, form)] = want.get((doc_id, seed, form), 0) + 1
    assert got == want


def test_count_lexicon_inline_and_distributed(spark):
    texts = _random_texts(100, seed=21)
    forms_by_seed = [("s0", ["ab", "aba"]), ("s1", ["aa"]), ("s3", ["aba"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lex = _lexicon(spark, forms_by_seed)
    want = {}
    for doc_id, seed, form, _, _, _ in _expected(texts, forms_by_seed):
        want[(doc_id, seed, form)] = want.get((doc_id, seed, form), 0) + 1
    for limit, chars in ((LX.MAX_INLINE_FORMS, 0), (0, LX.MAX_AUTOMATON_CHARS), (0, 0)):
        out = LX.prepare_matcher(lex, max_inline_forms=limit, counts_only=True, max_automaton_chars=chars)(df, "text", "doc_id", "counts")
        got = {(r["doc_id"], c["seed"], c["form"]): c["n"] for r in out.collect() for c in r["counts"]}
        assert got == want, limit


def test_all_paths_agree_on_repeated_and_null_ids(spark):
    texts = [(7, "ab aba"), (7, "ab"), (None, "aa c."), (8, None), (7, "ab aba"), (None, "z")]
    forms = [("s0", ["ab", "aba"]), ("s1", ["a"]), ("s2", ["c.", "*a"])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lex = _lexicon(spark, forms)
    for counts_only in (False, True):
        a, b, c = ([(str(r["doc_id"]), r["text"], [tuple(x) for x in r["m"]]) for r in LX.prepare_matcher(
            lex, max_inline_forms=n, counts_only=counts_only, max_automaton_chars=m)(df, "text", "doc_id", "m").collect()]
            for n, m in ((LX.MAX_INLINE_FORMS, 0), (0, LX.MAX_AUTOMATON_CHARS), (0, 0)))
        assert sorted(a, key=str) == sorted(b, key=str) == sorted(c, key=str) and sum(len(x[2]) for x in a) > 0


def test_large_lexicon_compiles_in_seconds(spark):
    import time
    forms = [f"w{i}x" for i in range(5000)]
    lex = spark.createDataFrame([(f, i, [f], [], "profanity", []) for i, f in enumerate(forms)], LX.LEXICON_SCHEMA)
    df = spark.createDataFrame([(i, f"a w{i}x w{i * 7 % 5000}x b") for i in range(200)], "doc_id long, text string")
    t = time.time()
    rows = LX.match_lexicon(df, lex).collect()
    assert time.time() - t < 60  # 5,000 column expressions per lookup table took minutes
    assert all({m["form"] for m in r["matches"]} == {f"w{r['doc_id']}x", f"w{r['doc_id'] * 7 % 5000}x"} for r in rows)


def test_added_seeds_have_an_ordinal_each(spark):
    manual = _lexicon(spark, [("s0", ["ab"]), ("s1", ["aa"])])
    mined = spark.createDataFrame([("zz", 5, None), ("aab", 3, None), ("aaa", 5, None), ("ab", 9, None)], "term string, freq long, pos long")
    got = {r["seed"]: r["seed_ord"] for r in LX.merge_lexicon(manual, mined).collect()}
    assert got == {"s0": 0, "s1": 1, "aaa": 2, "zz": 3, "aab": 4}


def test_automata_equal_finditer(spark):
    from hatefold.operators import automata as A
    texts = _random_texts(120, seed=5) + [(998, ""), (999, "ab" * 4000), (997, None), (996, "é́é́中文中文中")]
    forms_by_seed = [("s0", FORMS), ("s1", ["aa", "baa", "é́", "中文中"]), ("s2", ["a" * 60])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    forms = LX.lexicon_forms(_lexicon(spark, forms_by_seed))
    for shard_chars in (1, 5, A.SHARD_CHARS):  # many automata, or one
        m = df.withColumn("matches", A.automaton_matcher(forms, shard_chars=shard_chars)(F.col("text")))
        got = _actual(LX.explode_matches(m).select("doc_id", "seed", "form", "form_ord", "start", "end"))
        assert got == _expected([(i, t or "") for i, t in texts], forms_by_seed)


def test_shards_are_bounded_and_complete():
    from hatefold.operators.automata import shards
    rows = [{"form": f"{c}{i}", "seed": c, "seed_ord": 0, "form_ord": i, "type": None} for c in "abc" for i in range(50)]
    made = shards(rows + rows[:3], 20)
    assert sorted(f for _, e in made for f, _ in e) == sorted(r["form"] for r in rows)
    assert all(sum(len(f) for f, _ in e[:-1]) < 20 and heads == {f[0] for f, _ in e} for heads, e in made)
    assert shards([]) == []


def test_large_lexicon_stays_row_local(spark):
    forms = [f"w{i}x" for i in range(6000)]
    lex = spark.createDataFrame([(f, i, [f], [], "profanity", []) for i, f in enumerate(forms)], LX.LEXICON_SCHEMA)
    df = spark.createDataFrame([(i, f"a w{i}x w{i * 7 % 6000}x b") for i in range(200)], "doc_id long, text string")
    out = LX.match_lexicon(df, lex)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert all({m["form"] for m in r["matches"]} == {f"w{r['doc_id']}x", f"w{r['doc_id'] * 7 % 6000}x"} for r in out.collect())


def test_rules_run_on_counted_terms_only(spark):
    """Pushed below the count, the rules would run on every occurrence of a term."""
    df = spark.createDataFrame([("fuckx fuckx fuckx 병신 병신 ok",)], "text string")
    cleaned = LX.clean_terms(LX.mine_terms(df), min_freq=2, rules=LX.InsultRules(ban_prefix=["fuck"], exception_prefix=None, fragments=["병신"]))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "병신" not in plan[plan.index("count(1)"):]
    assert {tuple(r) for r in cleaned.select("term", "freq").collect()} == {("fuckx", 3), ("병신", 2)}


def test_join_of_chunks_equals_finditer(spark):
    """Forms with white space, long ones and shared prefixes over many small chunks; copies of a text lie apart."""
    texts = _random_texts(150, seed=9) + [(500 + i, "ab aba \n c. " + "ab" * 20) for i in range(30)] + [(600, None), (601, "x" * 50 + " yz \U0001f600 中文中")]
    forms_by_seed = [("s0", FORMS), ("s1", ["ab a", " ", "\n c", "a aba \n c.", "ab aba \n c. abababab"]), ("s2", ["ab" * 9, "ab" * 11, "x" * 40, "\U0001f600", "yz \U0001f600", "文中"])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    forms = LX.lexicon_forms(_lexicon(spark, forms_by_seed))
    for size in (60, LX.CHUNK_CHARS):
        out = LX._match_distributed(df, forms, "text", "matches", chunk_chars=size)
        assert out.count() == len(texts)
        got = _actual(LX.explode_matches(out).select("doc_id", "seed", "form", "form_ord", "start", "end"))
        assert got == _expected([(i, t or "") for i, t in texts], forms_by_seed)


def test_lexicon_over_the_bound_is_not_fetched(spark):
    """A form of a large lexicon must not pass through the driver (F1: 1.4 million forms were collected)."""
    forms = [f"w{i}x" + "y" * 90 for i in range(22000)]
    lex = spark.createDataFrame([(f, i, [f], [], "profanity", []) for i, f in enumerate(forms)], LX.LEXICON_SCHEMA)
    df = spark.createDataFrame([(i, f"a {forms[i]} b") for i in range(20)], "doc_id long, text string")
    out = LX.count_lexicon(df, lex)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], c["form"], c["n"]) for r in out.collect() for c in r["counts"]} == {(i, forms[i], 1) for i in range(20)}


def test_distributed_matcher_writes_only_words_with_a_form(spark, monkeypatch):
    kept, write = {}, LX.written
    monkeypatch.setattr(LX, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    docs = spark.createDataFrame([(1, " one trash\ttwo  trashy "), (2, "three four"), (3, None), (4, "trash")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("trash", 0, ["trash"], [], "profanity", [])], LX.LEXICON_SCHEMA)
    got = LX.match_lexicon(docs, lexicon, max_inline_forms=0, max_automaton_chars=0).collect()
    assert {r.doc_id: [m.start for m in r.matches] for r in got} == {1: [5, 16], 2: [], 3: [], 4: [0]}
    assert sorted(r.word for r in kept["words"].collect()) == ["trash", "trashy"]
