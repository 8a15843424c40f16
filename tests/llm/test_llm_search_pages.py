"""Top-k search, HTML extraction and language identification."""

import random

import pytest
from llm_brute import CLASHING, EDGE, frame
from pyspark.sql import functions as F

from hatefold.llm import html_extract, language_id, topk

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------------- top-k

def brute_topk(vectors, queries, k):
    import math

    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(1024 * x) for x in v]
    data = [(i, ints(v)) for i, v in vectors if i is not None and ok(v)]
    out = set()
    for q, v in queries:
        if q is None or not ok(v):
            continue
        v = ints(v)
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in data if i != q and len(x) == len(v))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.mark.parametrize("hot", [False, True])
def test_topk_equals_brute_force(spark, hot):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) if i % 3 else rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows = [(i, [float(f"{x:.3f}") * 1.0 for x in v]) for i, v in rows]
    import numpy as np
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    if hot:
        rows += [(1000 + i, rows[0][1]) for i in range(300)]
    data = vectors(spark, rows).repartition(4)
    queries = data.filter(F.col("vec_id") % 20 == 0)
    got = {tuple(r) for r in topk.topk(data, queries, k=7, n_pivots=16, block_rows=32).collect()}
    assert got == brute_topk(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [-1.0, 0.5]),
            (8, [-1.0, 0.5]), (9, [1.0, 0.0]), (None, [3.0, 3.0]), (10, [1.0, 2.0, 3.0]), (11, [0.0, 0.0]), (12, [1.0, 0.0, 0.0])]
    data = vectors(spark, rows)
    assert {tuple(r) for r in topk.topk(data, data.dropDuplicates(["vec_id"]), k=3).collect()} == brute_topk(rows, list(dict(rows).items()), 3)
    empty = vectors(spark, [])
    assert topk.topk(empty, empty).collect() == [] and topk.topk(data, empty).collect() == [] and topk.topk(empty, data).collect() == []


def test_repeated_rows_hide_no_other_id(spark):
    """A query row repeated more than k times, and other ids with its vector."""
    rows = [(100, [2.0, 1.0])] * 11 + [(300, [2.0, 1.0]), (7, [2.0, 1.0])] + [(400, [0.5, 0.25])] * 9 + [(k, [0.0, float(k)]) for k in range(1, 6)] + [(500, [1.0, -1.0])] * 3
    data = vectors(spark, rows).repartition(3)
    for k in (1, 3, 10):
        got = [tuple(r) for r in topk.topk(data, data.filter("vec_id % 100 = 0"), k=k, n_pivots=3, block_rows=4, queries_per_task=2).collect()]
        want = brute_topk(rows, [(i, list(v)) for i, v in {(i, tuple(v)) for i, v in rows if i % 100 == 0}], k)
        assert set(got) == want and len(got) == len(want)


def test_blocks_are_pruned_without_loss(spark):
    """Far clusters: the bounds rule out blocks, and the results stay the same."""
    rng = random.Random(9)
    centres = [[10.0, 0.0, 0.0], [0.0, 10.0, 0.0], [-10.0, 0.0, 0.0]]
    rows = [(i, [float(round(c + rng.random(), 2)) for c in centres[i % 3]]) for i in range(600)]
    import numpy as np
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    data = vectors(spark, rows)
    got = {tuple(r) for r in topk.topk(data, data.filter("vec_id % 50 = 0"), k=5, n_pivots=8, block_rows=20).collect()}
    assert got == brute_topk(rows, [r for r in rows if r[0] % 50 == 0], 5)


# -------------------------------------------------------------------- HTML

def text_of(page, *beside):
    return html_extract.main_text(html_extract.lines(page), [html_extract.lines(b) for b in beside])[0]


@pytest.mark.parametrize(("page", "text"), [
    ("", ""),
    ("plain words", "plain words"),
    ("<p>A <b>b</b>c</p><p>d&amp;&nbsp;&eacute;&#x41;", "A bc\nd& éA"),
    ("<body><nav>m</nav><article><h1>T</h1><p>one<br>two<p>three\n\n four</article><footer>f</footer>", "T\none two\nthree four"),
    ("<div class='cookie-banner'>c</div><main><p>x</p><aside>s</aside>y<form><input>z</form></main><div id=comments><p>n</p></div>", "x\ny"),
    ("<script>var a='</p><p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut <b", "cut"),
    ("<article>one</article><article>two</article><p>beside</p>", "one\ntwo"),
    ("<div role=main>r</div><div>o</div>", "r"),
    ("<p hidden>h</p><p>v</p>", "v"),
    ("<ul class=menu><li>a</li></ul><table><tr><td>1</td><td>2</td></tr></table>", "1\n2"),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<div><header>h<p>k</p></header>t</div></div></nav><p>u", "t\nu"),
])
def test_page_markup(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<body style='overflow:hidden'><p>a</p></body>", "a"),
    ("<p>see <a href='/posts/hidden-gems'>these gems</a> and <a title=\"the hidden cost\">that</a></p>", "see these gems and that"),
    ("<p data-x='class=ads' data-hidden>a</p><p HIDDEN=''>b</p><p aria-hidden='TRUE'>c</p>", "a"),
    ("<div class='layout with-sidebar'><article>a</article></div>", "a"),
    ("<div class='post has-comments no-header page--sidebar'><p>a</p><div class='left-sidebar'>s</div></div>", "a"),
    ("<form class=search>f<main><p>a</p><nav>n</nav>b</main>g</form>", "a\nb"),
    ("<div class=overlay>o<article><p>a</p></article>p</div><p>q</p>", "a"),
    ("<div class=overlay>o<span role=main>a</span>p</div>", "a"),
    ("<p>a</p><div id=comments><article>c</article></div><aside><article>t</article></aside><div hidden><main>h</main></div>", "a"),
])
def test_attributes_count_by_name_and_articles_outlive_wrappers(page, text):
    assert text_of(page) == text


def test_shared_lines_go_unless_marked_as_article():
    site = "<p>Welcome to the site</p>{}<p>All rights</p>"
    a, b = site.format("<p>Story one</p><p>More</p>"), site.format("<p>Other story</p>")
    assert text_of(a, b) == "Story one\nMore" and text_of(b, a) == "Other story"
    same = "<article><p>A passage that pages share</p><p>{}</p></article>"
    assert text_of(same.format("x"), same.format("y")) == "A passage that pages share\nx"


def test_longest_common_lines_equal_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        used, rest = sorted(html_extract.common_lines(a, b)), iter(b)
        assert len(used) == best[-1][-1] and all(a[i] in rest for i in used)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHING})


def test_extract_edges(spark):
    menu = "<p>Menu of the site</p><p>{}</p><p>Legal notes of it</p>"
    rows = [(1, "http://a.org/x/1?q=1", menu.format("first")), (2, "https://A.org/x/2#top", menu.format("second")), (3, "http://a.org/y", menu.format("third")),
            (4, "http://b.org/x/1", menu.format("alone")), (5, None, menu.format("nowhere")), (6, None, None), (7, "http://c.org/", None), (8, "http://c.org/", ""),
            (None, "http://d.org/1", "<article>n</article>"), (9, "http://e.org/1", "<p>same</p>"), (9, "http://e.org/1", "<p>same</p>")]
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_extract.extract(pages(spark, rows).coalesce(1)).collect())
    whole = "Menu of the site\n{}\nLegal notes of it"
    want = {1: "first", 2: "second", 3: "third", 4: whole.format("alone"), 5: whole.format("nowhere"), None: "n"}
    assert got == sorted((str(i), str(u), t := want.get(i, ""), len(t)) for i, u, _ in rows)
    assert html_extract.extract(pages(spark, [])).collect() == []


def test_pages_at_the_ends_of_ranges_have_their_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{'abcde'[i % 5] if i > 30 else 'big'}.org/{i:03}", f"<p>Menu {rng.choice('xy')}</p><p>page {i}</p><p>Legal notes</p>") for i in range(60)]
    rows += [(100 + i, None, "<p>Menu x</p>") for i in range(3)]
    table = pages(spark, rows)
    want = sorted(map(str, html_extract.extract(table.coalesce(1)).collect()))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = html_extract.extract(table.repartition(4)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(str, got)) == want and not any("Legal" in r.text for r in got if r.url)


def test_extract_of_the_given_pages(spark):
    import html
    import re

    def article(page):
        a, z = page.find("<article>") + 9, page.find("</article>")
        blocks = re.split(r"</?(?:p|h1)>", page[a:z])
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        return "\n".join(b for b in blocks if b)

    table = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in table.collect() if "</article>" in r.html}
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    assert len(want) > 200 and {k: got[k] for k in want} == want


# ---------------------------------------------------------------- language

@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 0")
    return language_id.fit(docs, per_language=80)


def test_held_out_accuracy_of_the_text_alone(spark, model):
    held_out = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 1")
    rows = language_id.identify(held_out, model).join(held_out.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(rows) == held_out.count() and sum(r.lang == r.truth for r in rows) >= 0.97 * len(rows)


def test_evidence_decides_what_the_text_leaves_open(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("").alias("decl"), F.concat("lang", F.lit(".example."), "lang").alias("h"))
    open_ = spark.createDataFrame([(-1, "A.", "", "fr.example.fr"), (-2, "A.", "", "de.example.de"), (-3, "A.", "", "new.example.es")], docs.schema)
    got = {r.doc_id: r.lang for r in language_id.identify(docs.union(open_), model, declared_col="decl", host_col="h").collect()}
    assert (got[-1], got[-2], got[-3]) == ("fr", "de", "es")  # host, host, parent domain and suffix of an unseen host


def test_language_edges(spark, model):
    rows = [*EDGE, (20, "%%% ### 123"), (21, "ааа ббб ввв ггг ддд еее жжж ззз иии ккк ллл ммм")]
    docs = frame(spark, rows)
    got = language_id.identify(docs, model, declared_col="lang", host_col="source").collect()
    assert len(got) == len(rows) and all(0 < r.posterior <= 1 + 1e-9 for r in got)
    rejected = {r.doc_id for r in got if not r.accepted}
    assert {1, 2, 3, 11, 20, 21} <= rejected and not {4, 5} & rejected
    assert language_id.identify(frame(spark, []), model).collect() == []
    languages, table = language_id.fit(frame(spark, []))
    assert languages == [] and table.shape[1] == 1
    assert {r.lang for r in language_id.identify(docs, (languages, table)).collect()} == {"und"}


def test_every_label_is_modelled(spark):
    rng = random.Random(3)
    rows = []
    for l in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(40)), f"l{l:02}") for i in range(3 if l < 6 else 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).coalesce(4)
    languages, table = language_id.fit(docs)
    assert languages == sorted({r[2] for r in rows}) and table.shape == (language_id.CELLS, 71)
    got = {r.doc_id: r for r in language_id.identify(docs, (languages, table), declared_col="lang", host_col="source", suffix=False).collect()}
    assert all(got[i].lang == l and got[i].accepted for i, _, l in rows)


def test_page_evidence(spark):
    rows = [(1, "https://blog.x.example.FR:80/fr/1", "<!DOCTYPE html><HTML class=a lang='fr-CA'>"), (2, None, None), (3, "x.org", "<p>")]
    got = [(r["__declared"], r["__host"]) for r in language_id.page_evidence(pages(spark, rows)).collect()]
    assert got == [("fr", "blog.x.example.fr"), ("", ""), ("", "x.org")]
