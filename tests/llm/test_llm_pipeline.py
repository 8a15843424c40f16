"""The pipeline against its stages in plain Python, and the driver contract."""

import sys
from pathlib import Path

import pytest
from llm_brute import EDGE, cut, frame, lower, near
from test_llm_tokens import check_pieces

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from hatefold.llm.common import released, worker_cache, written  # noqa: E402

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        out.append((name, docs))
    return out


def brute(rows):
    """What exact, near and passage dedup leave of (doc_id, text) rows."""
    best = {}
    for i, t in rows:
        best[lower(t)] = max(best.get(lower(t), i), i)
    rows = [(i, t) for i, t in rows if best[lower(t)] == i]
    part = near(rows, 5, 80)
    rows = [(i, t) for i, t in rows if part[i] == i]
    return rows, {i: k.decode("utf-8", "ignore") for (i, t), (k, _) in zip(rows, cut(rows)) if k or not t}


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, known), (_, distinct), (_, single), (_, clean), (_, pieces) = stages(spark, docs)
    assert all(x.columns == docs.columns for x in (known, distinct, single, clean))
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert {i for i, _ in rows} == {r.doc_id for r in docs.collect()}  # all of these documents are clean prose
    left, texts = brute(rows)
    assert {r.doc_id for r in single.collect()} == {i for i, _ in left}
    got = clean.collect()
    assert {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got)
    check_pieces(pieces.collect(), texts)
    check_pieces(corpus_pipeline.run(spark, SF).collect(), texts)


def test_stages_survive_edge_rows(spark):
    *_, (_, pieces) = stages(spark, frame(spark, EDGE))
    assert pieces.count() > 0
    *_, (_, pieces) = stages(spark, frame(spark, []))
    assert pieces.count() == 0


def test_registered_names():
    import __spark_entry__ as E

    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "suffix_dedup", "packing"]


@pytest.mark.parametrize("name", ["op9_exact_dedup", "op7_voronoi_topk"])
def test_sql_twins(spark, name):
    import duckdb

    import __spark_entry__ as E

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    sql = E.oracle_sql()[name]
    assert {tuple(r) for r in df.collect()} == set(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())


def test_tasks_drop_what_other_operators_cached(monkeypatch):
    import pyspark

    monkeypatch.setitem(vars(pyspark), "_hatefold_worker_cache", {})
    first = {k: worker_cache(k, object) for k in ("powers", "words:a", "words:b")}
    assert list(released(iter, "words:a")([1, 2])) == [1, 2]
    assert worker_cache("powers", object) is first["powers"] and worker_cache("words:a", object) is first["words:a"]
    assert worker_cache("words:b", object) is not first["words:b"]


def test_tasks_give_unused_memory_back():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    pins = []

    def run(batches):
        held = [bytes(3000) for _ in range(40_000)]
        pins.append([bytes(3000) for _ in range(100)])  # lies behind, so that the C library alone frees nothing
        yield from batches
        pins.append(resident())
        del held

    assert list(released(run)([1])) == [1]
    assert pins[-1] - resident() > 60_000_000
