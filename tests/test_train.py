import numpy as np
import pytest

from hatefold.operators import train as TR
from hatefold.operators.train import head_gradients


def _check(lambda_hier, weighted):
    rng = np.random.default_rng(0)
    n = 5
    zc, zf = rng.normal(size=(n, 3)), rng.normal(size=(n, 8))
    y = rng.integers(0, 3, size=n)
    Y = rng.integers(0, 2, size=(n, 8)).astype(float)
    cw = np.array([0.5, 1.5, 2.0]) if weighted else np.ones(3)
    pw = rng.uniform(0.5, 3, size=8) if weighted else np.ones(8)
    w_total = cw[y].sum()
    f = lambda a, b: head_gradients(a, b, y, Y, cw, pw, n, w_total, 1.0, lambda_hier)[0]
    _, g = head_gradients(zc, zf, y, Y, cw, pw, n, w_total, 1.0, lambda_hier)
    eps = 1e-6
    num = np.zeros_like(g)
    for i in range(n):
        for k in range(11):
            a, b = zc.copy(), zf.copy()
            if k < 3:
                a[i, k] += eps
            else:
                b[i, k - 3] += eps
            num[i, k] = (f(a, b) - f(zc, zf)) / eps
    assert np.max(np.abs(num - g)) < 1e-4


def test_flat_gradient_finite_differences():
    _check(0.0, True)


def test_hier_gradient_finite_differences():
    _check(1.0, False)


def test_fit_with_validation_keeps_first_best_epoch(spark):
    from hatefold.operators import features as FE
    rows = [(i, ("trash " if i % 2 else "") + f"word{i % 5}", (i % 2) * 2, [i % 2] + [0] * 7) for i in range(40)]
    df = FE.hashed_features(spark.createDataFrame(rows, "doc_id long, text string, y_coarse int, y_fine array<int>"),
                            dim=128)
    m = TR.fit_two_head(df, dim=128, iterations=30, valid=df, steps_per_epoch=3,
                        patience=2, checkpoint=False)
    fine = [(e, v) for e, h, k, v in m.records if (h, k) == ("fine", "macro_f1")]
    assert len(m.records) == 15 * len(fine)  # 8 coarse and 7 fine metrics an epoch
    best = max(v for _, v in fine)
    assert m.best_epoch == min(e for e, v in fine if v == best)
    # stopped by patience or ran to the end
    last = fine[-1][0]
    assert m.stop_epoch == last
    after = [v for e, v in fine if e > m.best_epoch]
    assert len(after) <= 2


def test_solver_ends_at_the_minimum():
    rng = np.random.default_rng(3)
    A = rng.normal(size=(40, 12)) * np.logspace(-1, 0.5, 12)
    b = rng.normal(size=40)
    s = TR.Lbfgs(np.zeros(12), 1e-6)
    for _ in range(2000):
        if s.done:
            break
        r = A @ s.trial - b
        s.tell(float(r @ r), 2 * A.T @ r)
    assert s.done and s.trace[-1][1] <= 1e-6 * s.trace[0][1]
    assert np.allclose(A @ s.x, A @ np.linalg.lstsq(A, b, rcond=None)[0], atol=1e-3)
    assert all(y[0] < x[0] for x, y in zip(s.trace, s.trace[1:]))


def test_solver_gives_up_when_nothing_falls():
    s = TR.Lbfgs(np.ones(2), 1e-9)
    for _ in range(100):
        if s.done:
            break
        s.tell(1.0, np.ones(2))  # a gradient that lies
    assert s.done and len(s.trace) == 1


def _toy(spark, dim, n=90):
    from hatefold.operators import features as FE
    rows = [(i, ("trash " if i % 3 else "nice ") * (1 + i % 4) + f"word{i % 7}", i % 3, [int(i % 3 == 2)] + [int(i % 2)] * 7) for i in range(n)]
    return FE.hashed_features(spark.createDataFrame(rows, "doc_id long, text string, y_coarse int, y_fine array<int>"), dim=dim)


def test_models_of_one_batch_equal_separate_fits(spark):
    df = _toy(spark, 64)
    both = TR.fit_two_heads(df, [TR.FLAT, TR.HIERARCHICAL], dim=64, tol=1e-2)
    for model, objective in zip(both, (TR.FLAT, TR.HIERARCHICAL)):
        alone = TR.fit_two_heads(df, [objective], dim=64, tol=1e-2)[0]
        assert np.allclose(model.weights, alone.weights, atol=1e-6)
        loss, norm = [v for _, v in model.history], model.gradient_norms
        assert norm[-1] <= 1e-2 * norm[0] and all(b < a for a, b in zip(loss, loss[1:]))


def test_dense_and_sparse_blocks_agree(spark, monkeypatch):
    df = _toy(spark, 64)
    dense = TR.fit_two_head(df, 64, iterations=5)
    monkeypatch.setattr(TR, "BLOCK_BYTES", 4 * 64 * 7)  # many blocks
    assert np.allclose(TR.fit_two_head(df, 64, iterations=5).weights, dense.weights, atol=1e-8)
    wide = _toy(spark, 1 << 12)  # few of 4096 columns: sparse
    blocks = TR._packed_blocks(wide.select("features", wide.y_coarse.alias("y"), wide.y_fine.alias("yf")), "features", 1 << 12).collect()
    assert not any(b.dense for b in blocks) and sum(b.n for b in blocks) == 90
    assert TR._packed_blocks(df.select("features", df.y_coarse.alias("y"), df.y_fine.alias("yf")), "features", 64).first().dense


def test_empty_training_set(spark):
    m = TR.fit_two_head(_toy(spark, 64).limit(0), 64)
    assert not m.weights.any() and m.history == []


def test_unconverged_fit_raises(spark, monkeypatch):
    monkeypatch.setattr(TR, "MAX_STEPS", 2)
    with pytest.raises(RuntimeError, match="no convergence"):
        TR.fit_two_head(_toy(spark, 64), 64, tol=1e-12)


def test_baselines_fit_down_to_the_tight_tolerances():
    import inspect

    from hatefold.operators.train import fit_baseline, sweep_baseline
    from hatefold.plans.q_models import SWEEP

    assert inspect.signature(fit_baseline).parameters["tol"].default == 1e-6
    assert inspect.signature(sweep_baseline).parameters["tols"].default == (1e-4, 1e-6)
    assert all(min(tols) == 1e-6 and max(tols) <= 1e-4 for *_, tols in SWEEP) and sum(len(r) * len(t) for *_, r, t in SWEEP) == 19


def test_epoch_records_equal_the_metrics_of_the_scored_rows(spark):
    """The packed valid rows give what score_two_head and evaluate_two_head give, without a query per epoch."""
    from pyspark.sql import functions as F

    from hatefold.operators import features as FE
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["aa", "bcd", "trash", "x", "yz"], 4)), int(rng.integers(0, 3)), [int(v) for v in rng.integers(0, 2, 8)]) for i in range(90)]
    df = FE.hashed_features(spark.createDataFrame(rows, "doc_id long, text string, y_coarse int, y_fine array<int>"), dim=64).repartition(3)
    valid = df.withColumn("y_coarse", F.expr("if(doc_id % 7 = 0, null, y_coarse)"))
    fit = lambda v: TR.fit_two_head(df, dim=64, iterations=4, valid=v, steps_per_epoch=4, checkpoint=False)
    m = fit(valid)
    want = {(r["head"], r["metric"]): r["value"] for r in TR.evaluate_two_head(TR.score_two_head(
        valid, TR.TwoHeadModel(m.weights, 64, False, []), keep=("doc_id", "y_coarse", "y_fine"))).collect()}
    got = {(h, k): v for e, h, k, v in m.records if e == 1}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert all(v is None for *_, k, v in fit(df.where("doc_id < 0")).records if k != "macro_f1")


def _labelled(spark, n=120):
    from hatefold.operators import features as FE
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "trash", "x", "yz", "cab"], 5)), int(rng.integers(0, 3)), "main" if i % 2 else "aux") for i in range(n)]
    return FE.hashed_features(spark.createDataFrame(rows, "row_key long, text string, labels int, source string"), dim=64).repartition(3)


def test_baselines_of_one_batch_equal_mllib(spark):
    """Several settings and row sets share the scans of the rows; each ends at MLlib's optimum."""
    from pyspark.ml.classification import LogisticRegression
    df = _labelled(spark).persist()
    fits = [(0.01, 1e-4, None), (0.01, 1e-8, None), (0.1, 1e-8, "source = 'main'")]
    for (reg, tol, rows), got in zip(fits, TR.fit_baselines(df, fits)):
        want = LogisticRegression(family="multinomial", labelCol="labels", regParam=reg, tol=1e-12, maxIter=2000).fit(df.where(rows or "true"))
        atol = 1e-2 if tol > 1e-6 else 1e-4
        assert np.allclose(got.weights, want.coefficientMatrix.toArray(), atol=atol)
        assert np.allclose(got.intercepts, want.interceptVector.toArray(), atol=10 * atol)
        if tol < 1e-6 and rows is None:
            scores = {r["row_key"]: r["logits"] for r in TR.baseline_logits(got, df, keep=("row_key",), n_classes=5).collect()}
            plain = {r["row_key"]: r["rawPrediction"].toArray() for r in want.transform(df).collect()}
            assert all(np.allclose(v[:3], plain[k], atol=1e-2) and v[3:] == [-np.inf] * 2 for k, v in scores.items())


def test_baseline_of_one_class_is_certain_and_no_rows_raise(spark):
    df = _labelled(spark, 20)
    model = TR.fit_baseline(df.where("labels = 1"), reg_param=0.01)
    assert model.intercepts.tolist() == [0.0, np.inf] and not model.weights.any()
    with pytest.raises(ValueError, match="no rows"):
        TR.fit_baseline(df.where("labels > 9"))


def test_trust_region_ends_at_the_minimum_or_gives_up():
    rng = np.random.default_rng(3)
    A, b = rng.normal(size=(40, 12)) * np.logspace(-2, 1, 12), rng.normal(size=40)

    def run(dialogue, answer):
        asked, n = next(dialogue), 0
        while True:
            n += 1
            try:
                asked = dialogue.send(answer(*asked))
            except StopIteration as end:
                return end.value, n

    def squares(x, v):
        return 2 * A.T @ (A @ v) if v is not None else (float(((A @ x - b) ** 2).sum()), 2 * A.T @ (A @ x - b))
    found, n = run(TR.trust_region(np.zeros(12), [1e-2, 1e-8]), squares)
    assert np.allclose(A @ found[1e-8], A @ np.linalg.lstsq(A, b, rcond=None)[0], atol=1e-5) and n < 400
    norm = lambda x: np.linalg.norm(squares(x, None)[1])
    assert norm(found[1e-8]) < norm(found[1e-2]) <= 1e-2 * norm(np.zeros(12))
    found, _ = run(TR.trust_region(np.zeros(2), [1e-9]), lambda x, v: v if v is not None else (1.0, np.ones(2)))  # a gradient that lies
    assert not found[1e-9].any()


def test_packed_blocks_give_the_products_of_the_vectors(spark):
    """Frequent and rare columns, wide steps, large, fractional and negative values, dense vectors and empty rows."""
    from pyspark.ml.linalg import DenseVector, SparseVector
    rng = np.random.default_rng(6)
    M = np.where(rng.random((60, 2000)) < np.where(np.arange(2000) % 5 == 0, 0.6, 0.01), rng.integers(1, 9, (60, 2000)), 0).astype(float)
    M[:, 300:900] = 0
    M[0, 950], M[1, 1000], M[2, 5], M[3, 7] = 300, 70000, 0.25, -2
    M[4] = 0
    vectors = [DenseVector(m) if i % 9 == 1 else SparseVector(2000, np.flatnonzero(m).tolist(), m[m != 0].tolist()) for i, m in enumerate(M)]
    df = spark.createDataFrame([(v, i % 3, [i % 2] * 8) for i, v in enumerate(vectors)], ["features", "y", "yf"]).coalesce(1)
    W = rng.normal(size=(11, 2001))
    packed = [tuple(r) for r in TR._packed_blocks(df, "features", 2000).collect()]
    assert sum(len(x) for r in packed for x in r if isinstance(x, (bytes, bytearray))) < 8 * (M != 0).sum()
    for scaled in (True, False):
        X = M / np.sqrt(np.maximum(M.sum(axis=1), 1.0))[:, None] if scaled else M
        Z, G, at = [], np.zeros((11, 2001)), 0
        dZ = rng.normal(size=(60, 11))
        for block, y, Y in TR._unpacked(packed, 2000, scaled):
            assert len(block.cols) and len(block.idx) and Y.shape == (block.n, 8) and y[:3].tolist() == [0, 1, 2]
            Z.append(block.outputs(W))
            G, at = G + block.gradient(dZ[at:at + block.n]), at + block.n
        assert np.allclose(np.concatenate(Z), X @ W[:, :-1].T + W[:, -1])
        assert np.allclose(G[:, :-1], dZ.T @ X) and np.allclose(G[:, -1], dZ.sum(axis=0))


def test_an_evaluation_has_one_task_per_core(spark):
    """A Python task has a fixed cost, so many small partitions are dealt to one per core."""
    df = _toy(spark, 64).repartition(5 * spark.sparkContext.defaultParallelism)
    blocks = TR._kept_blocks(df.select("features", df.y_coarse.alias("y"), df.y_fine.alias("yf")), "features", 64, False, 90)
    assert blocks.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sum(r[0] for r in blocks.collect()) == 90
