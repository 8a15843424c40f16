"""Registered queries: features, encoding, distributed fits, scoring, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as AU
from ..operators import features as FE
from ..operators import history as H
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import score as S
from ..operators import split as SP
from ..operators import train as TR
from ..operators import lexicon as LX
from . import bindings as B
from . import fixed_values as FV
from .oracle_views import with_views
from .q_corpus import _combined, split_by_document

QUERIES = {}
ORACLE = {}
SEED = 42
DIM = 1 << 12


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _two_head_input(df):
    """posts -> (doc_id, features, y_coarse, y_fine)."""
    f = FE.hashed_features(df, dim=DIM)
    return f.select("doc_id", "features", L.coarse_encode(F.col("hate_label")).alias("y_coarse"),
                    L.pack_fine().alias("y_fine"), *[c for c in ("split", "origin") if c in df.columns])


def _spread(df, n_rows: int):
    """``df`` over as many tasks as the fit will use: a table in one file is one task,
    which would make the features of all rows."""
    target = min(df.sparkSession.sparkContext.defaultParallelism, max(1, n_rows // TR.ROWS_PER_TASK))
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def _materialised(df, name):
    """Written once in the shared folder: split and features are not evaluated again
    by the fit, the validation and the scoring."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- M1

@register("text_features", with_views("posts") + """
SELECT doc_id, CAST(greatest(length(text) - 1, 0) + greatest(length(text) - 2, 0) AS INTEGER) AS n_grams FROM posts
""")
def text_features(spark, sf_dir):
    posts = B.posts(spark, sf_dir)
    return posts.select("doc_id", F.size(FE.char_ngrams(F.col("text"))).alias("n_grams"))


# ---------------------------------------------------------------- F11

_ENCODE_SQL = with_views("posts") + """,
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS ts FROM posts),
terms AS (SELECT t AS term, count(*) AS freq FROM (SELECT unnest(ts) AS t FROM toks) GROUP BY 1),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY freq DESC, term) + 1 AS INTEGER) AS token_id
          FROM terms),
pos AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM toks),
ids AS (SELECT p.doc_id, list(coalesce(v.token_id, 1) ORDER BY p.pos) AS ids
        FROM pos p LEFT JOIN vocab v ON p.term = v.term WHERE p.pos < 128 GROUP BY p.doc_id),
enc AS (SELECT t.doc_id, coalesce(i.ids, CAST([] AS INTEGER[])) AS ids FROM toks t LEFT JOIN ids i ON t.doc_id = i.doc_id)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)), ',') AS input_ids,
  CAST(len(ids) AS INTEGER) AS n_attended
FROM enc
"""


@register("encoded_text", _ENCODE_SQL)
def encoded_text(spark, sf_dir):
    posts = B.posts(spark, sf_dir)
    vocab = FE.term_vocabulary(LX.mine_terms(posts))
    enc = FE.encode_text(posts, vocab)
    return enc.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"))


@register("vocabulary_ids", with_views("posts") + """,
terms AS (SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM posts) GROUP BY 1)
SELECT term, CAST(row_number() OVER (ORDER BY freq DESC, term) + 1 AS INTEGER) AS token_id FROM terms
""")
def vocabulary_ids(spark, sf_dir):
    """every term of the posts with its id, by a distributed ranking."""
    return FE.term_vocabulary(LX.mine_terms(B.posts(spark, sf_dir)))


# ---------------------------------------------------------------- M2 / M3 / M6

OBJECTIVES = {"flat": TR.FLAT, "hierarchical": TR.HIERARCHICAL}


def _two_head_data(spark, sf_dir, augment: bool = False):
    posts = B.posts(spark, sf_dir)
    if augment:
        ts = AU.build_training_set(posts, B.lexicon(spark), seed=SEED)
    else:
        ts = SP.stratified_split(posts, "hate_label", "doc_id", seed=SEED)
    return _materialised(_two_head_input(_spread(ts, posts.count())), "features")


def _part(data, split):
    rows = data.where(F.col("split") == split)
    return rows.where(F.col("origin") == "original") if split != "train" and "origin" in data.columns else rows


def fitted(data, *names):
    """The named models, fitted on train in one batch; the best epoch on valid is kept."""
    return TR.fit_two_heads(_part(data, "train"), [OBJECTIVES[n] for n in names], dim=DIM, valid=_part(data, "valid"))


def _evaluated(data, model, split):
    return TR.evaluate_two_head(TR.score_two_head(_part(data, split), model, keep=("doc_id", "y_coarse", "y_fine")))


@register("two_head_flat")
def two_head_flat(spark, sf_dir):
    """M2 + M6: flat two-head fit on train, metrics of the best epoch on valid."""
    data = _two_head_data(spark, sf_dir)
    return B.rounded(_evaluated(data, fitted(data, "flat")[0], "valid"))


@register("two_head_hierarchical")
def two_head_hierarchical(spark, sf_dir):
    """M3 + M6: hierarchical objective (consistency penalty), metrics on valid."""
    data = _two_head_data(spark, sf_dir)
    return B.rounded(_evaluated(data, fitted(data, "hierarchical")[0], "valid"))


_Q = 0.5 ** TR.N_FINE


@register("two_head_convergence", with_views("posts") + f""",
t AS (SELECT {', '.join(FV.FINE_COLS)} FROM {SP.split_oracle_sql("posts", "hate_label", "doc_id", FV.THREE_WAY_RATIOS, FV.SPLIT_NAMES_3)} WHERE split = 'train'),
n AS (SELECT count(*) AS n FROM t),
pos AS (SELECT sum(y) AS p, count(*) AS n FROM (SELECT unnest(['{"', '".join(FV.FINE_COLS)}']) AS col, unnest([{', '.join(FV.FINE_COLS)}]) AS y FROM t) GROUP BY col),
bce AS (SELECT sum((n - p) / (p + 1e-6) * p + n - p) * ln(2) / (max(n) * {TR.N_FINE}) AS flat FROM pos)
SELECT model, n AS n_rows, round(ln(3) + CASE WHEN model = 'flat' THEN flat ELSE ln(2) + (1 - {_Q}) / 3 + 2 * {_Q} / 3 END, 5) AS loss_first,
  true AS falls_at_every_step, true AS below_a_tenth, true AS gradient_small
FROM n, bce, (VALUES ('flat'), ('hierarchical')) m(model)
""")
def two_head_convergence(spark, sf_dir):
    """M2 / M3 over the train part, both models in one batch, down to the gradient
    tolerance: the loss at zero weights, that it falls at every step to a tenth or
    less, and that the gradient's norm falls to a thousandth."""
    train = _part(_two_head_data(spark, sf_dir), "train")
    models = TR.fit_two_heads(train, list(OBJECTIVES.values()), dim=DIM, tol=1e-3)
    n, rows = train.count(), []
    for name, m in zip(OBJECTIVES, models):
        loss, norm = [v for _, v in m.history], m.gradient_norms
        rows.append((name, n, round(loss[0], 5), all(b < a for a, b in zip(loss, loss[1:])), loss[-1] < loss[0] / 10, norm[-1] <= 1e-3 * norm[0]))
    return spark.createDataFrame(rows, "model string, n_rows long, loss_first double, falls_at_every_step boolean, below_a_tenth boolean, gradient_small boolean")


@register("experiment_matrix")
def experiment_matrix(spark, sf_dir):
    """M9: flat / hierarchical x without / with train-only augmentation, test split;
    the two models over the same rows are fitted together."""
    out = None
    for aug in (False, True):
        data = _two_head_data(spark, sf_dir, aug)
        for name, model in zip(OBJECTIVES, fitted(data, *OBJECTIVES)):
            m = _evaluated(data, model, "test").select(F.lit(name).alias("model"), F.lit(aug).alias("augmented"), "head", "metric", "value")
            out = m if out is None else out.unionByName(m)
    return out


@register("batch_scoring")
def batch_scoring(spark, sf_dir):
    """M7: score every post with a fitted flat model; two-head result record."""
    data = _two_head_data(spark, sf_dir)
    scored = TR.score_two_head(data, fitted(data, "flat")[0], keep=("doc_id",))
    rec = S.two_head_record(scored, keep=("doc_id",))
    return rec.select("doc_id", "coarse_pred", F.round("coarse_confidence", 6).alias("coarse_confidence"),
                      F.array_join("fine_pred", "|").alias("fine_pred"))


# ---------------------------------------------------------------- M4 / M5 / M10 (baseline)

def _baseline_frames(spark, sf_dir, mode: str = "combined", sizes=(2, 3), dim: int = DIM):
    # By document, so that no text of a held-out row is in train.
    split = split_by_document(_combined(spark, sf_dir), seed=SEED).select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("row_key"), "source", "labels", "text", "split")
    feats, _ = FE.mllib_features(_spread(split, split.count()), dim=dim, sizes=sizes)
    feats = _materialised(feats.drop("text"), "features")
    train = L.training_source(feats.where(F.col("split") == "train"), mode)
    valid = feats.where(F.col("split") == "valid")
    return train, valid


@register("baseline_classifier")
def baseline_classifier(spark, sf_dir):
    """M4 + A16: multinomial logistic regression on the combined corpus."""
    train, valid = _baseline_frames(spark, sf_dir)
    model = TR.fit_baseline(train, reg_param=1e-3)
    lg = TR.baseline_logits(model, valid, n_classes=len(B.AUX_ID2LABEL))
    return B.rounded(M.single_label_metrics(lg, y_col="labels", n_classes=len(B.AUX_ID2LABEL)))


#: 19 runs: four feature sets in place of four encoders, with 6, 1, 6 and 6 settings
#: (regularisation in place of learning rate, tolerance in place of epochs).
SWEEP = [("2-3-grams", (2, 3), DIM, (0.001, 0.01, 0.1), (1e-4, 1e-6)), ("2-grams", (2,), DIM, (0.01,), (1e-6,)),
         ("3-grams", (3,), DIM, (0.001, 0.01, 0.1), (1e-4, 1e-6)), ("2-3-grams, narrow", (2, 3), DIM // 4, (0.001, 0.01, 0.1), (1e-4, 1e-6))]


@register("hyperparameter_sweep")
def hyperparameter_sweep(spark, sf_dir):
    """M5 + W3: one metrics row per grid point, best run by LRAP flagged."""
    from concurrent.futures import ThreadPoolExecutor
    n_cls = len(B.AUX_ID2LABEL)

    def scored(setting):
        name, sizes, dim, regs, tols = setting
        train, valid = _baseline_frames(spark, sf_dir, sizes=sizes, dim=dim)
        return name, TR.sweep_baseline(train, valid, regs, tols, n_classes=n_cls)

    # The scans of a fit are short jobs, one after the other: the feature sets go side by side.
    with ThreadPoolExecutor(len(SWEEP)) as pool:
        swept = list(pool.map(scored, SWEEP))
    rows, run = None, 0
    for name, fits in swept:
        for params, lg in fits:
            m = M.single_label_metrics(lg, y_col="labels", n_classes=n_cls)
            m = B.rounded(m).select(F.lit(run).alias("run_id"), F.lit(name).alias("features"), F.lit(float(params["regParam"])).alias("reg_param"),
                                    F.lit(float(params["tol"])).alias("tol"), F.lit("combined").alias("corpus"),
                                    "accuracy", "macro_f1", "lrap")
            rows, run = (m if rows is None else rows.unionByName(m)), run + 1
    rows = _materialised(rows, "sweep")
    best = H.best_run(rows, "corpus", "run_id", "lrap").select("corpus", "best_run")
    return rows.join(best, "corpus").select(
        "run_id", "features", "reg_param", "tol", "accuracy", "macro_f1", "lrap",
        (F.col("run_id") == F.col("best_run")).alias("is_best"))


@register("data_ablation")
def data_ablation(spark, sf_dir):
    """M10 + IO11 + J3: main-only vs combined training, compared on the same
    held-out rows."""
    names = [B.AUX_ID2LABEL[i] for i in range(len(B.AUX_ID2LABEL))]
    train_c, valid = _baseline_frames(spark, sf_dir, "combined")
    main_only = "source IN ('" + "', '".join(L.TRAINING_MODES["main_only"]) + "')"
    out = []
    for model in TR.fit_baselines(train_c, [(1e-3, 1e-6, main_only), (1e-3, 1e-6, None)]):
        lg = TR.baseline_logits(model, valid, keep=("row_key",), n_classes=len(names)).withColumnRenamed(
            "row_key", "id")
        out.append(S.suspect(lg, names, FV.BASELINE_THRESHOLD))
    cmp_ = S.compare_predictions(out[0], out[1], on="id")
    return cmp_.select("id", "pred_a", "pred_b", "agree", F.array_join("only_a", "|").alias("only_a"),
                       F.array_join("only_b", "|").alias("only_b"))


# ---------------------------------------------------------------- M2 + M6 + W1 + W2 + IO9 + IO10

@register("training_history")
def training_history(spark, sf_dir):
    """The original training loop as a job: flat two-head fit with per-epoch
    validation (M6), early stopping on fine macro F1 with patience (W1, W2),
    epoch records appended to a metrics table partitioned by run (IO9), and
    the test metrics of the best weights appended as split 'test' (IO10)."""
    from ..session import scratch_path
    data = _two_head_data(spark, sf_dir)
    model = fitted(data, "flat")[0]
    path = scratch_path(spark, "train-history")
    rec = spark.createDataFrame([("flat", e, "valid", h, m, float(v) if v is not None else None)
                                 for e, h, m, v in model.records],
                                "run_id string, epoch int, split string, head string, metric string, value double")
    H.append_metrics(rec, path)
    test = TR.evaluate_two_head(TR.score_two_head(data.where(F.col("split") == "test"), model,
                                                  keep=("y_coarse", "y_fine")))
    H.append_metrics(test.select(F.lit("flat").alias("run_id"), F.lit(model.best_epoch).cast("int").alias("epoch"),
                                 F.lit("test").alias("split"), "head", "metric", "value"), path)
    out = spark.read.parquet(path)
    return out.select("run_id", "epoch", "split", "head", "metric", "value",
                      (F.col("epoch") == F.lit(model.best_epoch)).alias("is_best_epoch"),
                      F.lit(model.stop_epoch).cast("int").alias("stop_epoch"))
