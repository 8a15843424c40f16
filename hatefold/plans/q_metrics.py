"""Registered queries: scoring record, metric bundles, losses, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import score as S
from . import bindings as B
from . import fixed_values as FV
from .oracle_views import with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _softmax_sql(z: str) -> str:
    return (f"list_transform({z}, lambda x: exp(x - list_max({z})) / "
            f"list_sum(list_transform({z}, lambda v: exp(v - list_max({z})))))")


def _sigmoid_sql(z: str) -> str:
    return f"list_transform({z}, lambda x: 1.0 / (1.0 + exp(-x)))"


def _lrap_sql(y: str, s: str) -> str:
    rng = f"range(1, len({s}) + 1)"
    n_true = f"list_sum({y})"
    body = (f"list_sum(list_transform({rng}, lambda j: CASE WHEN {y}[j] = 1 THEN "
            f"len(list_filter({rng}, lambda k: {y}[k] = 1 AND {s}[k] >= {s}[j]))::DOUBLE / "
            f"len(list_filter({rng}, lambda k: {s}[k] >= {s}[j])) ELSE 0.0 END))")
    return (f"(CASE WHEN {n_true} = 0 OR {n_true} = len({s}) THEN 1.0 "
            f"ELSE {body} / {n_true} END)")


def _single_label_sql(rows_cte: str, cols: list[str]) -> str:
    """rows_cte has y, pred, lrap."""
    sel = {
        "accuracy": "round(sum(tp) / (sum(tp) + sum(fn)), 6) AS accuracy",
        "micro_f1": "round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1",
        "macro_f1": "round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1",
        "lrap": f"(SELECT round(avg(lrap), 6) FROM {rows_cte}) AS lrap",
    }
    return f""",
conf AS (SELECT y, pred, count(*) AS n FROM {rows_cte} GROUP BY 1, 2),
pc AS (
  SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT y AS cls, CASE WHEN y = pred THEN n ELSE 0 END AS tp, 0 AS fp,
           CASE WHEN y <> pred THEN n ELSE 0 END AS fn FROM conf
    UNION ALL SELECT pred, 0, n, 0 FROM conf WHERE y <> pred) GROUP BY cls)
SELECT {", ".join(sel[c] for c in cols)} FROM pc
"""


# ---------------------------------------------------------------- A6/A7/A13/A14

_COARSE_SQL = with_views("scored") + f""",
p AS (SELECT y_coarse AS y, {_softmax_sql('logits_coarse')} AS p FROM scored),
r AS (SELECT y, list_position(p, list_max(p)) - 1 AS pred,
         {_lrap_sql('list_transform(range(0, 3), lambda i: CAST(i = y AS INTEGER))', 'p')} AS lrap FROM p)
""" + _single_label_sql("r", ["accuracy", "micro_f1", "macro_f1", "lrap"])


@register("coarse_metrics", _COARSE_SQL)
def coarse_metrics(spark, sf_dir):
    return B.rounded(M.coarse_metrics(B.scored(spark, sf_dir)))


# ---------------------------------------------------------------- A8

_CONF_SQL = with_views("scored") + f"""
SELECT CAST(y_coarse AS INTEGER) AS y,
  CAST(list_position({_softmax_sql('logits_coarse')}, list_max({_softmax_sql('logits_coarse')})) - 1 AS INTEGER) AS pred,
  count(*) AS n
FROM scored GROUP BY 1, 2
"""


@register("confusion_matrix", _CONF_SQL)
def confusion_matrix(spark, sf_dir):
    from ..functions.scores import argmax, softmax
    sc = B.scored(spark, sf_dir)
    return M.confusion(sc, "y_coarse", argmax(softmax("logits_coarse")))


# ---------------------------------------------------------------- A16

_SINGLE_SQL = with_views("logits10") + f""",
r AS (SELECT y, list_position(logits, list_max(logits)) - 1 AS pred,
         {_lrap_sql('list_transform(range(0, 10), lambda i: CAST(i = y AS INTEGER))', 'logits')} AS lrap
      FROM logits10)
""" + _single_label_sql("r", ["accuracy", "macro_f1", "lrap"])


@register("baseline_metrics", _SINGLE_SQL)
def baseline_metrics(spark, sf_dir):
    return B.rounded(M.single_label_metrics(B.logits10(spark, sf_dir)))


# ---------------------------------------------------------------- A9-A13, A15

def _fine_sql(view: str, threshold: float = 0.5) -> str:
    sums = []
    for j in range(1, 9):
        sums.append(f"sum(y[{j}] * b[{j}]) AS tp{j}, sum((1 - y[{j}]) * b[{j}]) AS fp{j}, "
                    f"sum(y[{j}] * (1 - b[{j}])) AS fn{j}")
    tp = " + ".join(f"tp{j}" for j in range(1, 9))
    fp = " + ".join(f"fp{j}" for j in range(1, 9))
    fn = " + ".join(f"fn{j}" for j in range(1, 9))

    def d0(num, den):
        return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num}) / ({den}) END)"
    f1 = " + ".join(d0(f"2 * tp{j}", f"2 * tp{j} + fp{j} + fn{j}") for j in range(1, 9))
    jac = " + ".join(d0(f"tp{j}", f"tp{j} + fp{j} + fn{j}") for j in range(1, 9))
    return with_views(view) + f""",
p AS (SELECT y_fine AS y, {_sigmoid_sql('logits_fine')} AS p FROM {view}),
b AS (SELECT y, p, list_transform(p, lambda x: CAST(x >= {threshold} AS INTEGER)) AS b FROM p),
s AS (SELECT {", ".join(sums)}, count(*) AS n,
        sum(list_sum(list_transform(range(1, 9), lambda j: abs(y[j] - b[j])))) AS mism,
        sum(CAST(y = b AS INTEGER)) AS exact,
        sum({_lrap_sql('y', 'p')}) AS lrap_sum FROM b)
SELECT round({d0(f"2 * ({tp})", f"2 * ({tp}) + ({fp}) + ({fn})")}, 6) AS micro_f1,
  round(({f1}) / 8, 6) AS macro_f1,
  round(mism / (n * 8), 6) AS hamming_loss,
  round(exact / n, 6) AS subset_accuracy,
  round({d0(f"({tp})", f"({tp}) + ({fp}) + ({fn})")}, 6) AS jaccard_micro,
  round(({jac}) / 8, 6) AS jaccard_macro,
  round(lrap_sum / n, 6) AS lrap
FROM s
"""


@register("fine_metrics", _fine_sql("scored"))
def fine_metrics(spark, sf_dir):
    return B.rounded(M.fine_metrics(B.scored(spark, sf_dir)))


@register("fine_metrics_model_b", _fine_sql("scored_b"))
def fine_metrics_model_b(spark, sf_dir):
    return B.rounded(M.fine_metrics(B.scored_b(spark, sf_dir)))


# ---------------------------------------------------------------- A17-A20

def _losses_sql() -> str:
    softplus = "(greatest({x}, 0.0) + ln(1 + exp(-abs({x}))))"
    pw = ", ".join(f"(n - pos{j}) / (pos{j} + 1e-6)" for j in range(1, 9))
    pos = ", ".join(f"sum(CAST(y_fine[{j}] AS DOUBLE)) AS pos{j}" for j in range(1, 9))

    def bce(weighted):
        terms = []
        for j in range(1, 9):
            z = f"logits_fine[{j}]"
            w = f"pw[{j}]" if weighted else "1.0"
            terms.append(f"{w} * y_fine[{j}] * {softplus.format(x='-' + z)} + "
                         f"(1 - y_fine[{j}]) * {softplus.format(x=z)}")
        return " + ".join(f"({t})" for t in terms)
    return with_views("scored") + f""",
cnt AS (SELECT y_coarse AS cls, count(*) AS n_c FROM scored GROUP BY 1),
tot AS (SELECT count(*) AS n, {pos} FROM scored),
cw AS (SELECT c.cls, (SELECT n FROM tot) / (3.0 * coalesce(CAST(n_c AS DOUBLE), 1.0)) AS w
       FROM (VALUES (0), (1), (2)) c(cls) LEFT JOIN cnt ON c.cls = cnt.cls),
pwt AS (SELECT [{pw}] AS pw FROM tot),
r AS (
  SELECT s.*, cw.w,
    list_max(logits_coarse) + ln(list_sum(list_transform(logits_coarse, lambda x: exp(x - list_max(logits_coarse)))))
      - logits_coarse[y_coarse + 1] AS nll,
    {bce(True)} AS bce_w,
    {bce(False)} AS bce_p,
    {_softmax_sql('logits_coarse')} AS p,
    list_reduce({_sigmoid_sql('logits_fine')}, lambda a, x: a * (1.0 - x), 1.0) AS q
  FROM scored s JOIN cw ON s.y_coarse = cw.cls, pwt),
agg AS (
  SELECT sum(w * nll) / sum(w) AS ce_w, avg(nll) AS ce, sum(bce_w) / (count(*) * 8) AS bce_w,
    sum(bce_p) / (count(*) * 8) AS bce_p,
    avg(p[1] * (1.0 - q) + (p[2] + p[3]) * q) AS penalty
  FROM r)
SELECT round(ce_w, 6) AS ce_weighted, round(ce, 6) AS ce, round(bce_w, 6) AS bce_pos_weighted,
  round(bce_p, 6) AS bce, round(penalty, 6) AS penalty, round(ce_w + 1.0 * bce_w, 6) AS loss_flat,
  round(ce + 1.0 * bce_p + 1.0 * penalty, 6) AS loss_hier
FROM agg
"""


@register("losses", _losses_sql())
def losses(spark, sf_dir):
    return B.rounded(M.losses(B.scored(spark, sf_dir)))


# ---------------------------------------------------------------- A19 per row

_AUDIT_SQL = with_views("scored") + f""",
r AS (SELECT id, {_softmax_sql('logits_coarse')} AS p,
        list_reduce({_sigmoid_sql('logits_fine')}, lambda a, x: a * (1.0 - x), 1.0) AS q FROM scored)
SELECT id, round(p[1] * (1.0 - q) + (p[2] + p[3]) * q, 6) AS penalty,
  (p[1] * (1.0 - q) + (p[2] + p[3]) * q) > 0.5 AS inconsistent
FROM r
"""


@register("consistency_audit", _AUDIT_SQL)
def consistency_audit(spark, sf_dir):
    sc = B.scored(spark, sf_dir)
    pen = M.consistency_penalty(F.col("logits_coarse"), F.col("logits_fine"))
    return sc.select("id", pen.alias("_p")).select(
        "id", F.round("_p", 6).alias("penalty"), (F.col("_p") > 0.5).alias("inconsistent"))


# ---------------------------------------------------------------- A2, A3

_CW_SQL = with_views("posts") + """,
cnt AS (SELECT hate_label AS cls, count(*) AS n_c FROM posts GROUP BY 1)
SELECT c.cls, CAST(c.ord AS BIGINT) AS class_ord,
  round((SELECT count(*) FROM posts) / (3.0 * coalesce(CAST(n_c AS DOUBLE), 1.0)), 6) AS weight
FROM (VALUES ('clean', 0), ('offensive', 1), ('hate', 2)) c(cls, ord) LEFT JOIN cnt ON c.cls = cnt.cls
"""


@register("class_weights", _CW_SQL)
def class_weights(spark, sf_dir):
    w = M.class_weights(B.posts(spark, sf_dir), "hate_label", FV.COARSE_CLASSES)
    return w.select("cls", F.col("class_ord").cast("long").alias("class_ord"),
                    F.round("weight", 6).alias("weight"))


_PW_SQL = with_views("posts") + """,
s AS (SELECT count(*) AS n, """ + ", ".join(
    f"sum(CAST({c} AS DOUBLE)) AS p{i}" for i, c in enumerate(FV.FINE_COLS)) + """ FROM posts)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS label, {i} AS label_ord, round((n - p{i}) / (p{i} + 1e-6), 6) AS weight FROM s"
    for i, c in enumerate(FV.FINE_COLS))


@register("pos_weights", _PW_SQL)
def pos_weights(spark, sf_dir):
    w = M.pos_weights(B.posts(spark, sf_dir), FV.FINE_COLS)
    return w.select("label", "label_ord", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- M8

_NAMES10 = [FV.ID2LABEL[i] for i in range(10)]


def _suspect_sql(view_alias: str = "logits10") -> str:
    names = "[" + ", ".join("'" + n + "'" for n in _NAMES10) + "]"
    return f"""sus AS (
  SELECT id, p, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred_id,
    list_filter({names}, lambda n, i: p[i] >= 0.3) AS s
  FROM (SELECT id, {_softmax_sql('logits')} AS p FROM {view_alias}))"""


_SUSPECT_SQL = with_views("logits10") + "," + _suspect_sql() + f"""
SELECT id, pred_id, {"['" + "', '".join(_NAMES10) + "']"}[pred_id + 1] AS pred_label,
  array_to_string(CASE WHEN len(s) = 0 THEN ['none'] ELSE s END, '|') AS suspected,
  round(list_max(p), 6) AS confidence
FROM sus
"""


@register("suspected_labels", _SUSPECT_SQL)
def suspected_labels(spark, sf_dir):
    out = S.suspect(B.logits10(spark, sf_dir), _NAMES10, FV.BASELINE_THRESHOLD)
    return out.select("id", "pred_id", "pred_label", F.array_join("suspected", "|").alias("suspected"),
                      F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- M7 record

_TWO_HEAD_SQL = with_views("scored") + f""",
r AS (SELECT id, {_softmax_sql('logits_coarse')} AS pc, {_sigmoid_sql('logits_fine')} AS pf FROM scored)
SELECT id, ['clean', 'offensive', 'hate'][list_position(pc, list_max(pc))] AS coarse_pred,
  round(list_max(pc), 6) AS coarse_confidence,
  array_to_string(list_filter({"['" + "', '".join(FV.FINE_COLS) + "']"}, lambda n, i: pf[i] >= 0.5), '|') AS fine_pred
FROM r
"""


@register("two_head_predictions", _TWO_HEAD_SQL)
def two_head_predictions(spark, sf_dir):
    rec = S.two_head_record(B.scored(spark, sf_dir))
    return rec.select("id", "coarse_pred", F.round("coarse_confidence", 6).alias("coarse_confidence"),
                      F.array_join("fine_pred", "|").alias("fine_pred"))


# ---------------------------------------------------------------- J3

_COMPARE_SQL = ("WITH " + with_views("logits10")[5:].rstrip() + """,
la AS (SELECT id, logits FROM logits10),
lb AS (SELECT vec_id AS id, list_transform(embedding[21:30], lambda x: CAST(x AS DOUBLE)) AS logits FROM embeddings),
""" + _suspect_sql("la").replace("sus AS", "sa AS") + ",\n" + _suspect_sql("lb").replace("sus AS", "sb AS") + """
SELECT a.id, a.pred_id AS pred_a, b.pred_id AS pred_b, a.pred_id = b.pred_id AS agree,
  array_to_string(list_filter(CASE WHEN len(a.s) = 0 THEN ['none'] ELSE a.s END,
    lambda x: NOT list_contains(CASE WHEN len(b.s) = 0 THEN ['none'] ELSE b.s END, x)), '|') AS only_a,
  array_to_string(list_filter(CASE WHEN len(b.s) = 0 THEN ['none'] ELSE b.s END,
    lambda x: NOT list_contains(CASE WHEN len(a.s) = 0 THEN ['none'] ELSE a.s END, x)), '|') AS only_b
FROM sa a JOIN sb b ON a.id = b.id
""")


@register("model_comparison", _COMPARE_SQL)
def model_comparison(spark, sf_dir):
    a = S.suspect(B.logits10(spark, sf_dir), _NAMES10, FV.BASELINE_THRESHOLD)
    b = S.suspect(B.logits10(spark, sf_dir, first_dim=21), _NAMES10, FV.BASELINE_THRESHOLD)
    cmp_ = S.compare_predictions(a, b, on="id")
    return cmp_.select("id", "pred_a", "pred_b", "agree", F.array_join("only_a", "|").alias("only_a"),
                       F.array_join("only_b", "|").alias("only_b"))


# ---------------------------------------------------------------- A8 (pivoted)

_PIVOT_SQL = with_views("scored") + f""",
r AS (SELECT CAST(y_coarse AS INTEGER) AS y, list_position({_softmax_sql('logits_coarse')},
        list_max({_softmax_sql('logits_coarse')})) - 1 AS pred FROM scored)
SELECT y, count(*) FILTER (WHERE pred = 0) AS "0", count(*) FILTER (WHERE pred = 1) AS "1",
  count(*) FILTER (WHERE pred = 2) AS "2"
FROM r GROUP BY y
"""


@register("confusion_pivot", _PIVOT_SQL)
def confusion_pivot(spark, sf_dir):
    from ..functions.scores import argmax, softmax
    sc = B.scored(spark, sf_dir)
    return M.confusion_matrix(sc, "y_coarse", argmax(softmax("logits_coarse")), [0, 1, 2])


# ---------------------------------------------------------------- J3 on the two-head models

def _record_sql(view: str, alias: str) -> str:
    fine = "['" + "', '".join(FV.FINE_COLS) + "']"
    return f"""{alias} AS (
  SELECT id, ['clean', 'offensive', 'hate'][list_position(pc, list_max(pc))] AS pred,
    list_filter({fine}, lambda n, i: pf[i] >= 0.5) AS labs
  FROM (SELECT id, {_softmax_sql('logits_coarse')} AS pc, {_sigmoid_sql('logits_fine')} AS pf FROM {view}))"""


_TWO_HEAD_CMP_SQL = ("WITH " + with_views("scored", "scored_b")[5:].rstrip() + ",\n" + _record_sql("scored", "ra")
                     + ",\n" + _record_sql("scored_b", "rb") + """
SELECT a.id, a.pred AS pred_a, b.pred AS pred_b, a.pred = b.pred AS agree,
  array_to_string(list_filter(a.labs, lambda x: NOT list_contains(b.labs, x)), '|') AS only_a,
  array_to_string(list_filter(b.labs, lambda x: NOT list_contains(a.labs, x)), '|') AS only_b
FROM ra a JOIN rb b ON a.id = b.id
""")


@register("two_head_comparison", _TWO_HEAD_CMP_SQL)
def two_head_comparison(spark, sf_dir):
    """J3 on the two two-head models of FIXTURES (scored vs scored_b)."""
    a = S.two_head_record(B.scored(spark, sf_dir))
    b = S.two_head_record(B.scored_b(spark, sf_dir))
    c = S.compare_predictions(a, b, on="id", pred_col="coarse_pred", labels_col="fine_pred")
    return c.select("id", "pred_a", "pred_b", "agree", F.array_join("only_a", "|").alias("only_a"),
                    F.array_join("only_b", "|").alias("only_b"))
