"""Evaluation metrics and losses as single-pass aggregations.

Every bundle is one partial + final aggregation over the scored table (the
shuffle carries one small row per task) or a second tiny aggregation over a
K x K confusion table. Nothing is collected; ``_collect_weights`` (used by the
trainer) fetches only per-class / per-label weights, bounded by the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import (argmax, binarize, logsumexp, lrap_row, one_hot, sigmoid, softmax,
                                softplus)
from ..plans import fixed_values as FV


def _div0(num: Column, den: Column) -> Column:
    """num / den with 0/0 -> 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


# ---------------------------------------------------------------- single-label

def confusion(df: DataFrame, y_col: str, pred: Column) -> DataFrame:
    """(y, pred, n) counts — A8 in long form; map-side combined."""
    return (df.select(F.col(y_col).cast("int").alias("y"), pred.cast("int").alias("pred"))
            .groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, y_col: str, pred: Column, classes: list[int]) -> DataFrame:
    """A8 as a pivoted matrix (rows = truth, one column per predicted class)."""
    c = confusion(df, y_col, pred)
    return (c.groupBy("y").pivot("pred", classes).agg(F.first("n"))
            .na.fill(0))


def per_class_counts(conf: DataFrame) -> DataFrame:
    """class, tp, fp, fn over classes present in truth or prediction."""
    as_truth = conf.select(F.col("y").alias("cls"),
                           F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                           F.lit(0).cast("long").alias("fp"),
                           F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"))
    as_pred = conf.where(F.col("y") != F.col("pred")).select(
        F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"),
        F.lit(0).cast("long").alias("fn"))
    return (as_truth.unionByName(as_pred).groupBy("cls")
            .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def single_label_scores(conf: DataFrame) -> DataFrame:
    """accuracy, micro_f1 (= accuracy), macro_f1 over the classes seen."""
    pc = per_class_counts(conf)
    f1 = _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return pc.agg(
        (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("accuracy"),
        _div0(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"),
        F.avg(f1).alias("macro_f1"))


def _single_label_bundle(rows: DataFrame, n_classes: int, full: bool = False) -> DataFrame:
    """accuracy, micro F1, macro F1 over the classes seen, mean LRAP and, if ``full``,
    Hamming loss, subset accuracy and Jaccard scores, from rows (y, pred, lrap): one
    aggregation with conditional counts per class."""
    y, pred = F.col("y"), F.col("pred")
    aggs = [F.count(F.lit(1)).alias("n"), F.count(F.when(y == pred, 1)).alias("hit"), F.sum("lrap").alias("lrap_sum")]
    for c in range(n_classes):
        aggs += [F.count(F.when((y == c) & (pred == c), 1)).alias(f"tp{c}"),
                 F.count(F.when((y == c) | (pred == c), 1)).alias(f"any{c}")]
    s = rows.agg(*aggs)
    # 2 tp + fp + fn = tp + (rows that have the class on either side)
    f1 = [_div0(2 * F.col(f"tp{c}"), F.col(f"tp{c}") + F.col(f"any{c}")) for c in range(n_classes)]
    jaccard = [_div0(F.col(f"tp{c}"), F.col(f"any{c}")) for c in range(n_classes)]
    seen = sum((F.col(f"any{c}") > 0).cast("int") for c in range(n_classes))
    hit, n, of_seen = F.col("hit"), F.col("n"), F.when(seen > 0, seen)
    out = [(hit / n).alias("accuracy"), (hit / n).alias("micro_f1"), (sum(f1) / of_seen).alias("macro_f1"), (F.col("lrap_sum") / n).alias("lrap")]
    if full:  # one label a row: a miss is one class too many and one too few
        out += [((n - hit) / n).alias("hamming_loss"), (hit / n).alias("subset_accuracy"), (hit / (2 * n - hit)).alias("jaccard_micro"),
                (sum(jaccard) / of_seen).alias("jaccard_macro")]
    return s.select(*out)


def coarse_metrics(scored: DataFrame, y_col: str = "y_coarse", logits_col: str = "logits_coarse",
                   n_classes: int = 3, full: bool = False) -> DataFrame:
    """Accuracy, micro F1, macro F1, LRAP (one row, one pass); ``full`` adds what
    the epoch records hold beside them."""
    probs = scored.select(F.col(y_col).cast("int").alias("y"), softmax(logits_col).alias("p"))
    return _single_label_bundle(probs.select("y", argmax("p").alias("pred"),
                                             lrap_row(one_hot(F.col("y"), n_classes), F.col("p")).alias("lrap")), n_classes, full)


def single_label_metrics(scored: DataFrame, y_col: str = "y", logits_col: str = "logits",
                         n_classes: int = 10) -> DataFrame:
    """A16 baseline bundle from logits: accuracy, macro F1, LRAP (ranking on
    logits), in one pass."""
    rows = scored.select(F.col(y_col).cast("int").alias("y"), F.col(logits_col).alias("z"))
    return _single_label_bundle(rows.select("y", argmax("z").alias("pred"),
                                            lrap_row(one_hot(F.col("y"), n_classes), F.col("z")).alias("lrap")),
                                n_classes).drop("micro_f1")


# ---------------------------------------------------------------- multi-label

FINE_METRICS = ["micro_f1", "macro_f1", "hamming_loss", "subset_accuracy",
                "jaccard_micro", "jaccard_macro", "lrap"]


def fine_metrics(scored: DataFrame, y_col: str = "y_fine", logits_col: str = "logits_fine",
                 threshold: float = FV.TWO_HEAD_THRESHOLD, n_labels: int = 8,
                 probs_col: str | None = None) -> DataFrame:
    """The seven multi-label metrics in one aggregation."""
    p = F.col(probs_col) if probs_col else sigmoid(logits_col)
    rows = scored.select(F.col(y_col).alias("y"), p.alias("p"))
    rows = rows.select("y", "p", binarize("p", threshold).alias("b"))
    aggs = []
    for j in range(n_labels):
        y, b = F.col("y")[j], F.col("b")[j]
        aggs += [F.sum(y * b).alias(f"tp{j}"), F.sum((1 - y) * b).alias(f"fp{j}"),
                 F.sum(y * (1 - b)).alias(f"fn{j}")]
    mism = F.aggregate(F.zip_with("y", "b", lambda a, c: F.abs(a - c)), F.lit(0), lambda s, x: s + x)
    aggs += [F.count(F.lit(1)).alias("n"), F.sum(mism).alias("mism"),
             F.sum((F.col("y") == F.col("b")).cast("int")).alias("exact"),
             F.sum(lrap_row(F.col("y"), F.col("p"))).alias("lrap_sum")]
    s = rows.agg(*aggs)
    tp = sum(F.col(f"tp{j}") for j in range(n_labels))
    fp = sum(F.col(f"fp{j}") for j in range(n_labels))
    fn = sum(F.col(f"fn{j}") for j in range(n_labels))
    f1s = [_div0(2 * F.col(f"tp{j}"), 2 * F.col(f"tp{j}") + F.col(f"fp{j}") + F.col(f"fn{j}"))
           for j in range(n_labels)]
    jac = [_div0(F.col(f"tp{j}"), F.col(f"tp{j}") + F.col(f"fp{j}") + F.col(f"fn{j}"))
           for j in range(n_labels)]
    return s.select(
        _div0(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
        (sum(f1s) / n_labels).alias("macro_f1"),
        (F.col("mism") / (F.col("n") * n_labels)).alias("hamming_loss"),
        (F.col("exact") / F.col("n")).alias("subset_accuracy"),
        _div0(tp, tp + fp + fn).alias("jaccard_micro"),
        (sum(jac) / n_labels).alias("jaccard_macro"),
        (F.col("lrap_sum") / F.col("n")).alias("lrap"))


# ---------------------------------------------------------------- weights (A2, A3)

def class_weights(df: DataFrame, label_col: str, classes: list) -> DataFrame:
    """Balanced weights N / (K * n_c); a class absent from df counts as 1."""
    spark = df.sparkSession
    k = len(classes)
    counts = df.groupBy(F.col(label_col).alias("cls")).agg(F.count(F.lit(1)).alias("n_c"))
    total = counts.agg(F.sum("n_c").alias("n_total"))
    cls_df = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], ["cls", "class_ord"])
    # K classes is a schema constant: the class list side is tiny.
    joined = (F.broadcast(cls_df).join(counts, "cls", "left")
              .withColumn("n_c", F.coalesce(F.col("n_c").cast("double"), F.lit(1.0))))
    # N as a one-row aggregate attached through a constant key (no cross join).
    joined = joined.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    return joined.select("cls", "class_ord",
                         (F.col("n_total") / (F.lit(k) * F.col("n_c"))).alias("weight")).drop("_k")


def pos_weights(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """(N - pos) / (pos + 1e-6) per label column, long form (label, label_ord, weight)."""
    s = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"p{i}")
                                              for i, c in enumerate(label_cols)])
    stack = ", ".join(f"'{c}', {i}, p{i}" for i, c in enumerate(label_cols))
    long = s.selectExpr("n", f"stack({len(label_cols)}, {stack}) as (label, label_ord, pos)")
    return long.select("label", F.col("label_ord").cast("int").alias("label_ord"),
                       ((F.col("n") - F.col("pos")) / (F.col("pos") + F.lit(1e-6))).alias("weight"))


def _collect_weights(wdf: DataFrame, ord_col: str, n: int) -> list[float]:
    """Bounded by the label count (a schema constant), so a collect is safe."""
    rows = wdf.select(ord_col, "weight").collect()
    out = [1.0] * n
    for r in rows:
        out[int(r[0])] = float(r[1])
    return out


# ---------------------------------------------------------------- losses

def consistency_penalty(zc: Column, zf: Column) -> Column:
    """clean * P(any fine) + toxic * P(no fine), per row."""
    p = softmax(zc)
    f = sigmoid(zf)
    clean = p[0]
    toxic = F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.lit(0.0), lambda a, x: a + x)
    no_fine = F.aggregate(f, F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x))
    return clean * (F.lit(1.0) - no_fine) + toxic * no_fine


def losses(scored: DataFrame, lambda_fine: float = 1.0, lambda_hier: float = 1.0,
           n_classes: int = 3, n_labels: int = 8) -> DataFrame:
    """A17-A20 in one pass over the scored table.

    The class weights (A2) and positive weights (A3) depend on counts of the
    same table, but they factor out of the sums: per class c the count n_c and
    the NLL sum S_c, per label j the positives P_j and the two BCE halves
    A_j = sum y softplus(-z), B_j = sum (1 - y) softplus(z). The weighted
    losses are then sum_c w_c S_c / sum_c w_c n_c and
    sum_j (pw_j A_j + B_j) / (N L), computed from one row of partial sums."""
    zc, zf, yf = F.col("logits_coarse"), F.col("logits_fine"), F.col("y_fine")
    y = F.col("y_coarse").cast("int")
    nll = logsumexp(zc) - F.element_at(zc, y + 1)
    rows = scored.select(y.alias("y"), nll.alias("nll"), yf.alias("yf"), zf.alias("zf"),
                         consistency_penalty(zc, zf).alias("pen"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("nll").alias("s_all"), F.sum("pen").alias("pen")]
    for c in range(n_classes):
        aggs += [F.sum((F.col("y") == c).cast("long")).alias(f"n{c}"),
                 F.sum(F.when(F.col("y") == c, F.col("nll")).otherwise(0.0)).alias(f"s{c}")]
    for j in range(n_labels):
        yj, zj = F.col("yf")[j].cast("double"), F.col("zf")[j]
        aggs += [F.sum(yj).alias(f"p{j}"), F.sum(yj * softplus(-zj)).alias(f"a{j}"),
                 F.sum((1 - yj) * softplus(zj)).alias(f"b{j}")]
    s = rows.agg(*aggs)
    n = F.col("n")
    w = [n / (F.lit(n_classes) * F.when(F.col(f"n{c}") == 0, F.lit(1.0)).otherwise(F.col(f"n{c}")))
         for c in range(n_classes)]
    ce_w = sum(w[c] * F.col(f"s{c}") for c in range(n_classes)) / sum(w[c] * F.col(f"n{c}") for c in range(n_classes))
    pw = [(n - F.col(f"p{j}")) / (F.col(f"p{j}") + F.lit(1e-6)) for j in range(n_labels)]
    bce_w = sum(pw[j] * F.col(f"a{j}") + F.col(f"b{j}") for j in range(n_labels)) / (n * n_labels)
    bce_p = sum(F.col(f"a{j}") + F.col(f"b{j}") for j in range(n_labels)) / (n * n_labels)
    ce = F.col("s_all") / n
    pen = F.col("pen") / n
    return s.select(ce_w.alias("ce_weighted"), ce.alias("ce"), bce_w.alias("bce_pos_weighted"),
                    bce_p.alias("bce"), pen.alias("penalty"),
                    (ce_w + lambda_fine * bce_w).alias("loss_flat"),
                    (ce + lambda_fine * bce_p + lambda_hier * pen).alias("loss_hier"))
