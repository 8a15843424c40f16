"""Array-of-scores column functions (higher-order functions, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(logits) -> Column:
    z = _c(logits)
    m = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - m))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def sigmoid(logits) -> Column:
    return F.transform(_c(logits), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logsumexp(logits) -> Column:
    z = _c(logits)
    m = F.array_max(z)
    return m + F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def argmax(scores) -> Column:
    """0-based index of the maximum, first index on ties."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def binarize(probs, threshold: float) -> Column:
    """p >= threshold (inclusive) as 0/1 ints."""
    return F.transform(_c(probs), lambda p: (p >= F.lit(threshold)).cast("int"))


def one_hot(y, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == _c(y)).cast("int"))


def lrap_row(truth, scores) -> Column:
    """Label-ranking average precision of one row.

    Mean over true labels j of |{true k: s_k >= s_j}| / |{k: s_k >= s_j}|;
    a row with no true label or with every label true scores 1.0."""
    y, s = _c(truth), _c(scores)
    pairs = F.zip_with(y, s, lambda a, b: F.struct(a.alias("y"), b.alias("s")))
    n_true = F.aggregate(y, F.lit(0), lambda a, x: a + x)
    total = F.aggregate(
        F.filter(pairs, lambda p: p["y"] == 1), F.lit(0.0),
        lambda acc, p: acc + F.size(F.filter(pairs, lambda q: (q["y"] == 1) & (q["s"] >= p["s"])))
        / F.size(F.filter(pairs, lambda q: q["s"] >= p["s"])))
    return F.when((n_true == 0) | (n_true == F.size(s)), F.lit(1.0)).otherwise(total / n_true)


def labels_over(probs, names: list[str], threshold: float) -> Column:
    """Names of the labels whose probability is >= threshold."""
    arr = F.array(*[F.lit(n) for n in names])
    p = _c(probs)
    return F.filter(arr, lambda _, i: F.coalesce(F.get(p, i) >= F.lit(threshold), F.lit(False)))


def decode(idx, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), _c(idx) + 1)
