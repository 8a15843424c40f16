"""Distributed model jobs.

Two-head model (M2 flat, M3 hierarchical): a linear layer over hashed char n-gram
features with a 3-way softmax head and 8 sigmoid heads, fitted by L-BFGS until the
gradient is small. The rows are packed once into blocks of some hundred rows (about
two bytes a count, laid out as a dense matrix by each task, or sparse arrays), which stay
persisted. Each evaluation is one Spark job: every partition turns its blocks into one partial loss and
gradient per model, merged by a tree reduction. Models over the same rows share the
evaluations: one scan of the blocks serves the trial points of all that are still open.
The driver holds weights and the solver's last few steps (bounded by ``dim``), never rows.
"""

from __future__ import annotations

from collections import namedtuple
from copy import copy
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import fixed_values as FV
from .features import DEFAULT_DIM
from .metrics import FINE_METRICS, class_weights, coarse_metrics, fine_metrics, pos_weights, _collect_weights

N_COARSE = 3
N_FINE = 8
N_OUT = N_COARSE + N_FINE
ROWS_PER_TASK = 256
MOST_PER_TASK = 1 << 16
#: A bound far above what the tolerances need; a fit that reaches it raises.
MAX_STEPS = 1000
BLOCK_BYTES = 4 << 20
NO_LABEL = -1 << 31  # a valid row without a coarse label
COARSE_RECORD = ["accuracy", "micro_f1", "macro_f1", "lrap", "hamming_loss", "subset_accuracy", "jaccard_micro", "jaccard_macro"]


@dataclass
class TwoHeadModel:
    weights: np.ndarray  # 11 x (dim + 1), last column is the bias
    dim: int
    hierarchical: bool
    history: list        # (step, train loss); step 0 is the start
    gradient_norms: list | None = None   # one per step of the history
    records: list | None = None   # validation records (epoch, head, metric, value)
    best_epoch: int | None = None
    stop_epoch: int | None = None

    def to_frame(self, spark) -> DataFrame:
        """Weights as a table (feature row, 11 weights)."""
        rows = [(int(k), [float(x) for x in self.weights[k]]) for k in range(self.weights.shape[0])]
        return spark.createDataFrame(rows, "output int, w array<double>")


def _rows_counts(features: pd.Series):
    """CSR-like arrays from sparse vectors (Arrow hands them over as
    {indices, values}): feature index, row number, value."""
    ind, vals = [], []
    for v in features:
        if v is None:
            ind.append(np.zeros(0, dtype=np.int64))
            vals.append(np.zeros(0))
            continue
        # Arrow batches carry {type, size, indices, values}; pandas conversions
        # of collected rows carry SparseVector / DenseVector objects.
        indices = v.get("indices") if isinstance(v, dict) else getattr(v, "indices", None)
        values = v["values"] if isinstance(v, dict) else v.values
        if indices is not None:
            ind.append(np.asarray(indices, dtype=np.int64))
            vals.append(np.asarray(values, dtype=np.float64))
        else:  # dense vector
            d = np.asarray(values, dtype=np.float64)
            nz = np.nonzero(d)[0]
            ind.append(nz.astype(np.int64))
            vals.append(d[nz])
    lens = np.array([len(a) for a in ind], dtype=np.int64)
    idx = np.concatenate(ind) if lens.sum() else np.zeros(0, dtype=np.int64)
    cnt = np.concatenate(vals) if lens.sum() else np.zeros(0)
    return idx, np.repeat(np.arange(len(features)), lens), cnt


def _rows_matrix(features: pd.Series):
    """The same with each value divided by the root of its row's total."""
    idx, row, cnt = _rows_counts(features)
    totals = np.bincount(row, weights=cnt, minlength=len(features))
    return idx, row, cnt / np.sqrt(np.maximum(totals, 1.0))[row]


def _forward(Wt: np.ndarray, dim: int, idx, row, val, n: int) -> np.ndarray:
    """Wt is (11, dim + 1): one contiguous row per output, bias last."""
    Z = np.empty((n, Wt.shape[0]))
    for k in range(Wt.shape[0]):
        Z[:, k] = Wt[k, dim]
        if len(idx):
            Z[:, k] += np.bincount(row, weights=Wt[k][idx] * val, minlength=n)
    return Z


PACKED = "n int, dense boolean, cols binary, steps binary, small binary, at binary, over binary, idx binary, row binary, val binary, total binary, y binary, yf binary"


def _vector_cells(col):
    """(idx, row, value) of the cells that are not zero in an Arrow column of vectors."""
    parts = dict(zip([f.name for f in col.type], col.flatten()))
    lens, sparse = (parts[k].value_lengths().fill_null(0).to_numpy() for k in ("values", "indices"))
    value = parts["values"].flatten().to_numpy()
    row = np.repeat(np.arange(len(col)), lens)
    if (sparse == lens).all():
        idx = parts["indices"].flatten().to_numpy()
    else:  # dense vectors name no indices
        idx = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        idx[np.repeat(sparse > 0, lens)] = parts["indices"].flatten().to_numpy()
    kept = value != 0
    return (idx, row, value) if kept.all() else (idx[kept], row[kept], value[kept])


def _gaps(cell: np.ndarray, value: np.ndarray):
    """Cells in ascending order as steps of a byte and values of a byte. Steps over 255 are
    made by cells of value 0 between; other values than 1 to 255 count as 0 and come
    beside it as (cells, values)."""
    small = (value >= 1) & (value <= 255) & (value == np.floor(value))
    step = np.diff(cell, prepend=-1)
    between = (step - 1) // 255
    ends = np.cumsum(between + 1) - 1
    steps, values = np.full(len(cell) + int(between.sum()), 255, np.uint8), np.zeros(len(cell) + int(between.sum()), np.uint8)
    steps[ends], values[ends] = step - 255 * between, np.where(small, value, 0)
    return steps, values, cell[~small].astype(np.int32), value[~small]


def _packed_blocks(data: DataFrame, feat_col: str, dim: int) -> DataFrame:
    """Rows (features, y, yf) as blocks of at most BLOCK_BYTES / 4 cells. If a sixteenth of
    a block's cells are not zero, the columns in which a sixteenth are not are kept for a
    dense matrix, at two bytes for most cells that are not zero; the rest are sparse arrays."""
    n_block = max(1, BLOCK_BYTES // (4 * dim))

    def pack(batches):
        import pyarrow as pa
        schema = pa.schema([(k, pa.int32() if k == "n" else pa.bool_() if k == "dense" else pa.binary()) for k in _Packed._fields])
        for b in batches:
            for begin in range(0, b.num_rows, n_block):
                part = b.slice(begin, n_block)
                n, (idx, row, val) = part.num_rows, _vector_cells(part.column(0))
                total, dense = np.bincount(row, weights=val, minlength=n), dim * n <= 16 * len(idx)
                frequent = 16 * np.bincount(idx, minlength=dim) >= n if dense else np.zeros(dim, bool)
                cols, there = np.flatnonzero(frequent), frequent[idx]
                cell = row[there] * len(cols) + np.searchsorted(cols, idx[there])
                cell, first = (cell, slice(None)) if (np.diff(cell) > 0).all() else np.unique(cell, return_index=True)
                steps, small, at, over = _gaps(cell, val[there][first])
                arrays = (cols.astype(np.int32), steps, small, at, over,
                          idx[~there].astype(np.int32), row[~there].astype(np.int32), val[~there], total,
                          part.column(1).to_numpy(zero_copy_only=False).astype(np.int32),
                          part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int8))
                yield pa.RecordBatch.from_pylist([dict(zip(_Packed._fields, [n, dense, *(x.tobytes() for x in arrays)]))], schema)
    return data.select(feat_col, "y", "yf").mapInArrow(pack, PACKED)


_Packed = namedtuple("_Packed", "n dense cols steps small at over idx row val total y yf")


class _Block:
    """A packed block: products with weights (outputs x (dim + 1), bias last) and back."""

    def __init__(self, b, dim: int, scaled: bool = True, room: np.ndarray | None = None):
        """``scaled``: each value divided by the root of its row's total. ``room``: where the
        dense matrix is laid out, until that of another block is."""
        self.n, self.dim, self.cols, self.val = b.n, dim, np.frombuffer(b.cols, np.int32), np.frombuffer(b.val)
        self.idx, self.row = (np.frombuffer(x, np.int32).astype(np.intp) for x in (b.idx, b.row))
        self.root = np.sqrt(np.maximum(np.frombuffer(b.total), 1.0))[:, None] if scaled else None
        flat = np.empty(b.n * len(self.cols)) if room is None else room[:b.n * len(self.cols)]
        flat.fill(0.0)
        cell = np.cumsum(np.frombuffer(b.steps, np.uint8), dtype=np.intp)
        cell -= 1
        flat[cell] = np.frombuffer(b.small, np.uint8)
        flat[np.frombuffer(b.at, np.int32)] = np.frombuffer(b.over)
        self.X = flat.reshape(b.n, len(self.cols))

    def squared(self):
        """The block of the squared values; not of a scaled one."""
        out = copy(self)
        out.X, out.val = self.X ** 2, self.val ** 2
        return out

    def outputs(self, W: np.ndarray) -> np.ndarray:
        Z = self.X @ W[:, self.cols].T
        if len(self.idx):
            for k, w in enumerate(W):
                Z[:, k] += np.bincount(self.row, weights=w[self.idx] * self.val, minlength=self.n)
        if self.root is not None:
            Z /= self.root
        return Z + W[:, -1]

    def gradient(self, dZ: np.ndarray) -> np.ndarray:
        G = np.zeros((dZ.shape[1], self.dim + 1))
        G[:, -1] = dZ.sum(axis=0)
        if self.root is not None:
            dZ = dZ / self.root
        if len(self.idx):
            for k, d in enumerate(np.ascontiguousarray(dZ.T)):
                G[k, :-1] = np.bincount(self.idx, weights=d[self.row] * self.val, minlength=self.dim)
        if len(self.cols):
            G[:, self.cols] += dZ.T @ self.X
        return G


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _softplus(x):
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def head_gradients(zc, zf, y, Y, cw, pw, n_total, w_total, lambda_fine, lambda_hier):
    """Loss sums and dLoss/dlogits for one batch (global normalisers given).

    CE: w_y (p - onehot) / sum(w); BCE: (f (1 + (pw - 1) y) - pw y) / (N L);
    penalty P = c (1 - q) + (1 - c) q with c = p0, q = prod(1 - f):
    dP/dzc_k = (1 - 2q) c ([k = 0] - p_k), dP/dzf_j = -(1 - 2c) q f_j, over N."""
    p, f = _softmax(zc), _sigmoid(zf)
    onehot = np.eye(zc.shape[1])[y]
    wy = cw[y]
    lse = np.log(np.exp(zc - zc.max(1, keepdims=True)).sum(1)) + zc.max(1)
    nll = lse - zc[np.arange(len(y)), y]
    dzc = (wy[:, None] * (p - onehot)) / w_total
    bce = pw * Y * _softplus(-zf) + (1 - Y) * _softplus(zf)
    dzf = lambda_fine * (f * (1 + (pw - 1) * Y) - pw * Y) / (n_total * zf.shape[1])
    loss = float((wy * nll).sum() / w_total + lambda_fine * bce.sum() / (n_total * zf.shape[1]))
    if lambda_hier:
        c = p[:, 0]
        q = np.prod(1 - f, axis=1)
        pen = c * (1 - q) + (p[:, 1:].sum(1)) * q
        e0 = np.zeros_like(p)
        e0[:, 0] = 1
        dzc = dzc + lambda_hier * ((1 - 2 * q) * c)[:, None] * (e0 - p) / n_total
        dzf = dzf + lambda_hier * (-(1 - 2 * c) * q)[:, None] * f / n_total
        loss += float(lambda_hier * pen.sum() / n_total)
    return loss, np.concatenate([dzc, dzf], axis=1)


class Lbfgs:
    """Minimisation by L-BFGS as a dialogue: evaluate ``trial``, ``tell`` loss and
    gradient there. A step is accepted by the weak Wolfe conditions, found by doubling
    and halving; so the loss falls at every step. It is ``done`` when the gradient's norm
    is ``tol`` of the first one, or when no step lowers the loss in floating point."""

    MEMORY, TRIALS, SUFFICIENT, CURVATURE = 10, 40, 1e-4, 0.9

    def __init__(self, start: np.ndarray, tol: float):
        self.trial, self.tol, self.x, self.done = start, tol, None, False
        self.pairs, self.trace = [], []  # (step, gradient change), (loss, gradient norm) per accepted point

    def tell(self, loss: float, grad: np.ndarray) -> bool:
        """True if the trial point was accepted."""
        if self.x is not None:
            slope = float((grad * self.direction).sum())
            if not loss <= self.loss + self.SUFFICIENT * self.t * self.slope:
                self.high = self.t
            elif slope < self.CURVATURE * self.slope:
                self.low, self.fallback = self.t, (self.trial, loss, grad)
            else:
                return self._accept(self.trial, loss, grad)
            self.trials += 1
            if self.trials == self.TRIALS:
                if self.fallback:
                    return self._accept(*self.fallback)
                self.done = True
                return False
            self.t = 2 * self.low if self.high is None else (self.low + self.high) / 2
            self.trial = self.x + self.t * self.direction
            return False
        return self._accept(self.trial, loss, grad)

    def _accept(self, x, loss, grad) -> bool:
        if self.x is not None:
            s, y = x - self.x, grad - self.grad
            if (s * y).sum() > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                self.pairs = [*self.pairs, (s, y)][-self.MEMORY:]
        self.x, self.loss, self.grad = x, loss, grad
        self.trace.append((loss, float(np.linalg.norm(grad))))
        if self.trace[-1][1] <= self.tol * self.trace[0][1]:
            self.done = True
            return True
        self.direction = -self._scaled(grad)
        self.slope = float((grad * self.direction).sum())
        if self.slope >= 0:  # the memory misleads (the penalty is not convex)
            self.pairs, self.direction = [], -grad
            self.slope = -float((grad * grad).sum())
        self.t = 1.0 if self.pairs else min(1.0, 1.0 / self.trace[-1][1])
        self.low, self.high, self.trials, self.fallback = 0.0, None, 0, None
        self.trial = x + self.t * self.direction
        return True

    def _scaled(self, grad):
        q, back = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            back.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.pairs, reversed(back)):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return q


@dataclass(frozen=True)
class Objective:
    """M2 (``lambda_hier`` 0, class and positive weights from A2 / A3) or M3
    (``lambda_hier`` over 0, unweighted, as the hierarchical objective)."""
    lambda_fine: float = 1.0
    lambda_hier: float = 0.0
    weighted: bool = True


FLAT, HIERARCHICAL = Objective(), Objective(lambda_hier=1.0, weighted=False)


def _lrap(Y: np.ndarray, S: np.ndarray) -> float:
    """Sum of the rows' label-ranking average precision (``scores.lrap_row``)."""
    over = S[:, None, :] >= S[:, :, None]  # [row, j, k]: k is ranked no lower than j
    share = (over & (Y[:, None, :] == 1)).sum(axis=2) / over.sum(axis=2).clip(1)
    n_true = Y.sum(axis=1)
    return float(np.where((n_true == 0) | (n_true == Y.shape[1]), 1.0, np.where(Y == 1, share, 0.0).sum(axis=1) / np.maximum(n_true, 1)).sum())


def _tallies(Z, y, Y, threshold) -> np.ndarray:
    """What M6's metrics are made of, summed over the rows of a block: n, then of the
    coarse head hits, LRAP, true and either per class, of the fine head wrong labels,
    whole rows, LRAP, and tp, fp, fn per label."""
    with np.errstate(over="ignore"):
        p, f = _softmax(Z[:, :N_COARSE]), 1.0 / (1.0 + np.exp(-Z[:, N_COARSE:]))
    pred, B = p.argmax(axis=1), (f >= threshold).astype(int)
    onehot, own = (y[:, None] == np.arange(N_COARSE)).astype(int), np.eye(N_COARSE, dtype=int)[pred]
    known = y != NO_LABEL
    return np.concatenate([[len(y), (pred == y).sum(), _lrap(onehot[known], p[known])], (onehot & own).sum(axis=0), (onehot | own).sum(axis=0),
                           [(Y != B).sum(), (Y == B).all(axis=1).sum(), _lrap(Y, f)],
                           (Y * B).sum(axis=0), ((1 - Y) * B).sum(axis=0), (Y * (1 - B)).sum(axis=0)]).astype(float)


def _metrics(t: np.ndarray) -> dict:
    """The records of ``evaluate_two_head`` from the tallies of all rows."""
    div = lambda a, b: float(a / b) if b else 0.0
    (n, hit, lrap), tp, either = t[:3], t[3:3 + N_COARSE], t[3 + N_COARSE:3 + 2 * N_COARSE]
    fine = t[3 + 2 * N_COARSE:]
    (wrong, exact, lrap_fine), (ftp, fp, fn) = fine[:3], fine[3:].reshape(3, N_FINE)
    seen = int((either > 0).sum())
    coarse = {"accuracy": hit / n, "micro_f1": hit / n, "macro_f1": sum(div(2 * a, a + b) for a, b in zip(tp, either)) / seen, "lrap": lrap / n,
              "hamming_loss": (n - hit) / n, "subset_accuracy": hit / n, "jaccard_micro": hit / (2 * n - hit),
              "jaccard_macro": sum(div(a, b) for a, b in zip(tp, either)) / seen} if n else dict.fromkeys(COARSE_RECORD)
    m = {"micro_f1": div(2 * ftp.sum(), 2 * ftp.sum() + fp.sum() + fn.sum()), "macro_f1": sum(div(2 * a, 2 * a + b + c) for a, b, c in zip(ftp, fp, fn)) / N_FINE,
         "hamming_loss": wrong / (n * N_FINE), "subset_accuracy": exact / n, "jaccard_micro": div(ftp.sum(), ftp.sum() + fp.sum() + fn.sum()),
         "jaccard_macro": sum(div(a, a + b + c) for a, b, c in zip(ftp, fp, fn)) / N_FINE, "lrap": lrap_fine / n} if n else dict.fromkeys(FINE_METRICS)
    return {**{("coarse", k): v for k, v in coarse.items()}, **{("fine", k): v for k, v in m.items()}}


class _Selection:
    """W1 / W2 on the valid split: the best epoch's weights, strictly greater wins."""

    def __init__(self, tally, monitor, patience):
        from .history import check_monitor
        self.tally, self.patience = tally, patience
        head, _, metric = check_monitor(monitor).partition("_")
        self.monitor, self.epoch, self.stale = (head, metric), 0, 0
        self.records, self.best, self.weights, self.best_epoch = [], float("-inf"), None, None

    def look(self, W) -> bool:
        """Scores one more epoch (M6 over the packed valid rows); True when patience has
        run out."""
        self.epoch += 1
        ev = _metrics(self.tally(W))
        self.records += [(self.epoch, h, m, v) for (h, m), v in sorted(ev.items())]
        current = ev[self.monitor]
        if current is not None and current > self.best:
            self.best, self.weights, self.best_epoch, self.stale = current, W.copy(), self.epoch, 0
        else:
            self.stale += 1
        return self.stale >= self.patience


def _kept_blocks(data: DataFrame, feat_col: str, dim: int, checkpoint: bool, n_rows: int):
    """Packed blocks as an RDD that is kept in memory: an evaluation is one job over it,
    without a query to plan. A Python task costs some hundredths of a second besides its work
    and there are hundreds of evaluations, so blocks of more partitions than cores are dealt
    evenly to one per core."""
    from ..session import checkpoint_root
    blocks, cores = _packed_blocks(data, feat_col, dim), data.sparkSession.sparkContext.defaultParallelism
    if data.rdd.getNumPartitions() > (target := max(cores, n_rows // MOST_PER_TASK + 1)):
        blocks = blocks.repartition(target)
    if checkpoint:
        checkpoint_root(data.sparkSession)
        blocks = blocks.checkpoint(eager=True)
    return blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _unpacked(rows, dim: int, scaled: bool = True):
    """(block, y, yf) of each packed row; a block holds until the next one is taken."""
    room = np.empty(0)
    for r in rows:
        b = _Packed(*r)
        if len(room) < (cells := b.n * len(b.cols) // 4):
            room = np.empty(cells)
        yield _Block(b, dim, scaled, room), np.frombuffer(b.y, np.int32), np.frombuffer(b.yf, np.int8).reshape(b.n, -1)


def fit_two_heads(train: DataFrame, objectives, dim: int = DEFAULT_DIM, iterations: int | None = None,
                  tol: float = 1e-3, feat_col: str = "features", y_col: str = "y_coarse", yf_col: str = "y_fine",
                  checkpoint: bool = True, valid: DataFrame | None = None, steps_per_epoch: int = 10,
                  monitor: str = "fine_macro_f1", patience: int = FV.PATIENCE) -> list[TwoHeadModel]:
    """One model per objective over the same rows; an evaluation of the blocks yields
    the losses and gradients of all models that are still open.

    With ``valid``, every ``steps_per_epoch`` accepted steps form an epoch: the valid
    split is scored (M6), its metrics are recorded, the weights with the best
    ``monitor`` value are kept (W1), and a model ends after ``patience`` epochs without
    improvement (W2). Otherwise it ends when its gradient's norm has fallen to the share
    ``tol`` of the first one; ``iterations`` is an optional budget of steps.

    The packed blocks are written once to the shared checkpoint folder (lineage
    cut, so a lost executor does not recompute features mid-training) and
    kept in memory for the evaluations."""
    spark = train.sparkSession
    data = train.select(feat_col, F.col(y_col).cast("int").alias("y"), F.col(yf_col).alias("yf"))
    labels = data.select("y", "yf")
    counts = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_total = float(sum(counts.values()))
    # Every evaluation is one pass over the blocks: spread small inputs (one file is one
    # partition) over the cores, at about ROWS_PER_TASK rows per partition.
    target = min(spark.sparkContext.defaultParallelism, max(1, int(n_total) // ROWS_PER_TASK))
    if data.rdd.getNumPartitions() < target:
        data = data.repartition(target)
    blocks = _kept_blocks(data, feat_col, dim, checkpoint, int(n_total))
    cw, pw = np.ones(N_COARSE), np.ones(N_FINE)
    if n_total and any(o.weighted for o in objectives):
        cw = np.array(_collect_weights(class_weights(labels, "y", list(range(N_COARSE))), "class_ord", N_COARSE))
        yf = labels.select([F.col("yf")[j].alias(f"f{j}") for j in range(N_FINE)])
        pw = np.array(_collect_weights(pos_weights(yf, [f"f{j}" for j in range(N_FINE)]), "label_ord", N_FINE))
    terms = []  # what head_gradients takes beside the rows, per model
    for o in objectives:
        c, p = (cw, pw) if o.weighted else (np.ones(N_COARSE), np.ones(N_FINE))
        terms.append((c, p, n_total, float(sum(c[k] * v for k, v in counts.items())), o.lambda_fine, o.lambda_hier))

    # Partial gradients are merged on executors in a tree once there are many
    # partitions; a few come to the driver as they are.
    def summed(rdd, add):
        return rdd.treeReduce(add) if rdd.getNumPartitions() > 32 else reduce(add, rdd.collect())

    def evaluate(points: dict):
        """{model: (loss, gradient)} at one point each, in one job."""
        models = list(points)
        sent = spark.sparkContext.broadcast(np.concatenate([points[m] for m in models]))

        def partial(rows):
            W = sent.value
            G, losses = np.zeros_like(W), np.zeros(len(models))
            for block, y, Y in _unpacked(rows, dim):
                Y = Y.astype(float)
                Z, dZ = block.outputs(W), []
                for i, m in enumerate(models):
                    own = Z[:, i * N_OUT:(i + 1) * N_OUT]
                    loss, d = head_gradients(own[:, :N_COARSE], own[:, N_COARSE:], y, Y, *terms[m])
                    losses[i] += loss
                    dZ.append(d)
                G += block.gradient(np.concatenate(dZ, axis=1))
            yield G, losses

        G, losses = summed(blocks.mapPartitions(partial), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        sent.unpersist()
        G = G.reshape(len(models), N_OUT, dim + 1)
        return {m: (float(losses[i]), G[i]) for i, m in enumerate(models)}

    if valid is not None:
        held = _kept_blocks(valid.select(feat_col, F.coalesce(F.col(y_col).cast("int"), F.lit(NO_LABEL)).alias("y"), F.col(yf_col).alias("yf")), feat_col, dim, checkpoint, int(n_total))

    def tally(W):
        sent, threshold = spark.sparkContext.broadcast(W), FV.TWO_HEAD_THRESHOLD

        def partial(rows):
            start = np.zeros(6 + 2 * N_COARSE + 3 * N_FINE)
            yield sum((_tallies(block.outputs(sent.value), y, Y, threshold) for block, y, Y in _unpacked(rows, dim)), start)
        parts = held.mapPartitions(partial)
        out = summed(parts, lambda a, b: a + b) if parts.getNumPartitions() else _tallies(
            np.zeros((0, N_OUT)), np.zeros(0, int), np.zeros((0, N_FINE), int), threshold)
        sent.unpersist()
        return out

    solvers = [Lbfgs(np.zeros((N_OUT, dim + 1)), tol) for _ in objectives]
    looks = [_Selection(tally, monitor, patience) if valid is not None else None for _ in objectives]
    open_ = set(range(len(solvers))) if n_total else set()
    while open_:
        for m, (loss, grad) in evaluate({m: solvers[m].trial for m in sorted(open_)}).items():
            s, look = solvers[m], looks[m]
            accepted, steps = s.tell(loss, grad), len(s.trace) - 1
            ended = s.done or (accepted and iterations is not None and steps >= iterations)
            if look is not None and steps and ((accepted and steps % steps_per_epoch == 0) or (ended and steps % steps_per_epoch)):
                ended = look.look(s.x) or ended
            if ended:
                open_.discard(m)
            elif steps >= MAX_STEPS:
                raise RuntimeError(f"no convergence in {MAX_STEPS} steps: gradient norm {s.trace[-1][1]:.3g} of {s.trace[0][1]:.3g} at first")
    blocks.unpersist()
    if valid is not None:
        held.unpersist()
    out = []
    for o, s, look in zip(objectives, solvers, looks):
        W = s.trial if s.x is None else s.x
        model = TwoHeadModel(W, dim, bool(o.lambda_hier), [(i, t[0]) for i, t in enumerate(s.trace)], [t[1] for t in s.trace])
        if look is not None:
            model.weights = W if look.weights is None else look.weights
            model.records, model.best_epoch, model.stop_epoch = look.records, look.best_epoch, look.epoch
        out.append(model)
    return out


def fit_two_head(train: DataFrame, dim: int = DEFAULT_DIM, lambda_fine: float = 1.0, lambda_hier: float = 0.0,
                 weighted: bool = True, **options) -> TwoHeadModel:
    """M2 or M3 alone; see :func:`fit_two_heads`."""
    return fit_two_heads(train, [Objective(lambda_fine, lambda_hier, weighted and not lambda_hier)], dim, **options)[0]


def score_two_head(df: DataFrame, model: TwoHeadModel, feat_col: str = "features",
                   keep: tuple = ("doc_id",)) -> DataFrame:
    """M7: logits of both heads, vectorised per Arrow batch with broadcast weights."""
    spark = df.sparkSession
    bw = spark.sparkContext.broadcast(model.weights)
    dim = model.dim
    keep = list(keep)
    src = df.select(*keep, feat_col)
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", logits_coarse array<double>, logits_fine array<double>"

    def run(batches):
        W = bw.value
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            idx, row, val = _rows_matrix(pdf[feat_col])
            Z = _forward(W, dim, idx, row, val, n)
            out = pdf[keep].copy()
            out["logits_coarse"] = list(Z[:, :N_COARSE])
            out["logits_fine"] = list(Z[:, N_COARSE:])
            yield out

    return src.mapInPandas(run, schema)


def score_with(df: DataFrame, make_predict, input_col: str, n_outputs: int, n_inputs: int, out_col: str = "logits",
               batch_size: int = 1024) -> DataFrame:
    """M7 with a model of the user's: ``make_predict()`` loads it once per Python worker
    and returns a function from a batch (rows x ``n_inputs``) to scores (rows x
    ``n_outputs``)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType
    predict = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[n_inputs]])
    return df.withColumn(out_col, predict(F.col(input_col)))


def evaluate_two_head(scored: DataFrame, threshold: float = FV.TWO_HEAD_THRESHOLD) -> DataFrame:
    """M6: coarse + fine bundles as a long (head, metric, value) table."""
    def long(head, bundle):
        pairs = ", ".join(f"'{m}', {m}" for m in bundle.columns)
        return bundle.selectExpr(f"stack({len(bundle.columns)}, {pairs}) as (metric, value)").select(F.lit(head).alias("head"), "*")
    return long("coarse", coarse_metrics(scored, full=True)).unionByName(long("fine", fine_metrics(scored, threshold=threshold)))


# ---------------------------------------------------------------- M4 / M5: baseline classifier

@dataclass
class BaselineModel:
    weights: np.ndarray     # classes x features
    intercepts: np.ndarray

    @property
    def n_classes(self) -> int:
        return len(self.intercepts)


CG_STEPS = 250


def trust_region(x: np.ndarray, tols):
    """Newton's method in a trust region (the step by conjugate gradients) as a dialogue:
    yields (point, None) for the loss and gradient there, and (point, direction) for the
    product of the second derivative there with the direction. Returns {tol: point}, the
    first point whose gradient's norm is at most ``tol`` of the first one, or the last
    point if no step lowers loss or gradient in floating point."""
    loss, g = yield x, None
    found, first = {}, np.linalg.norm(g)
    radius = size = first
    for _ in range(MAX_STEPS):
        for tol in tols:
            if size <= tol * first:
                found.setdefault(tol, x)
        if len(found) == len(set(tols)):
            return found
        s, r = np.zeros_like(x), -g
        p, rr, at_edge = r, float((g * g).sum()), False
        for _ in range(CG_STEPS):
            if np.sqrt(rr) <= 0.1 * size:
                break
            Hp = yield x, p
            bend = float((p * Hp).sum())
            if bend <= 0:
                break
            a = rr / bend
            if np.linalg.norm(s + a * p) >= radius:
                sp, pp = float((s * p).sum()), float((p * p).sum())
                a, at_edge = (-sp + np.sqrt(max(sp * sp + pp * (radius ** 2 - float((s * s).sum())), 0.0))) / pp, True
            s, r = s + a * p, r - a * Hp
            if at_edge:
                break
            before, rr = rr, float((r * r).sum())
            p = r + (rr / before) * p
        hoped, moved = float((s * r).sum() - (g * s).sum()) / 2, np.linalg.norm(s)
        new_loss, new_g = yield x + s, None
        new_size, gained = np.linalg.norm(new_g), loss - new_loss
        rounding = hoped <= 1e-12 * max(abs(loss), 1e-300)
        if gained > 1e-4 * hoped or (rounding and new_size < size):
            x, loss, g, size = x + s, new_loss, new_g, new_size
        elif rounding:
            return {tol: found.get(tol, x) for tol in tols}
        if gained < 0.25 * hoped and not rounding:
            radius = moved / 4
        elif at_edge and gained > 0.75 * hoped:
            radius = max(radius, 3 * moved)
    raise RuntimeError(f"no convergence in {MAX_STEPS} steps: gradient norm {size:.3g} of {first:.3g} at first")


def fit_baselines(train: DataFrame, fits, label_col: str = "labels", features_col: str = "features") -> list[BaselineModel]:
    """M4: multinomial logistic regressions with MLlib's objective (mean log loss plus half
    ``reg_param`` times the squared weights of the standardised features, the intercepts
    free), one per (reg_param, tol, rows) of ``fits``; ``rows`` is a condition, or None for
    all rows of ``train``. A fit ends when its gradient's norm is ``tol`` of the first one.

    All fits share the scans of the rows, which are packed once; a scan yields the
    gradients, or second derivatives along a direction, that the open fits ask for. The
    driver holds some vectors of weights per fit, never rows."""
    spark = train.sparkSession
    start = train.select(features_col).first()
    if start is None:
        raise ValueError("no rows to fit")
    dim, subsets = start[0].size, list(dict.fromkeys(f[2] for f in fits))
    member = F.array(*[F.lit(1) if c is None else F.coalesce(F.expr(c).cast("int"), F.lit(0)) for c in subsets])
    data = train.select(features_col, F.coalesce(F.col(label_col).cast("int"), F.lit(-1)).alias("y"), member.alias("yf"))
    n_rows = train.count()
    target = min(spark.sparkContext.defaultParallelism, max(1, n_rows // ROWS_PER_TASK))
    if data.rdd.getNumPartitions() < target:
        data = data.repartition(target)
    blocks = _kept_blocks(data, features_col, dim, True, n_rows)

    def scan(partial):
        add = lambda a, b: [u + v for u, v in zip(a, b)]
        rdd = blocks.mapPartitions(partial)
        return rdd.treeReduce(add) if rdd.getNumPartitions() > 32 else reduce(add, rdd.collect())

    labels = data.groupBy("y", "yf").count().collect()  # a row per class and subset
    if min(r["y"] for r in labels) < 0:
        raise ValueError("labels must be 0 or more")

    def moments(rows):
        sums = np.zeros((2 * len(subsets), dim + 1))
        for block, _, of in _unpacked(rows, dim, False):
            of = of.astype(float)
            sums += np.concatenate([block.gradient(of), block.squared().gradient(of)])
        yield [sums]

    (sums,) = scan(moments)
    parts = []  # per subset: rows, classes, mean, 1 / deviation, scale of the intercepts, log counts
    for k in range(len(subsets)):
        counts = np.bincount([r["y"] for r in labels], weights=[r["count"] * r["yf"][k] for r in labels]).astype(float)
        counts = counts[:int(np.flatnonzero(counts).max(initial=-1)) + 1]
        n = counts.sum()
        if not n:
            raise ValueError("no rows to fit")
        mean = sums[k, :-1] / n
        var = np.maximum(sums[len(subsets) + k, :-1] - n * mean * mean, 0.0) / max(n - 1, 1)
        var[var <= 1e-12 * mean * mean] = 0.0
        inverse = np.divide(1.0, np.sqrt(var), out=np.zeros(dim), where=var > 0)
        share = counts / n
        parts.append((n, len(counts), mean, inverse, np.sqrt(np.maximum(share * (1 - share), 1e-4)), np.log1p(counts)))

    def raw(k, x):
        """Weights (classes x (dim + 1)) for the counts from those of the standardised features."""
        _, _, mean, inverse, scale, _ = parts[k]
        w = x[:, :-1] * inverse
        return np.concatenate([w, (x[:, -1] / scale - w @ mean)[:, None]], axis=1)

    def standardised(k, g):
        _, _, mean, inverse, scale, _ = parts[k]
        return np.concatenate([(g[:, :-1] - g[:, -1:] * mean) * inverse, (g[:, -1] / scale)[:, None]], axis=1)

    def evaluate(asked: dict):
        """{fit: answer} to the requests (point, direction or None), in one job."""
        wanted = [(of[m], raw(of[m], x), None if v is None else raw(of[m], v)) for m, (x, v) in asked.items()]
        sent = spark.sparkContext.broadcast([(k, parts[k][1], v is not None, np.concatenate([w] if v is None else [w, v])) for k, w, v in wanted])

        def partial(rows):
            requests = sent.value
            W = np.concatenate([w for *_, w in requests])
            sums, losses = np.zeros((sum(n for _, n, *_ in requests), dim + 1)), np.zeros(len(requests))
            for block, y, inside in _unpacked(rows, dim, False):
                Z, dZ, at = block.outputs(W), [], 0
                for i, (k, n, along, w) in enumerate(requests):
                    z, v, at = Z[:, at:at + n], Z[:, at + n:at + len(w)], at + len(w)
                    weight = inside[:, k].astype(float)[:, None]
                    p = _softmax(z)
                    if along:
                        dZ.append(weight * p * (v - (p * v).sum(axis=1, keepdims=True)))
                    else:
                        own = (y[:, None] == np.arange(n)).astype(float)
                        top = z.max(axis=1, keepdims=True)
                        losses[i] += float((weight[:, 0] * (np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - (z * own).sum(axis=1))).sum())
                        dZ.append(weight * (p - own))
                sums += block.gradient(np.concatenate(dZ, axis=1))
            yield [sums, losses]

        sums, losses = scan(partial)
        sent.unpersist()
        out, at = {}, 0
        for i, (m, (x, v)) in enumerate(asked.items()):
            n, n_cls = parts[of[m]][:2]
            g = standardised(of[m], sums[at:at + n_cls]) / n
            at, reg, ridge = at + n_cls, solved[m][0], x if v is None else v
            g[:, :-1] += reg * ridge[:, :-1]
            out[m] = g if v is not None else (float(losses[i]) / n + reg / 2 * float((x[:, :-1] ** 2).sum()), g)
        return out

    # fits that differ in their tolerance alone are points of one search
    solved = list(dict.fromkeys((reg, rows) for reg, _, rows in fits))
    of = [subsets.index(rows) for _, rows in solved]
    dialogues, asked, points = [], {}, {}
    for m, (reg, rows) in enumerate(solved):
        _, n_cls, _, _, scale, start = parts[of[m]]
        x = np.zeros((n_cls, dim + 1))
        x[:, -1] = (start - start.mean()) * scale
        dialogues.append(trust_region(x, sorted({t for r, t, s in fits if (r, s) == (reg, rows)}, reverse=True)))
        if (start > 0).sum() > 1:
            asked[m] = next(dialogues[m])
    while asked:
        for m, answer in evaluate(asked).items():
            try:
                asked[m] = dialogues[m].send(answer)
            except StopIteration as end:
                points[m] = end.value
                del asked[m]
    blocks.unpersist()

    out = []
    for reg, tol, rows in fits:
        m = solved.index((reg, rows))
        if m not in points:  # one class alone: it is certain, as in MLlib
            out.append(BaselineModel(np.zeros((parts[of[m]][1], dim)), np.where(parts[of[m]][5] > 0, np.inf, 0.0)))
            continue
        w = raw(of[m], points[m][tol])
        out.append(BaselineModel(w[:, :-1], w[:, -1] - w[:, -1].mean()))
    return out


def fit_baseline(train: DataFrame, label_col: str = "labels", features_col: str = "features",
                 reg_param: float = 0.0, tol: float = 1e-6) -> BaselineModel:
    """M4: one multinomial logistic regression; see :func:`fit_baselines`."""
    return fit_baselines(train, [(reg_param, tol, None)], label_col, features_col)[0]


def baseline_logits(model: BaselineModel, df: DataFrame, keep: tuple = ("row_key", "labels"),
                    n_classes: int | None = None, features_col: str = "features") -> DataFrame:
    """Raw scores as an array; classes the model never saw get -inf so every
    model scores the same label set."""
    sent = df.sparkSession.sparkContext.broadcast(np.concatenate([model.weights, model.intercepts[:, None]], axis=1))
    keep, n_out = list(keep), max(model.n_classes, n_classes or 0)
    src = df.select(*keep, features_col)
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches):
        W = sent.value
        for pdf in batches:
            Z = np.full((len(pdf), n_out), -np.inf)
            Z[:, :len(W)] = _forward(W, W.shape[1] - 1, *_rows_counts(pdf[features_col]), len(pdf))
            out = pdf[keep].copy()
            out["logits"] = list(Z)
            yield out

    return src.mapInPandas(run, schema)


def sweep_baseline(train: DataFrame, valid: DataFrame, reg_params=(0.0, 0.01, 0.1), tols=(1e-4, 1e-6),
                   label_col: str = "labels", features_col: str = "features", n_classes: int | None = None,
                   keep: tuple = ("row_key", "labels")):
    """M5: one fit per grid point, fitted together; returns [(param dict, valid logits
    DataFrame)] in grid order."""
    grid = [(reg, tol) for reg in reg_params for tol in tols]
    models = fit_baselines(train, [(reg, tol, None) for reg, tol in grid], label_col, features_col)
    return [({"regParam": reg, "tol": tol}, baseline_logits(model, valid, keep, n_classes, features_col))
            for (reg, tol), model in zip(grid, models)]
