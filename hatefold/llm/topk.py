"""Exact top-k inner-product search as a Voronoi kNN join.

Pivots (a bounded sample of the vectors) split the vectors into Voronoi groups by
Euclidean distance, and each group into blocks of similar distance to the pivot,
of at most ``block_rows`` vectors. A block's summary is its pivot p and its largest
distance r to it, so that q.x <= q.p + |q| r for every x in it. The pivots are
vectors of the table themselves: the k-th best pivot score is a lower bound of a
query's k-th best score. Queries are grouped by their nearest pivot and sent only to
blocks whose upper bound reaches that lower bound; their vectors follow once that is
known. Each block is solved for some thousand queries at a time, and the partial results
meet in one window per query.

Of equal vectors only the k + 1 smallest ids can be among the k best (ties go to
the smaller id, one may be the query itself), and only k rows of each; the others are
dropped before any block is formed. Rows are first counted by vector and id, and the
ids limited in front of the shuffle by vector, so one very common vector is no hot group.

Cases: components become floor(scale * x); vectors that are null, empty, or hold
null or non-finite components take no part, nor rows with a null id; only vectors
of equal length are compared; a row with the query's id is the query's own, repeated
rows included; repeated query rows are one query, and an id with several vectors is a
query for each; other columns are not read; an empty table gives no rows. Scores are
exact while |component| < 2**53 and every product sum fits in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import written

RESULT = "uid long, query_id long, vec_id long, score long"


def integer_vectors(vectors, id_col: str, vector_col: str, scale: float):
    """(vec_id, v array<long>) of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")))


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as int64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _by_length(batch):
    """(ids, matrix) per vector length of a batch (vec_id, v)."""
    n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(n):
        part = batch.filter(pa.array(n == d))
        yield int(d), part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, distance to it) of each row."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    near = ((p * p).sum(1)[None] - 2.0 * (x @ p.T)).argmin(1)
    return near, np.sqrt(((x - p[near]) ** 2).sum(1))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where that is exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def topk(vectors, queries, k: int = 10, scale: float = 1024.0, n_pivots: int = 256, block_rows: int = 2048,
         queries_per_task: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"):
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest
    inner product with each row of ``queries``, the query's own row aside.

    ``n_pivots`` bounds the pivots of one vector length that are sent to all tasks.
    """
    data = integer_vectors(vectors, id_col, vector_col, scale)
    data = (data.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
            .select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.least("rows", F.lit(k)).cast("int"))).alias("copy")).drop("copy"))
    data = written(data, "vectors")
    # a query has a number of its own, as an id may have several vectors; it is written before it is used
    asked = written(integer_vectors(queries, id_col, vector_col, scale).distinct().withColumn("uid", F.monotonically_increasing_id()), "queries")

    # bounded: n_pivots rows for each of at most 16 vector lengths (the others form one group each)
    lengths = [r[0] for r in data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(16).collect()]
    sample = [r for d in lengths for r in data.filter(F.size("v") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()]
    sampled = {d: (np.array([r.vec_id for r in sample if len(r.v) == d], np.int64),
                   np.array([r.v for r in sample if len(r.v) == d], np.int64)) for d in lengths}
    pivots = {d: np.unique(v, axis=0) for d, (_, v) in sampled.items()}

    def groups(batches):
        for b in batches:
            for d, ids, x in _by_length(b):
                p = pivots[d] if d in pivots else np.zeros((1, d), np.int64)
                near, far = _nearest(x, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), d), pa.int64()), pa.array(near.astype(np.int64)), pa.array(far), pa.array(ids, pa.int64()),
                     pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())], names=["d", "pivot", "far", "vec_id", "x"])

    dealt = data.mapInArrow(groups, "d long, pivot long, far double, vec_id long, x binary")

    def blocks(batches):
        """Packs the rows of one sorted partition: a group's next block begins after block_rows rows."""
        from pyspark import TaskContext

        serial, held, key = TaskContext.get().partitionId() << 32, [], None

        def out():
            ids, far = np.array([h[1] for h in held], np.int64), max(h[0] for h in held)
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in (
                (serial, pa.int64()), (key[0], pa.int64()), (key[1], pa.int64()), (far * (1 + 1e-9) + 1e-6, pa.float64()), (ids.tobytes(), pa.binary()),
                (b"".join(h[2] for h in held), pa.binary()))], names=["block", "d", "pivot", "radius", "ids", "x"])

        for b in batches:
            for d, pivot, far, vec, x in zip(*(b.column(c).to_pylist() for c in range(5))):
                if held and (key != (d, pivot) or len(held) >= block_rows):
                    yield out()
                    serial, held = serial + 1, []
                key = (d, pivot)
                held.append((far, vec, x))
        if held:
            yield out()

    packed = written(dealt.repartitionByRange("d", "pivot", "far", "vec_id").sortWithinPartitions("d", "pivot", "far", "vec_id")
                     .mapInArrow(blocks, "block long, d long, pivot long, radius double, ids binary, x binary"), "vector-blocks")
    # per (length, pivot): the radii of its blocks; the summaries take 24 bytes for block_rows vectors
    summaries = packed.groupBy("d", "pivot").agg(F.sort_array(F.collect_list(F.struct("radius", "block"))).alias("blocks"))

    def bounds(batches):
        """A row per (query, pivot) with the radius from which a block can hold a result."""
        for b in batches:
            uids = b.column(2).to_numpy()
            lengths_ = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d, ids, q in _by_length(b):
                uid = uids[lengths_ == d]
                p = pivots[d] if d in pivots else np.zeros((1, d), np.int64)
                group, _ = _nearest(q, p)
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                to_pivot = _scores(q, p)
                floor = np.full(len(ids), -np.inf)
                if d in sampled:
                    s_ids, s = sampled[d]
                    have = _scores(q, s).astype(np.float64)
                    have[ids[:, None] == s_ids[None]] = -np.inf
                    if len(s_ids) >= k:
                        floor = np.partition(have, -k, axis=1)[:, -k]
                least = (floor[:, None] - to_pivot) / np.maximum(norm, 1e-12)[:, None]
                least = np.where(norm[:, None] == 0, np.where(floor[:, None] <= 0, -np.inf, np.inf), least - np.abs(least) * 1e-9 - 1e-6)
                for j in range(len(p)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), d), pa.int64()), pa.array(np.full(len(ids), j), pa.int64()), pa.array(group.astype(np.int64)),
                         pa.array(uid), pa.array(least[:, j])], names=["d", "pivot", "q_group", "uid", "least"])

    wanted = asked.select("vec_id", "v", "uid").mapInArrow(bounds, "d long, pivot long, q_group long, uid long, least double")
    sent = (wanted.join(summaries, ["d", "pivot"])
            .select("uid", "q_group", F.explode(F.filter("blocks", lambda x: x["radius"] >= F.col("least"))["block"]).alias("block")))
    sent = written(sent, "queries-of-blocks")
    return _solve(packed, sent, asked.select("uid", F.col("vec_id").alias("query_id"), "v"), k, queries_per_task)


def _solve(packed, sent, asked, k, queries_per_task):
    """The k best of each (query, block), then of each query. A block that many queries
    reach is solved in parts of about ``queries_per_task`` of them."""
    parts = sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / queries_per_task).alias("parts"))
    sent = sent.join(parts, "block").select("uid", "q_group", "block", F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part")).join(asked, "uid")
    packed = packed.join(parts, "block").select(*packed.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def solve(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"uid": pd.Series([], dtype="int64"), "query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})
        if not len(data) or not len(asked):
            return none
        d = int(data["d"].iloc[0])
        x = np.frombuffer(data["x"].iloc[0], np.int64).reshape(-1, d)
        ids = np.frombuffer(data["ids"].iloc[0], np.int64)
        asked = asked.sort_values(["q_group", "query_id"])
        out = []
        for i in range(0, len(asked), 512):
            part = asked.iloc[i:i + 512]
            q = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(-1, d)
            scores = _scores(q, x)
            for uid, query, row in zip(part["uid"].tolist(), part["query_id"].tolist(), scores):
                other = np.flatnonzero(ids != query)
                at = other[best(row[other], ids[other], k)]
                out.append((np.full(len(at), uid), np.full(len(at), query), ids[at], row[at]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(none.columns)}) if out else none

    near = packed.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInPandas(solve, RESULT)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
