import hashlib
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hatefold.operators import split as SP


def _seats(total, weights):
    """Largest remainder with exact fractions: {key: seats}."""
    whole = sum(weights.values())
    quota = {k: Fraction(total * w, whole) if whole else Fraction(0) for k, w in weights.items()}
    seats = {k: math.floor(q) for k, q in quota.items()}
    while whole and sum(seats.values()) < total:
        k = min((k for k in quota if seats[k] <= quota[k] and seats[k] == math.floor(quota[k])),
                key=lambda k: (seats[k] - quota[k], k))
        seats[k] += 1
    return seats


def _oracle(rows, ratios, names, seed):
    """A chain of two-way splits: each part draws its seats from the classes' rows that are left."""
    left = {}
    for rid, cls in rows:
        left.setdefault(cls, []).append(rid)
    for ids in left.values():
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    sizes, out = _seats(len(rows), dict(enumerate(ratios))), {}
    for k, name in enumerate(names):
        seats = _seats(sizes[k], {c: len(ids) for c, ids in left.items()})
        for cls, n in seats.items():
            out.update((rid, name) for rid in left[cls][:n])
            left[cls] = left[cls][n:]
    return out


def _split(df, **kw):
    return {r["id"]: r["split"] for r in SP.stratified_split(df, "cls", "id", **kw).collect()}


@pytest.mark.parametrize("bucket_hex", [1, 2, 4])
def test_split_equals_plain_ranking(spark, bucket_hex):
    rows = [(i, "a" if i % 10 < 6 else ("b" if i % 10 < 9 else "c")) for i in range(3000)] + [(5000, "d"), (5001, "d")]
    df = spark.createDataFrame(rows, "id long, cls string")
    assert _split(df, seed=11, bucket_hex=bucket_hex) == _oracle(rows, [80, 10, 10], ["train", "valid", "test"], 11)


def test_no_part_is_empty_with_many_small_classes(spark):
    rows = [(i, i % 10) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, cls int")
    got = _split(df, seed=5)
    assert got == _oracle(rows, [80, 10, 10], ["train", "valid", "test"], 5)
    assert sorted(list(got.values()).count(x) for x in ("train", "valid", "test")) == [5, 5, 40]


def test_split_quota_within_one(spark):
    rows = [(i, i % 7) for i in range(1234)]
    df = spark.createDataFrame(rows, "id long, cls int")
    out = SP.stratified_split(df, "cls", "id", ratios=(90, 10), names=("train", "valid"), seed=3)
    counts = {(r["cls"], r["split"]): r["n"] for r in out.groupBy("cls", "split").agg(F.count("*").alias("n")).collect()}
    for c in range(7):
        n = sum(1 for i, k in rows if k == c)
        assert abs(counts[(c, "train")] - 0.9 * n) <= 1
        assert abs(counts.get((c, "valid"), 0) - 0.1 * n) <= 1


def test_split_tolerates_tiny_null_and_no_classes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "id long, cls string")
    assert set(_split(df)) == {1, 2, 3, 4}
    assert _split(df.limit(0)) == {}


def test_sql_twin_on_many_small_classes(spark):
    import duckdb
    rows = [(i, f"c{i * i % 11}") for i in range(97)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in rows) + ") v(id, cls)")
    for ratios, names in (((80, 10, 10), ("train", "valid", "test")), ((90, 10), ("train", "valid"))):
        sql = SP.split_oracle_sql("t", "cls", "id", ratios, names, 7)
        assert dict(con.sql(f"SELECT id, split FROM {sql}").fetchall()) == _oracle(rows, ratios, names, 7)
