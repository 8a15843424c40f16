"""Stratified, leak-free splits (S5, S6) with exact part sizes.

Part sizes are the largest-remainder share of all rows. As in a chain of two-way
splits, each part in turn takes its seats from the classes in proportion to what
they have left, again by largest remainder (ties by class), so every part gets its
size even when classes are too small to be divided one by one.

Inside a class, rows are ordered by a keyed hash (md5 of seed:id) and then by id,
and the parts are stretches of that order: the result does not depend on
partitioning. No window ranks a whole class. A first aggregation counts rows per
(class, hash bucket), which locates each cut in one bucket; a second reads the rows
of those few buckets and finds the cut rows themselves. Both read only class and
id. The rows are then assigned in one pass, by comparison with their class's cuts
(one row per class, broadcast). Ids are expected to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keyed import hash_order_key
from ..plans import fixed_values as FV

BUCKET_HEX = 4


def largest_remainder(total: int, weights: list[int]) -> list[int]:
    """``total`` seats in proportion to ``weights``; seats left over go to the
    largest remainders, ties to the first."""
    whole = sum(weights)
    if not whole:
        return [0] * len(weights)
    seats = [total * w // whole for w in weights]
    by_rest = sorted(range(len(weights)), key=lambda k: (-(total * weights[k] % whole), k))
    for k in by_rest[:total - sum(seats)]:
        seats[k] += 1
    return seats


def class_cuts(counts: list[int], ratios: list[int]) -> list[list[int]]:
    """Per class (in class order): the ranks at which its second, third, ... part begins."""
    left, cuts = list(counts), [[] for _ in counts]
    for size in largest_remainder(sum(counts), ratios)[:-1]:
        for k, seats in enumerate(largest_remainder(size, left)):
            left[k] -= seats
            cuts[k].append(counts[k] - left[k])
    return cuts


def stratified_split(df: DataFrame, class_col: str, id_col: str,
                     ratios=FV.THREE_WAY_RATIOS, names=FV.SPLIT_NAMES_3, seed: int = 42,
                     out_col: str = "split", bucket_hex: int = BUCKET_HEX) -> DataFrame:
    ratios, names = list(ratios), list(names)
    if len(ratios) != len(names):
        raise ValueError("ratios and names differ in length")
    spark = df.sparkSession
    order = hash_order_key(F.lit(seed), F.col(id_col))
    keyed = df.select(F.col(class_col).alias("cls"), order.alias("h"), F.col(id_col).alias("id"))
    bucket = F.substring("h", 1, bucket_hex)
    counts = keyed.groupBy("cls", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("cls").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cache()
    # One row per class: bounded by the label scheme.
    sizes = [(r.cls, r.n) for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()]
    sizes.sort(key=lambda x: (x[0] is None, x[0]))
    ranks = [(c, k, at) for (c, n), cuts in zip(sizes, class_cuts([n for _, n in sizes], ratios))
             for k, at in enumerate(cuts) if at < n]
    cls_type = df.schema[class_col].dataType
    wanted = spark.createDataFrame(ranks, T.StructType([T.StructField("c", cls_type), T.StructField("k", T.IntegerType()),
                                                        T.StructField("at", T.LongType())]))
    places = (counts.join(F.broadcast(wanted), F.col("cls").eqNullSafe(F.col("c")))
              .filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
              .select("c", "k", (F.col("at") - F.col("before") + 1).alias("rank"), F.col("b").alias("in_b")).collect())
    counts.unpersist()
    places = spark.createDataFrame(places, T.StructType([*wanted.schema.fields[:2], T.StructField("rank", T.LongType()),
                                                         T.StructField("in_b", T.StringType())]))
    found = (keyed.withColumn("b", bucket)
             .join(F.broadcast(places.select("c", "in_b").distinct()), F.col("cls").eqNullSafe(F.col("c")) & (F.col("b") == F.col("in_b")))
             .select("cls", "b", "h", "id").withColumn("r", F.row_number().over(Window.partitionBy("cls", "b").orderBy("h", "id")))
             .join(F.broadcast(places), F.col("cls").eqNullSafe(F.col("c")) & (F.col("b") == F.col("in_b")) & (F.col("r") == F.col("rank")))
             .select("cls", "k", "h", "id").collect())
    at = {(r.cls, r.k): (r.h, r.id) for r in found}
    # A part that begins at the class's end has the cut "~", after every hash.
    rows = [(c, [at.get((c, k), ("~", None)) for k in range(len(names) - 1)]) for c, _ in sizes]
    cut = T.StructType([T.StructField("h", T.StringType()), T.StructField("id", df.schema[id_col].dataType)])
    cuts = spark.createDataFrame(rows, T.StructType([T.StructField("_cut_cls", cls_type), T.StructField("_cuts", T.ArrayType(cut))]))
    me = F.struct(order.alias("h"), F.col(id_col).alias("id"))
    part = F.aggregate("_cuts", F.lit(0), lambda s, x: s + (me >= x).cast("int"))
    name_arr = F.array(*[F.lit(n) for n in names])
    return (df.join(F.broadcast(cuts), F.col(class_col).eqNullSafe(F.col("_cut_cls")))
            .withColumn(out_col, F.element_at(name_arr, part + 1)).drop("_cut_cls", "_cuts"))


def split_oracle_sql(view: str, class_col: str, id_col: str, ratios, names, seed: int = 42) -> str:
    """DuckDB twin: seats by ranking remainders, rows by a plain row_number per class."""
    values = ", ".join(f"({k}, {r})" for k, r in enumerate(ratios))
    steps, left = [], "n"
    for k in range(len(ratios) - 1):
        steps.append(f"""f{k} AS (SELECT *, {left} AS m{k}, size{k} * {left} // greatest(sum({left}) OVER (), 1) AS fl{k},
    size{k} * {left} % greatest(sum({left}) OVER (), 1) AS rem{k} FROM {'s0' if k == 0 else f'g{k - 1}, (SELECT size AS size{k} FROM parts WHERE k = {k})'}),
  g{k} AS (SELECT *, fl{k} + CAST(row_number() OVER (ORDER BY rem{k} DESC, _cls) <= size{k} - sum(fl{k}) OVER () AS INTEGER) AS q{k} FROM f{k})""")
        left = f"(m{k} - q{k})"
    cuts = [" + ".join(f"q{j}" for j in range(k + 1)) for k in range(len(ratios) - 1)]
    part = " + ".join(f"CAST(rk >= {c} AS INTEGER)" for c in cuts) or "0"
    name_list = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""(WITH c AS (SELECT {class_col} AS _cls, count(*) AS n FROM {view} GROUP BY 1),
  ratio AS (SELECT * FROM (VALUES {values}) v(k, r)),
  share AS (SELECT k, total * r // whole AS fl, total * r % whole AS rem, total
            FROM ratio, (SELECT CAST(sum(n) AS BIGINT) AS total FROM c), (SELECT sum(r) AS whole FROM ratio)),
  parts AS (SELECT k, fl + CAST(row_number() OVER (ORDER BY rem DESC, k) <= total - sum(fl) OVER () AS INTEGER) AS size FROM share),
  s0 AS (SELECT c.*, size AS size0 FROM c, parts WHERE k = 0),
  {', '.join(steps)},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {class_col} ORDER BY md5(concat_ws(':', {seed}, {id_col})), {id_col}) - 1 AS rk FROM {view})
SELECT ranked.*, {name_list}[CAST({part} AS INTEGER) + 1] AS split
FROM ranked JOIN g{len(ratios) - 2} ON ranked.{class_col} IS NOT DISTINCT FROM _cls)"""
