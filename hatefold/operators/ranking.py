"""Consecutive numbers over a sorted table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def numbered(df: DataFrame, order: list, out_col: str = "rank", start: int = 0) -> DataFrame:
    """``df`` with ``out_col`` = ``start``, ``start`` + 1, ... in the order of the columns
    ``order`` (rows that tie on all of them in any order).

    Rows are dealt by range, sorted in their partitions and numbered there; the table
    is written, since the ranges come from a sample. The rows of each partition are
    counted, and the counts before a partition are its offset: one broadcast row per
    partition, whatever the size of the table."""
    place = "__place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")
    # The id holds the partition above 33 bits of the row's place in it.
    part, within = F.shiftright(F.col(place), 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    offsets, at = [], start
    for p, n in sorted(ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((p, at))
        at += n
    if not offsets:
        return ranged.select(*df.columns, F.lit(0).cast("long").alias(out_col))
    side = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    return (ranged.join(F.broadcast(side), part == F.col("__part"))
            .select(*df.columns, (F.col("__offset") + within).alias(out_col)))
