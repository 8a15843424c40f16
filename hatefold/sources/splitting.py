"""Quoted records of one large file, read by many tasks.

A file is read in pieces between separators (lines of a CSV file, what stands between
commas of a JSON object), which the text source splits at any byte. A separator ends a
record if an even number of quotes precedes it in the file. So a first pass counts the
quotes of each split; the running sum over a file's splits (one small row each) tells
whether a split begins inside quotes; and in a second pass each task puts its pieces
together from there and writes the records once. Records that cross splits arrive as
fragments, two a split at most, and are joined by the split in which they begin. No text
is shuffled but these fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: A split's row is broadcast; this many splits of 128 MB are 128 TB.
MAX_SPLITS = 1_000_000

_WHOLE, _HEAD, _TAIL = 0, 1, 2
RECORDS = "file string, split long, place long, kind int, record string"


def _assemble(sep: str):
    """Pieces (file, split, value, quotes, inside) of a partition, in order -> records."""
    def run(batches):
        import pyarrow as pa
        here, parts, kind, inside, place = None, [], _WHOLE, False, 0

        def closed(which):
            return (*here, place, which, sep.join(parts))

        for b in batches:
            out = []
            for file, split, value, quotes, starts_inside in zip(*(b.column(c).to_pylist() for c in range(5))):
                if here != (file, split):
                    if here and parts:
                        out.append(closed(_TAIL if kind == _WHOLE else kind))
                    here, parts, place = (file, split), [], 0
                    inside = starts_inside
                    kind = _HEAD if inside else _WHOLE
                parts.append(value)
                inside ^= quotes % 2 == 1
                if not inside:
                    out.append(closed(kind))
                    parts, kind, place = [], _WHOLE, place + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                                             names=["file", "split", "place", "kind", "record"])
        if here and parts:  # inside quotes at the end of the split, or a split without a record's start
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(_TAIL if kind == _WHOLE else kind), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                                             names=["file", "split", "place", "kind", "record"])
    return run


def quoted_records(spark: SparkSession, path: str, sep: str, n_quotes) -> DataFrame:
    """(file, split, place, record): the records of all files at ``path``, in the order
    of these columns. ``n_quotes``: column of a piece -> its number of quotes. Raises on a
    file that ends inside quotes."""
    raw = spark.read.option("lineSep", sep).text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", n_quotes(F.col("value")).alias("quotes"))
    order = Window.partitionBy("file").orderBy("split")
    splits = pieces.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before % 2 == 1).alias("inside"), (F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1).alias("open"))
    rows = splits.limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes")
    unclosed = sorted({r["file"] for r in rows if r["open"]})
    if unclosed:
        raise ValueError(f"unclosed quotes in {unclosed[:3]}")
    known = spark.createDataFrame([(r["file"], r["split"], r["inside"]) for r in rows], "file string, split long, inside boolean")
    # Both passes must cut the files alike; a split that the first did not see is an error.
    found = pieces.join(F.broadcast(known), ["file", "split"], "left").select(
        "file", "split", "value", "quotes", F.coalesce("inside", F.raise_error(F.lit("the files were split otherwise in the second pass")).cast("boolean")).alias("inside"))
    records = written(found.mapInArrow(_assemble(sep), RECORDS), "records")
    whole = records.where(F.col("kind") == _WHOLE).select("file", "split", "place", "record")
    parts = records.where(F.col("kind") != _WHOLE)
    # A split without a record's start passes its one fragment on; heads come before tails.
    begins = F.last(F.when(F.col("kind") == _TAIL, F.struct("split", "place")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("split", "kind").rowsBetween(Window.unboundedPreceding, 0))
    joined = (parts.withColumn("at", begins).groupBy("file", "at")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "kind", "record"))), lambda x: x["record"]), sep).alias("record")))
    return whole.unionByName(joined.select("file", F.col("at.split").alias("split"), F.col("at.place").alias("place"), "record"))


def count_of(text, what: str):
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def split_csv(spark: SparkSession, path: str, schema, sep: str = ",") -> DataFrame:
    """CSV files with a header, quotes doubled inside quoted fields, which may hold
    newlines: the rows that ``multiLine`` gives, by many tasks a file. Records end with
    ``\\n`` or ``\\r\\n``; quotes stand only around fields, or doubled inside them."""
    records = quoted_records(spark, path, "\n", lambda v: count_of(v, '"'))
    body = records.where((F.col("split") != 0) | (F.col("place") != 0)).select(F.regexp_replace("record", "\r$", "").alias("record"))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.where(F.col("record") != "").select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


def split_json_object(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, key, value) of files that hold one JSON object with plain
    values each, by many tasks a file. Strict: raises on what is no such object."""
    # What follows a backslash is no quote; no separator stands between the two.
    records = quoted_records(spark, path, ",", lambda v: count_of(F.regexp_replace(v, r"\\(?s:.)", ""), '"'))
    # One row per file, and there are no more files than splits: broadcast.
    ends = F.broadcast(records.groupBy("file").agg(F.max(F.struct("split", "place")).alias("last")))
    rec, broken = F.col("record"), F.raise_error(F.concat(F.lit("no JSON object of plain values: "), F.substring("record", 1, 80))).cast("string")
    first, last = (F.col("split") == 0) & (F.col("place") == 0), F.struct("split", "place") == F.col("last")
    opened = F.when(~first, rec).when(rec.rlike(_OPEN), F.regexp_replace(rec, _OPEN, "")).otherwise(broken)
    r = records.join(ends, "file").select("file", "split", "place", "last", opened.alias("record"))
    closed = F.when(~last, rec).when(rec.rlike(_CLOSE), F.regexp_replace(rec, _CLOSE, "")).otherwise(broken)
    r = r.select("file", "split", "place", (first & last).alias("only"), closed.alias("record")).where(~(F.col("only") & rec.rlike(r"^\s*$")))
    plain = F.regexp_replace(rec, _STRING, '""').rlike(_ENTRY)
    entry = F.map_entries(F.from_json(F.concat(F.lit("{"), F.when(plain, rec).otherwise(broken), F.lit("}")), "map<string,string>", {"mode": "FAILFAST"}))
    return r.select("file", "split", "place", F.element_at(entry, 1).alias("e")).select("file", "split", "place", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


_OPEN, _CLOSE = r"^\x{FEFF}?\s*\{", r"\}\s*$"
_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
_ENTRY = r'^\s*""\s*:\s*(?:""|[^\s"{}\[\]]+)\s*$'
