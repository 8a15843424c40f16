"""Readers and writers (IO1-IO10). Schemas are always pinned, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lexicon import LEXICON_SCHEMA, parse_count
from ..operators.ranking import numbered
from .splitting import split_csv, split_json_object


def _text_reader(spark: SparkSession, schema: T.StructType, sep: str, multi_line: bool):
    # Quoted fields that hold newlines need multiLine, which makes a file one
    # task; without such fields, turn it off and files are split (``split`` splits
    # them all the same). A UTF-8 BOM on the header is stripped by Spark's CSV source.
    return (spark.read.schema(schema).option("header", True).option("sep", sep)
            .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
            .option("encoding", "UTF-8").option("mode", "FAILFAST"))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, split: bool = False) -> DataFrame:
    """IO1: tab-separated corpus with a header; ``split``: many tasks for each file,
    quoted newlines or not (``splitting``)."""
    if split:
        return split_csv(spark, path, schema, "\t")
    return _text_reader(spark, schema, "\t", multi_line).csv(path)


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, split: bool = False) -> DataFrame:
    """IO2 / IO3: comma-separated corpus, with or without a BOM; ``split`` as in ``read_tsv``."""
    if split:
        return split_csv(spark, path, schema)
    return _text_reader(spark, schema, ",", multi_line).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """IO5: parquet by default; CSV keeps a header and quotes as needed."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        # Keep surrounding whitespace of values (the writer trims by default).
        (w.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
         .option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))
    else:
        w.format(fmt).save(path)


def write_counted(df: DataFrame, path: str, counted: dict, fmt: str = "parquet") -> dict:
    """Writes ``df`` and returns the number of rows that meet each condition of
    ``counted`` (name -> Column), observed while writing: no second scan."""
    seen = Observation()
    df.observe(seen, *[F.count(F.when(c, 1)).alias(name) for name, c in counted.items()]).write.format(fmt).save(path)
    return seen.get


def convert_tsv(spark: SparkSession, src: str, dst: str, schema: T.StructType,
                partition_by: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """IO4: TSV corpus -> parquet table; returns the table as read back."""
    write_table(read_tsv(spark, src, schema, multi_line), dst, "parquet", partition_by)
    return spark.read.parquet(dst)


# A broken file raises instead of reading as an empty table.
_STRICT = {"mode": "FAILFAST"}

TERM_FREQ_SCHEMA = "map<string,string>"


def read_term_freq(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """IO6: one JSON object {term: count} per file -> (term, freq, pos).

    Each file is one task, or with ``split`` many: then positions count on over
    all files, in the order of their names."""
    if split:
        entries = split_json_object(spark, path)
        return (numbered(entries, [F.asc("file"), F.asc("split"), F.asc("place")], "pos")
                .select(F.col("key").alias("term"), parse_count(F.col("value")).alias("freq"), "pos"))
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", TERM_FREQ_SCHEMA, _STRICT).alias("m"))
    e = m.select(F.posexplode(F.map_entries("m")).alias("pos", "kv"))
    return e.select(F.col("kv.key").alias("term"), parse_count(F.col("kv.value")).alias("freq"),
                    F.col("pos").cast("long").alias("pos"))


def read_term_freq_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO6, splittable form: JSON lines {"term": ..., "count": ..., "pos": ...}."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("count", T.StringType()),
                           T.StructField("pos", T.LongType())])
    df = spark.read.schema(schema).options(**_STRICT).json(path)
    return df.select("term", parse_count(F.col("count")).alias("freq"), "pos")


_LEXICON_ENTRY = ("map<string,struct<canonical:array<string>,jamo:array<string>,"
                  "type:string,targets:array<string>>>")


def read_lexicon(spark: SparkSession, path: str | None, default: DataFrame | None = None) -> DataFrame:
    """IO7: a ``*.json`` file holding one object {seed: entry} (ordinal =
    position), or a folder of JSON lines in LEXICON_SCHEMA; falls back to
    ``default`` when the path is absent."""
    from pyspark.errors import AnalysisException
    try:
        if path is None:
            raise FileNotFoundError("no lexicon path")
        if path.endswith(".json"):
            raw = spark.read.text(path, wholetext=True)
            m = raw.select(F.from_json("value", _LEXICON_ENTRY, _STRICT).alias("m"))
            e = m.select(F.posexplode(F.map_entries("m")).alias("pos", "kv"))
            return e.select(F.col("kv.key").alias("seed"), F.col("pos").cast("long").alias("seed_ord"),
                            "kv.value.canonical", "kv.value.jamo", "kv.value.type", "kv.value.targets")
        return spark.read.schema(LEXICON_SCHEMA).options(**_STRICT).json(path)
    except (AnalysisException, FileNotFoundError) as e:
        absent = isinstance(e, FileNotFoundError) or e.getCondition() == "PATH_NOT_FOUND"
        if default is None or not absent:
            raise
        return default


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """IO8: JSON lines, one seed per line."""
    lexicon.select(*LEXICON_SCHEMA.fieldNames()).write.mode("overwrite").json(path)
