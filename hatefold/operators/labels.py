"""Label-scheme operators: harmonise, crosswalk, collapse, encode, filter (P1-P8,
P16, S1, IO11, A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..plans import fixed_values as FV

# A crosswalk is a label-scheme table; above this many rows it is joined
# without a broadcast hint.
MAX_BROADCAST_MAPPING = 100_000


def harmonize_columns(df: DataFrame, aliases: dict[str, str] = FV.COLUMN_ALIASES) -> DataFrame:
    """Rename alias columns that are present."""
    present = {a: c for a, c in aliases.items() if a in df.columns}
    return df.withColumnsRenamed(present) if present else df


def add_missing_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    """Add absent label columns as 0."""
    missing = {c: F.lit(0) for c in labels if c not in df.columns}
    return df.withColumns(missing) if missing else df


def project_corpus(df: DataFrame, text_col: str, labels: list[str], source: str,
                   keep: tuple = ()) -> DataFrame:
    """Text + label columns, tagged with its provenance."""
    return df.select(*keep, text_col, *[F.col(f"`{c}`").cast("int").alias(c) for c in labels],
                     F.lit(source).alias("source"))


def mapping_frame(spark: SparkSession, rows=FV.CROSSWALK) -> DataFrame:
    schema = T.StructType([T.StructField("macro", T.StringType(), False),
                           T.StructField("micro", T.StringType(), True),
                           T.StructField("target", T.StringType(), False)])
    return spark.createDataFrame(list(rows), schema)


def crosswalk_labels(df: DataFrame, mapping: DataFrame, labels: list[str],
                     macro_col: str = "macrolabel", micro_col: str = "microlabel") -> DataFrame:
    """macro/micro labels -> one-hot over ``labels``.

    Mapping rows with a micro value match that (macro, micro) pair; rows with a
    null micro match any micro of the macro. A specific match wins; anything
    unmatched becomes an all-zero row. A repeated mapping row counts once; two
    targets for one key raise."""
    n_map = mapping.count()

    def one_target(rows, *keys):
        lo, hi = F.min("target"), F.max("target")
        target = F.when(lo == hi, lo).otherwise(F.raise_error(F.concat_ws(
            " ", F.lit("conflicting crosswalk targets:"), lo, hi)))
        return rows.groupBy(*keys).agg(target.alias("t"))
    spec = one_target(mapping.where(F.col("micro").isNotNull()), "macro", "micro").toDF("_m1", "_u1", "_t1")
    gen = one_target(mapping.where(F.col("micro").isNull()), "macro").toDF("_m2", "_t2")
    if n_map <= MAX_BROADCAST_MAPPING:
        spec, gen = F.broadcast(spec), F.broadcast(gen)
    j = (df.join(spec, (df[macro_col] == spec["_m1"]) & (df[micro_col] == spec["_u1"]), "left")
         .join(gen, F.col(macro_col) == gen["_m2"], "left"))
    target = F.coalesce(F.col("_t1"), F.col("_t2"))
    out = j.withColumn("_target", target).drop("_m1", "_u1", "_t1", "_m2", "_t2")
    out = out.withColumns({c: F.coalesce((F.col("_target") == c).cast("int"), F.lit(0)) for c in labels})
    return out.drop("_target")


def collapse_labels(df: DataFrame, priority=FV.COLLAPSE_PRIORITY, label_col: str = "labels",
                    default: int = 0) -> DataFrame:
    """P5: multi-hot -> one id by fixed priority; a missing column is 'not set';
    an existing ``label_col`` is kept as is."""
    if label_col in df.columns:
        return df
    branches = [F.when(F.col(f"`{c}`") == 1, F.lit(i)) for c, i in priority if c in df.columns]
    return df.withColumn(label_col, F.coalesce(*branches, F.lit(default)).cast("int"))


def coarse_encode(col: Column, classes: list[str] = FV.COARSE_CLASSES, strict: bool = True) -> Column:
    """Class name -> id; unknown raises in strict mode, else null."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    looked = F.try_element_at(m, col)
    if not strict:
        return looked
    return F.when(looked.isNull(), F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(col, F.lit("null"))))
                  ).otherwise(looked).cast("int")


def pack_fine(cols: list[str] = FV.FINE_COLS) -> Column:
    """Fine label columns -> array<int>."""
    return F.array(*[F.col(c).cast("int") for c in cols])


def class_filter(df: DataFrame, classes: list[str], col: str = "hate_label") -> DataFrame:
    """Keep target classes; without the class column keep everything."""
    if col not in df.columns:
        return df
    return df.where(F.col(col).isin(*classes))


def skip_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip (Unicode whitespace, as str.strip) and drop blank texts."""
    s = py_strip(F.col(text_col))
    return df.withColumn(text_col, s).where(F.length(F.col(text_col)) > 0)


def union_corpora(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name (schemas must agree)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


TRAINING_MODES = {"main_only": ["main"], "combined": None}


def training_source(df: DataFrame, mode: str, source_col: str = "source",
                    modes: dict = TRAINING_MODES) -> DataFrame:
    """IO11: pick the training rows by mode (prunes partitions when the corpus
    is stored partitioned by ``source_col``); an unknown mode raises."""
    if mode not in modes:
        raise ValueError(f"Unknown train_mode: {mode}")
    sources = modes[mode]
    return df if sources is None else df.where(F.col(source_col).isin(*sources))


def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """A1: value counts, most frequent first."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))


def preview(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows by ``key`` (a distributed top-k; the limit is
    the feature)."""
    return df.orderBy(key).limit(n)
