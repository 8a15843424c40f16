"""Bindings of the operators' inputs to the driver tables.

Each function takes (spark, sf_dir) and returns a lazily planned DataFrame
read from the parquet tables; ``hatefold.plans.oracle_views`` holds the same
definitions as DuckDB SQL for the correctness oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexicon import LEXICON_SCHEMA
from . import fixed_values as FV

# Fixture word list W (input data for the lexicon operators; see FIXTURES.md).
WORDS = ["trash", "idiot", "clown", "scum", "worthless",
         "moron", "pathetic", "loser", "stupid", "disgusting"]
WORD_TYPES = ["profanity"] * 5 + ["slur_a"] * 3 + ["abuse_general"] * 2

# Stand-in label scheme for the macro/micro corpus: language -> target column.
LANG_TARGETS = [("en", "target_en"), ("de", "target_de"), ("es", "target_es"), ("fr", "target_fr")]
AUX_LABELS = [t for _, t in LANG_TARGETS] + ["insult", "clean"]
AUX_CROSSWALK = [("hate", lang, target) for lang, target in LANG_TARGETS] + [
    ("insult", None, "insult"), ("neutral", None, "clean")]
AUX_PRIORITY = [(t, i + 2) for i, (_, t) in enumerate(LANG_TARGETS)] + [("insult", 1), ("clean", 0)]
AUX_ID2LABEL = {i: t for t, i in AUX_PRIORITY}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5 stand-in: labelled documents with coarse class and 8 fine tags."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    text = F.lower(F.col("text"))
    hate = (F.when(F.col("toxic") == 0, "clean")
            .when(F.col("quality") == 1, "offensive").otherwise("hate"))
    fine = {}
    for j, col in enumerate(FV.FINE_COLS[:7]):
        fine[col] = F.coalesce(text.contains(WORDS[j]), F.lit(False)).cast("int")
    any_rest = text.contains(WORDS[7]) | text.contains(WORDS[8]) | text.contains(WORDS[9])
    fine[FV.FINE_COLS[7]] = F.coalesce(any_rest, F.lit(False)).cast("int")
    return (docs.join(labels, "doc_id")
            .select("doc_id", text.alias("text"), hate.alias("hate_label"), "source",
                    *[v.alias(k) for k, v in fine.items()]))


def macro_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2 stand-in: every document with a macro label and a micro label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic",
                                                   F.lit(True).alias("_lab"))
    macro = (F.when(F.col("_lab").isNull(), "unknown")
             .when((F.col("toxic") == 1) & (F.col("quality") == 0), "insult")
             .when(F.col("toxic") == 1, "hate")
             .when(F.col("toxic") == 0, "neutral"))
    return (docs.join(labels, "doc_id", "left")
            .select("doc_id", F.col("text").alias("comment"), macro.alias("macrolabel"),
                    F.col("lang").alias("microlabel")))


def lexicon(spark: SparkSession) -> DataFrame:
    """FX8 stand-in: one seed per word, canonical = [word, word + 's']."""
    rows = [(w, i, [w, w + "s"], [], WORD_TYPES[i], []) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


#: A lexicon that occurs in the messages: this many of their most frequent words of
#: five letters or more, each with its first four letters as a second form.
TALK_WORDS = 10


def talk_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lexicon import mine_terms
    words = mine_terms(table(spark, sf_dir, "conversations")).where(F.length("term") >= 5)
    top = [r["term"] for r in words.orderBy(F.desc("freq"), "term").limit(TALK_WORDS).collect()]
    return spark.createDataFrame([(w, i, [w, w[:4]], [], "profanity", []) for i, w in enumerate(top)], LEXICON_SCHEMA)


def scored(spark: SparkSession, sf_dir: str, coarse_from: int = 1, fine_from: int = 4) -> DataFrame:
    """FX9 stand-in from embeddings (1-based dims): 3 coarse and 8 fine logits,
    y_coarse = label % 3, y_fine[j] = dim(12 + j) > 0."""
    e = table(spark, sf_dir, "embeddings")
    dbl = lambda a: F.transform(a, lambda x: x.cast("double"))
    return e.select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 3).cast("int").alias("y_coarse"),
        F.transform(F.slice("embedding", 12, 8), lambda x: (x > 0).cast("int")).alias("y_fine"),
        dbl(F.slice("embedding", coarse_from, 3)).alias("logits_coarse"),
        dbl(F.slice("embedding", fine_from, 8)).alias("logits_fine"),
        F.col("label").alias("y10"),
    )


def scored_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, coarse_from=21, fine_from=24)


def logits10(spark: SparkSession, sf_dir: str, first_dim: int = 1) -> DataFrame:
    """Ten-class baseline scores from embeddings: logits = dims first..first+9."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("y"),
                    F.transform(F.slice("embedding", first_dim, 10), lambda x: x.cast("double"))
                    .alias("logits"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX11 stand-in over the whole events table: run = user, epoch = day
    index (1-based), metric = best value of the day. (FIXTURES.md binds an id
    subset of events; registered queries must read whole tables, so the
    binding is re-aimed, and grows with the data.)"""
    ev = table(spark, sf_dir, "events")
    epoch = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    return (ev.groupBy(F.col("user_id").alias("run_id"), epoch.alias("epoch"))
            .agg(F.max("value").alias("metric")))


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-batch train losses: run = event type, epoch = day, loss = value,
    batch rows = props.k."""
    ev = table(spark, sf_dir, "events")
    epoch = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    return ev.select(F.col("event_type").alias("run_id"), epoch.alias("epoch"),
                     F.col("value").alias("loss"),
                     F.get_json_object("props", "$.k").cast("long").alias("n_rows"))


def rounded(df, digits: int = 6):
    """Doubles at the precision that the oracles compare."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
