"""Registered queries: source/sink round trips over data Spark derives from the
driver tables (written under the session's checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import history as H
from ..operators import lexicon as LX
from ..operators import metrics as M
from ..operators.ranking import numbered
from ..session import scratch_path
from ..sources import io as IO
from . import bindings as B
from . import fixed_values as FV
from .oracle_views import with_views
from .q_lexicon import _CLEAN_SQL, _MERGE_SQL, _data_rules
from .q_metrics import _fine_sql

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


POSTS_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("hate_label", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in FV.FINE_COLS])


@register("csv_roundtrip", with_views("posts") + f"SELECT doc_id, text, hate_label, {', '.join(FV.FINE_COLS)} FROM posts")
def csv_roundtrip(spark, sf_dir):
    """IO2 / IO3 / IO5: posts written as CSV (quoted newlines) and read back."""
    path = scratch_path(spark, "posts-csv")
    posts = B.posts(spark, sf_dir).select(*POSTS_SCHEMA.fieldNames())
    IO.write_table(posts, path, "csv")
    return IO.read_posts_csv(spark, path, POSTS_SCHEMA)


@register("csv_split_read", with_views("posts") + f"SELECT doc_id, text, hate_label, {', '.join(FV.FINE_COLS)} FROM posts")
def csv_split_read(spark, sf_dir):
    """IO2 / IO3: the same with files that several tasks read, quoted newlines and all."""
    path = scratch_path(spark, "posts-csv")
    IO.write_table(B.posts(spark, sf_dir).select(*POSTS_SCHEMA.fieldNames()), path, "csv")
    return IO.read_posts_csv(spark, path, POSTS_SCHEMA, split=True)


@register("term_object_split_read", with_views("posts") + """
SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) - 1 AS pos
FROM (SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM posts) GROUP BY 1)
""")
def term_object_split_read(spark, sf_dir):
    """IO6: one JSON object with every term of the posts, read by several tasks."""
    path = scratch_path(spark, "terms-object")
    terms = numbered(LX.mine_terms(B.posts(spark, sf_dir)), [F.desc("freq"), F.asc("term")], "pos")
    last = terms.agg(F.max("pos")).first()[0]
    entry = F.concat(F.when(F.col("pos") == 0, F.lit("{")).otherwise(F.lit("")), F.substring(F.to_json(F.create_map("term", "freq")), 2, 1 << 30))
    lines = terms.select("pos", F.when(F.col("pos") == last, entry).otherwise(F.concat(F.regexp_replace(entry, r"\}$", ""), F.lit(","))).alias("value"))
    lines.orderBy("pos").select("value").coalesce(1).write.text(path)  # one file, as the format has it
    return IO.read_term_freq(spark, path, split=True)


DOCS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                            T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])


@register("tsv_to_parquet", "SELECT doc_id, lang, source, text FROM documents")
def tsv_to_parquet(spark, sf_dir):
    """IO1 / IO4: documents as TSV, converted to a parquet table partitioned
    by source (so a source filter prunes partitions)."""
    tsv = scratch_path(spark, "docs-tsv")
    pq = scratch_path(spark, "docs-parquet")
    docs = B.table(spark, sf_dir, "documents").select(*DOCS_SCHEMA.fieldNames())
    IO.write_table(docs, tsv, "tsv")
    out = IO.convert_tsv(spark, tsv, pq, DOCS_SCHEMA, partition_by=["source"])
    return out.select("doc_id", "lang", "source", "text")


@register("term_freq_lines_roundtrip", _CLEAN_SQL)
def term_freq_lines_roundtrip(spark, sf_dir):
    """IO6 (splittable JSON lines) -> A5 cleaning."""
    path = scratch_path(spark, "term-freq")
    posts = B.posts(spark, sf_dir)
    terms = LX.mine_terms(posts.where(F.col("hate_label") != "clean"))
    terms.select("term", F.col("freq").cast("string").alias("count"),
                 F.lit(None).cast("long").alias("pos")).write.mode("overwrite").json(path)
    back = IO.read_term_freq_lines(spark, path)
    return LX.clean_terms(back, rules=_data_rules()).select("term", "freq")


@register("lexicon_json_roundtrip", _MERGE_SQL)
def lexicon_json_roundtrip(spark, sf_dir):
    """IO8 then IO7: merged lexicon written as JSON lines and read back."""
    path = scratch_path(spark, "lexicon")
    posts = B.posts(spark, sf_dir)
    mined = LX.clean_terms(LX.mine_terms(posts.where(F.col("hate_label") != "clean")), rules=_data_rules())
    IO.write_lexicon(LX.merge_lexicon(B.lexicon(spark), mined), path)
    back = IO.read_lexicon(spark, path)
    return back.select("seed", "seed_ord", "type", F.array_join("canonical", "|").alias("canonical"))


def _records_sql() -> str:
    cols = ", ".join(M.FINE_METRICS)

    def unpivot(run: str, view: str) -> str:
        return (f"SELECT '{run}' AS run_id, metric, value FROM ({_fine_sql(view)}) "
                f"UNPIVOT (value FOR metric IN ({cols}))")
    return unpivot("a", "scored") + "\nUNION ALL\n" + unpivot("b", "scored_b")


@register("metric_records", _records_sql())
def metric_records(spark, sf_dir):
    """IO9 / IO10: fine-metric bundles of two models appended as long records
    (run_id, epoch, split, head, metric, value), partitioned by run, read back."""
    path = scratch_path(spark, "metrics")
    stack = ", ".join(f"'{c}', {c}" for c in M.FINE_METRICS)
    for run, sc in (("a", B.scored(spark, sf_dir)), ("b", B.scored_b(spark, sf_dir))):
        bundle = B.rounded(M.fine_metrics(sc))
        rec = bundle.selectExpr(f"stack({len(M.FINE_METRICS)}, {stack}) as (metric, value)").select(
            F.lit(run).alias("run_id"), F.lit(1).alias("epoch"), F.lit("valid").alias("split"),
            F.lit("fine").alias("head"), "metric", "value")
        for _ in range(2):  # a run that is recorded again replaces its records
            H.append_metrics(rec, path)
    return spark.read.parquet(path).select("run_id", "metric", "value")
