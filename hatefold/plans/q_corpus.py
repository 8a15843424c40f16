"""Registered queries: label schemes, corpus integration, splits, weights, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import labels as L
from ..operators import split as SP
from . import bindings as B
from . import fixed_values as FV
from .oracle_views import with_views

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _target_case() -> str:
    spec = [(m, u, t) for m, u, t in B.AUX_CROSSWALK if u is not None]
    gen = [(m, u, t) for m, u, t in B.AUX_CROSSWALK if u is None]
    whens = [f"WHEN macrolabel = '{m}' AND microlabel = '{u}' THEN '{t}'" for m, u, t in spec]
    whens += [f"WHEN macrolabel = '{m}' THEN '{t}'" for m, u, t in gen]
    return "CASE " + " ".join(whens) + " END"


def _label_cols_sql(target: str = "target") -> str:
    return ", ".join(f"CAST(coalesce({target} = '{c}', false) AS INTEGER) AS {c}" for c in B.AUX_LABELS)


def _collapse_sql() -> str:
    return "CAST(CASE " + " ".join(f"WHEN {c} = 1 THEN {i}" for c, i in B.AUX_PRIORITY) + " ELSE 0 END AS INTEGER)"


_XWALK_CTE = f"""xw AS (SELECT doc_id, comment, {_target_case()} AS target FROM macro_posts),
mh AS (SELECT doc_id, comment, {_label_cols_sql()} FROM xw)"""


def _aux(spark, sf_dir):
    mp = B.macro_posts(spark, sf_dir)
    mapping = L.mapping_frame(spark, B.AUX_CROSSWALK)
    return L.crosswalk_labels(mp, mapping, B.AUX_LABELS)


# ---------------------------------------------------------------- P4

@register("label_crosswalk", with_views("macro_posts") + "," + _XWALK_CTE + f"""
SELECT doc_id, {", ".join(B.AUX_LABELS)} FROM mh
""")
def label_crosswalk(spark, sf_dir):
    return _aux(spark, sf_dir).select("doc_id", *B.AUX_LABELS)


# ---------------------------------------------------------------- P5

_NAMES_SQL = "[" + ", ".join(f"'{B.AUX_ID2LABEL[i]}'" for i in range(len(B.AUX_ID2LABEL))) + "]"


@register("collapsed_labels", with_views("macro_posts") + "," + _XWALK_CTE + f"""
SELECT doc_id, {_collapse_sql()} AS labels, {_NAMES_SQL}[{_collapse_sql()} + 1] AS label_name FROM mh
""")
def collapsed_labels(spark, sf_dir):
    names = [B.AUX_ID2LABEL[i] for i in range(len(B.AUX_ID2LABEL))]
    c = L.collapse_labels(_aux(spark, sf_dir), B.AUX_PRIORITY)
    return c.select("doc_id", "labels", F.element_at(F.array(*[F.lit(n) for n in names]),
                                                    F.col("labels") + 1).alias("label_name"))


# ---------------------------------------------------------------- P1, P2, P3, S1, IO11

def _combined(spark, sf_dir):
    posts = B.posts(spark, sf_dir)
    # Main corpus in its own spelling: one target column under an alias name,
    # three target columns absent.
    main = posts.select("doc_id", "text",
                        (F.col("hate_label") == "offensive").cast("int").alias("target en"),
                        (F.col("hate_label") == "hate").cast("int").alias("insult"),
                        (F.col("hate_label") == "clean").cast("int").alias("clean"))
    main = L.harmonize_columns(main, {"target en": "target_en"})
    main = L.add_missing_labels(main, B.AUX_LABELS)
    main = L.project_corpus(main, "text", B.AUX_LABELS, "main", keep=("doc_id",))
    aux = L.project_corpus(_aux(spark, sf_dir).withColumnRenamed("comment", "text"), "text",
                           B.AUX_LABELS, "aux", keep=("doc_id",))
    return L.collapse_labels(L.union_corpora(main, aux), B.AUX_PRIORITY)


_COMBINED_CTE = with_views("posts", "macro_posts") + "," + _XWALK_CTE + f""",
main AS (
  SELECT doc_id, CAST(hate_label = 'offensive' AS INTEGER) AS target_en, 0 AS target_de, 0 AS target_es,
    0 AS target_fr, CAST(hate_label = 'hate' AS INTEGER) AS insult, CAST(hate_label = 'clean' AS INTEGER) AS clean,
    'main' AS source FROM posts),
comb AS (
  SELECT *, {_collapse_sql()} AS labels FROM (
    SELECT * FROM main UNION ALL SELECT doc_id, {", ".join(B.AUX_LABELS)}, 'aux' AS source FROM mh))
"""


@register("combined_corpus", _COMBINED_CTE + f"SELECT doc_id, source, labels, {', '.join(B.AUX_LABELS)} FROM comb")
def combined_corpus(spark, sf_dir):
    c = L.training_source(_combined(spark, sf_dir), "combined")
    return c.select("doc_id", "source", "labels", *B.AUX_LABELS)


@register("training_source_main", _COMBINED_CTE + "SELECT doc_id, source, labels FROM comb WHERE source = 'main'")
def training_source_main(spark, sf_dir):
    return L.training_source(_combined(spark, sf_dir), "main_only").select("doc_id", "source", "labels")


# ---------------------------------------------------------------- A1

@register("macro_distribution", with_views("macro_posts") +
          "SELECT macrolabel, count(*) AS count FROM macro_posts GROUP BY 1")
def macro_distribution(spark, sf_dir):
    return L.value_distribution(B.macro_posts(spark, sf_dir), "macrolabel")


@register("hate_label_distribution", with_views("posts") +
          "SELECT hate_label, count(*) AS count FROM posts GROUP BY 1")
def hate_label_distribution(spark, sf_dir):
    return L.value_distribution(B.posts(spark, sf_dir), "hate_label")


# ---------------------------------------------------------------- P6, P7

@register("coarse_fine_encoding", with_views("posts") + """
SELECT doc_id, CAST(CASE hate_label WHEN 'clean' THEN 0 WHEN 'offensive' THEN 1 WHEN 'hate' THEN 2 END AS INTEGER) AS label_coarse,
  array_to_string([""" + ", ".join(FV.FINE_COLS) + """], ',') AS label_fine
FROM posts
""")
def coarse_fine_encoding(spark, sf_dir):
    p = B.posts(spark, sf_dir)
    return p.select("doc_id", L.coarse_encode(F.col("hate_label")).alias("label_coarse"),
                    F.array_join(L.pack_fine().cast("array<string>"), ",").alias("label_fine"))


# ---------------------------------------------------------------- P8

@register("augmentation_targets", with_views("posts") +
          "SELECT doc_id, hate_label FROM posts WHERE hate_label IN ('hate', 'offensive')")
def augmentation_targets(spark, sf_dir):
    return L.class_filter(B.posts(spark, sf_dir), FV.OFFLINE_TARGET_CLASSES).select("doc_id", "hate_label")


# ---------------------------------------------------------------- P16

_WS = r"[\s\p{Z}\x{85}]"


@register("nonblank_messages", f"""
SELECT conv_id, turn, role, CAST(length(s) AS INTEGER) AS n_chars FROM (
  SELECT conv_id, turn, role, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS s FROM conversations)
WHERE length(s) > 0
""")
def nonblank_messages(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    return L.skip_blank(c, "text").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


# ---------------------------------------------------------------- S6, A22

_SPLIT3_SQL = with_views("posts") + "SELECT doc_id, hate_label, split FROM " + SP.split_oracle_sql(
    "posts", "hate_label", "doc_id", FV.THREE_WAY_RATIOS, FV.SPLIT_NAMES_3)


@register("split_assignment", _SPLIT3_SQL)
def split_assignment(spark, sf_dir):
    s = SP.stratified_split(B.posts(spark, sf_dir), "hate_label", "doc_id")
    return s.select("doc_id", "hate_label", "split")


@register("split_counts", with_views("posts") + "SELECT split, hate_label, count(*) AS n FROM "
          + SP.split_oracle_sql("posts", "hate_label", "doc_id", FV.THREE_WAY_RATIOS, FV.SPLIT_NAMES_3)
          + " GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    s = SP.stratified_split(B.posts(spark, sf_dir), "hate_label", "doc_id")
    return s.groupBy("split", "hate_label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- S5

def split_by_document(corpus, ratios=FV.TWO_WAY_RATIOS, names=FV.SPLIT_NAMES_2, seed: int = 42):
    """S5 over documents: a document is drawn by its smallest label id, and all its
    rows (the main and the aux copy) go to one part, so no text is in two parts."""
    docs = corpus.groupBy("doc_id").agg(F.min("labels").alias("stratum"))
    part = SP.stratified_split(docs, "stratum", "doc_id", ratios, names, seed).select("doc_id", "split")
    return corpus.join(part, "doc_id")


_BY_DOC_CTE = _COMBINED_CTE + ", docs AS (SELECT doc_id, min(labels) AS stratum FROM comb GROUP BY 1), part AS (SELECT doc_id, split FROM " + (
    SP.split_oracle_sql("docs", "stratum", "doc_id", FV.TWO_WAY_RATIOS, FV.SPLIT_NAMES_2)) + ")"


@register("two_way_split", _BY_DOC_CTE + """
SELECT source || ':' || comb.doc_id AS row_key, labels, split FROM comb JOIN part ON comb.doc_id = part.doc_id""")
def two_way_split(spark, sf_dir):
    s = split_by_document(_combined(spark, sf_dir))
    return s.select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("row_key"), "labels", "split")


@register("split_leaks", """
SELECT CAST(0 AS BIGINT) AS n_leaked, count(*) AS n_documents FROM documents""")
def split_leaks(spark, sf_dir):
    """Documents with rows in more than one part: none."""
    parts = split_by_document(_combined(spark, sf_dir)).groupBy("doc_id").agg(F.countDistinct("split").alias("n"))
    return parts.agg(F.count(F.when(F.col("n") > 1, 1)).alias("n_leaked"), F.count(F.lit(1)).alias("n_documents"))


# ---------------------------------------------------------------- W1, W2

_EARLY_SQL = with_views("history") + """,
h AS (SELECT *, max(metric) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
      FROM history),
i AS (SELECT *, CASE WHEN pb IS NULL OR metric > pb THEN 1 ELSE 0 END AS imp FROM h),
k AS (SELECT *, sum(imp) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS isl FROM i),
s AS (SELECT *, row_number() OVER (PARTITION BY run_id, isl ORDER BY epoch) - 1 AS streak FROM k),
st AS (SELECT run_id, CAST(coalesce(min(CASE WHEN streak >= 3 THEN epoch END), max(epoch)) AS INTEGER) AS stop_epoch,
         count(*) AS n_epochs FROM s GROUP BY run_id),
b AS (SELECT h.run_id, h.epoch, h.metric,
        row_number() OVER (PARTITION BY h.run_id ORDER BY h.metric DESC, h.epoch) AS rn
      FROM history h JOIN st ON h.run_id = st.run_id WHERE h.epoch <= st.stop_epoch)
SELECT st.run_id, n_epochs, stop_epoch, CAST(b.epoch AS INTEGER) AS best_epoch, b.metric AS best_metric
FROM st JOIN b ON st.run_id = b.run_id AND b.rn = 1
"""


@register("early_stopping", _EARLY_SQL)
def early_stopping(spark, sf_dir):
    return H.early_stop(B.history(spark, sf_dir))


@register("best_epoch", with_views("history") + """
SELECT run_id, metric AS best_metric, CAST(epoch AS INTEGER) AS best_epoch FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, epoch) AS rn FROM history) WHERE rn = 1
""")
def best_epoch(spark, sf_dir):
    return H.best_epoch(B.history(spark, sf_dir))


# ---------------------------------------------------------------- W3

@register("best_run", """
SELECT event_type, user_id AS best_run, best_metric FROM (
  SELECT event_type, user_id, max(value) AS best_metric,
    row_number() OVER (PARTITION BY event_type ORDER BY max(value) DESC, user_id) AS rn
  FROM events GROUP BY 1, 2) WHERE rn = 1
""")
def best_run(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events")
    results = ev.groupBy("event_type", "user_id").agg(F.max("value").alias("metric"))
    return H.best_run(results, "event_type", "user_id", "metric")


# ---------------------------------------------------------------- A21

@register("epoch_train_loss", with_views("batch_losses") + """
SELECT run_id, epoch, round(sum(loss * n_rows) / sum(n_rows), 6) AS train_loss, CAST(sum(n_rows) AS BIGINT) AS n_rows
FROM batch_losses GROUP BY 1, 2
""")
def epoch_train_loss(spark, sf_dir):
    t = H.epoch_train_loss(B.batch_losses(spark, sf_dir))
    return t.select("run_id", "epoch", F.round("train_loss", 6).alias("train_loss"), "n_rows")


# ---------------------------------------------------------------- W5

@register("corpus_preview", with_views("macro_posts") + """
SELECT doc_id, macrolabel, microlabel FROM macro_posts ORDER BY doc_id LIMIT 3
""")
def corpus_preview(spark, sf_dir):
    return L.preview(B.macro_posts(spark, sf_dir), "doc_id", 3).select("doc_id", "macrolabel", "microlabel")
