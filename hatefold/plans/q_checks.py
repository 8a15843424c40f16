"""Registered queries that hold the model operators and rarely used branches
against values that SQL can derive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import lexicon as LX
from ..operators import split as SP
from ..operators import train as TR
from ..session import scratch_path
from ..sources import io as IO
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


DIMS = 64


def _weights() -> np.ndarray:
    """A fixed weight table: 11 outputs, DIMS features and the bias."""
    k, j = np.arange(TR.N_OUT)[:, None], np.arange(DIMS + 1)[None]
    return ((7 * k + 3 * j) % 11 - 5) / 10.0


def _vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    x = B.scored(spark, sf_dir).join(B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return x.select("id", "y_coarse", "y_fine", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))


_X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"

# ---------------------------------------------------------------- M7


_LOGITS_SQL = f"""
WITH e AS (SELECT vec_id AS id, {_X} AS x FROM embeddings)
SELECT id, CAST(k AS INTEGER) AS output,
  round(list_sum(list_transform(range({DIMS}), lambda j: ((7 * k + 3 * j) % 11 - 5) / 10.0 * x[j + 1])) / sqrt(greatest(list_sum(x), 1))
        + ((7 * k + 3 * {DIMS}) % 11 - 5) / 10.0, 5) AS logit
FROM e, range({TR.N_OUT}) r(k)
"""


@register("fixed_weight_logits", _LOGITS_SQL)
def fixed_weight_logits(spark, sf_dir):
    """M7: the logits of both heads under a fixed weight table."""
    model = TR.TwoHeadModel(_weights(), DIMS, False, [])
    scored = TR.score_two_head(_vectors(spark, sf_dir), model, keep=("id",))
    return (scored.select("id", F.posexplode(F.concat("logits_coarse", "logits_fine")).alias("output", "z"))
            .select("id", "output", F.round("z", 5).alias("logit")))


@register("user_model_logits", _LOGITS_SQL)
def user_model_logits(spark, sf_dir):
    """M7 with a model that the caller brings, loaded once per worker: the same weights."""
    weights = _weights()

    def load():
        def predict(x):
            return (x / np.sqrt(np.maximum(x.sum(axis=1), 1.0))[:, None]) @ weights[:, :DIMS].T + weights[:, DIMS]
        return predict
    rows = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    scored = TR.score_with(rows, load, "x", TR.N_OUT, DIMS)
    return scored.select("id", F.posexplode("logits").alias("output", "z")).select("id", "output", F.round("z", 5).alias("logit"))


# ---------------------------------------------------------------- M2 / M3

def _gradient_sql() -> str:
    q, n_fine = 0.5 ** TR.N_FINE, TR.N_FINE
    pen_c = f"(1 - 2 * {q}) / 3 * (CAST(k = 0 AS INTEGER) - 1 / 3.0)"
    return with_views("scored") + f""",
e AS (SELECT s.id, y_coarse AS y, y_fine AS yf, list_concat(list_transform({_X}, lambda v: v / sqrt(greatest(list_sum({_X}), 1))), [1.0]) AS x
      FROM scored s JOIN embeddings ON id = vec_id),
n AS (SELECT count(*) AS n FROM e),
cw AS (SELECT y, max(n.n) / (3.0 * count(*)) AS w FROM e, n GROUP BY y),
pos AS (SELECT j, sum(yf[j + 1]) AS p, max(n.n) AS n FROM e, n, range({n_fine}) r(j) GROUP BY j),
pw AS (SELECT j, (n - p) / (p + 1e-6) AS w FROM pos),
d AS (SELECT 'flat' AS model, k AS output, x, cw.w * (1 / 3.0 - CAST(e.y = k AS INTEGER)) AS dz FROM e JOIN cw ON e.y = cw.y, range(3) r(k)
  UNION ALL SELECT 'flat', 3 + pw.j, x, 0.5 * (1 + (pw.w - 1) * yf[pw.j + 1]) - pw.w * yf[pw.j + 1] FROM e, pw
  UNION ALL SELECT 'hierarchical', k, x, 1 / 3.0 - CAST(y = k AS INTEGER) + {pen_c} FROM e, range(3) r(k)
  UNION ALL SELECT 'hierarchical', 3 + j, x, (0.5 - yf[j + 1]) / {n_fine} - {q} * 0.5 / 3 FROM e, range({n_fine}) r(j)),
g AS (SELECT model, output, j, sum(dz * x[j + 1]) AS g FROM d, range({DIMS}) r(j) GROUP BY 1, 2, 3),
bce AS (SELECT sum(pw.w * yf[pw.j + 1] + 1 - yf[pw.j + 1]) * ln(2) / (max(n.n) * {n_fine}) AS flat, ln(2) AS hier FROM e, pw, n)
SELECT model, CAST(output AS INTEGER) AS output, count(*) FILTER (WHERE g < 0) AS n_up, count(*) FILTER (WHERE g > 0) AS n_down,
  round(ln(3) + CASE WHEN model = 'flat' THEN max(bce.flat) ELSE max(bce.hier) + (1 - {q}) / 3 + 2 * {q} / 3 END, 5) AS loss
FROM g, bce GROUP BY 1, 2
"""


@register("first_gradient_step", _gradient_sql())
def first_gradient_step(spark, sf_dir):
    """M2 / M3: the loss at zero weights (class and positive weights, penalty), and
    the direction that the first step moves every weight (the biases aside: balanced
    class weights leave theirs at zero)."""
    data, rows = _vectors(spark, sf_dir), []
    for name, hier in (("flat", 0.0), ("hierarchical", 1.0)):
        m = TR.fit_two_head(data, dim=DIMS, lambda_hier=hier, weighted=not hier, iterations=1)
        rows += [(name, k, int((w[:DIMS] > 0).sum()), int((w[:DIMS] < 0).sum()), round(m.history[0][1], 5)) for k, w in enumerate(m.weights)]
    return spark.createDataFrame(rows, "model string, output int, n_up long, n_down long, loss double")


# ---------------------------------------------------------------- M4

@register("baseline_class_shares", """
SELECT lang, CAST(n_chars % 3 AS INTEGER) AS cls, count(*) AS n, true AS fits FROM documents GROUP BY 1, 2
""")
def baseline_class_shares(spark, sf_dir):
    """M4: unregularised on one indicator per language, the fitted probabilities
    are the class shares of the language."""
    from pyspark.ml.functions import array_to_vector
    docs = B.table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 3).cast("int").alias("labels"))
    langs = [x for x, _ in B.LANG_TARGETS]
    data = docs.withColumn("features", array_to_vector(F.array(*[(F.col("lang") == x).cast("double") for x in langs])))
    logits = TR.baseline_logits(TR.fit_baseline(data, tol=1e-9), data, keep=("lang", "labels"), n_classes=3)
    cells = logits.groupBy("lang", "labels").agg(F.count(F.lit(1)).alias("n"), F.first("logits").alias("z"))
    e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
    p = F.element_at(e, F.col("labels") + 1) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    whole = cells.groupBy("lang").agg(F.sum("n").alias("m"))
    return cells.withColumn("p", p).join(whole, "lang").select(
        "lang", F.col("labels").alias("cls"), "n", (F.abs(F.col("p") - F.col("n") / F.col("m")) < 1e-3).alias("fits"))


# ---------------------------------------------------------------- M1

@register("hashed_ngram_counts", with_views("posts") + """
SELECT doc_id, CAST(greatest(length(text) - 1, 0) + greatest(length(text) - 2, 0) AS DOUBLE) AS n_grams, true AS within FROM posts
""")
def hashed_ngram_counts(spark, sf_dir):
    """M1: the counts that HashingTF spreads over its buckets add up to the n-grams."""
    from pyspark.ml.functions import vector_to_array
    f = FE.hashed_features(B.posts(spark, sf_dir).select("doc_id", "text"), dim=1 << 10)
    v = vector_to_array("features")
    return f.select("doc_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("n_grams"), (F.size(v) == 1 << 10).alias("within"))


# ---------------------------------------------------------------- P14

@register("score_maps", with_views("scored_b") + """,
z AS (SELECT id, logits_coarse AS z FROM scored_b)
SELECT id, array_to_string(list_transform(range(1, 4), lambda i: [""" + ", ".join(f"'{c}'" for c in FV.COARSE_CLASSES) + """][i] || '=' ||
  CAST(CAST(round(exp(z[i] - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) * 1000, 0) AS INTEGER) AS VARCHAR)), ',') AS scores
FROM z
""")
def score_maps(spark, sf_dir):
    """The map from class name to score, in thousandths."""
    from ..operators.score import suspect
    rows = B.scored_b(spark, sf_dir).select("id", F.col("logits_coarse").alias("logits"))
    m = suspect(rows, list(FV.COARSE_CLASSES), FV.BASELINE_THRESHOLD)
    parts = [F.concat(F.lit(f"{c}="), F.round(m["scores"][c] * 1000).cast("int").cast("string")) for c in FV.COARSE_CLASSES]
    return m.select("id", F.concat_ws(",", *parts).alias("scores"))


# ---------------------------------------------------------------- IO6 / IO7 as JSON objects, A5 with positions

_OBJECT_SQL = """
SELECT lang AS term, count(*) AS freq, row_number() OVER (ORDER BY lang) - 1 AS pos FROM documents GROUP BY 1
"""


@register("term_object_roundtrip", _OBJECT_SQL)
def term_object_roundtrip(spark, sf_dir):
    """IO6: one JSON object {term: count}; positions follow the object's order."""
    path = scratch_path(spark, "terms-object")
    counts = B.table(spark, sf_dir, "documents").groupBy("lang").count()
    entries = F.sort_array(F.collect_list(F.struct("lang", F.col("count").cast("string"))))  # one entry per language
    counts.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)
    return IO.read_term_freq(spark, path)


@register("lexicon_object_roundtrip", with_views("lexicon") + """
SELECT seed, seed_ord, array_to_string(canonical, '|') AS canonical, type,
  (SELECT count(*) FROM documents WHERE contains(lower(text), seed)) AS n_documents FROM lexicon""")
def lexicon_object_roundtrip(spark, sf_dir):
    """IO7: one JSON object {seed: entry} in a *.json file; used on all documents."""
    path = scratch_path(spark, "lexicon-object") + ".json"
    entry = F.struct("canonical", "jamo", "type", "targets")
    # ten seeds: the fixture's manual lexicon
    whole = B.lexicon(spark).agg(F.sort_array(F.collect_list(F.struct("seed_ord", "seed", entry.alias("e")))).alias("s"))
    obj = F.map_from_entries(F.transform("s", lambda x: F.struct(x["seed"], x["e"])))
    whole.select(F.to_json(obj).alias("value")).coalesce(1).write.text(path)
    lex = IO.read_lexicon(spark, path)
    docs = B.table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    hits = docs.join(F.broadcast(lex.select("seed")), F.col("t").contains(F.col("seed"))).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return lex.join(hits, "seed", "left").select("seed", "seed_ord", F.array_join("canonical", "|").alias("canonical"), "type",
                                                 F.coalesce("n", F.lit(0).cast("long")).alias("n_documents"))


@register("last_duplicate_wins", """
WITH t AS (SELECT trim(split_part(text, ' ', 1)) AS term, 3 + doc_id % 5 AS freq, doc_id AS pos FROM documents)
SELECT term, arg_max(freq, pos) AS freq, min(pos) AS pos FROM t
WHERE length(term) >= 2 AND (starts_with(term, 'Th') OR starts_with(term, 'On')) GROUP BY term
""")
def last_duplicate_wins(spark, sf_dir):
    """A5 with positions: first words of the documents as mined terms, padded with
    blanks; the last duplicate's count, at the first one's position."""
    docs = B.table(spark, sf_dir, "documents")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    terms = docs.select(F.concat(F.lit("\t "), word, F.lit(" ")).alias("term"), (3 + F.col("doc_id") % 5).alias("freq"), F.col("doc_id").alias("pos"))
    rules = LX.InsultRules(safe_words=[], ban_prefix=["Th", "On"], exception_prefix=None, safe_after_exception=[], fragments=[])
    return LX.clean_terms(terms, rules=rules, pos_col="pos")


# ---------------------------------------------------------------- M9 / M10 support

@register("evaluation_support", with_views("posts") + "SELECT split, hate_label, count(*) AS n_rows, count(DISTINCT doc_id) AS n_documents FROM "
          + SP.split_oracle_sql("posts", "hate_label", "doc_id", FV.THREE_WAY_RATIOS, FV.SPLIT_NAMES_3) + " GROUP BY 1, 2")
def evaluation_support(spark, sf_dir):
    """The rows on which the experiments train, select and report, by class."""
    from .q_models import SEED, _two_head_input
    data = _two_head_input(SP.stratified_split(B.posts(spark, sf_dir), "hate_label", "doc_id", seed=SEED))
    names = F.array(*[F.lit(c) for c in FV.COARSE_CLASSES])
    return (data.groupBy("split", F.element_at(names, F.col("y_coarse") + 1).alias("hate_label"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_documents")))
