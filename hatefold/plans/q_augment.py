"""Registered queries: augmentation (G1-G3, S2, S7) with a DuckDB twin of the
keyed-hash rewrite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as AU
from . import bindings as B
from . import fixed_values as FV
from .oracle_views import with_views

QUERIES = {}
ORACLE = {}
SEED = 42


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lst(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


# ---------------------------------------------------------------- SQL twin of the rewrite

def _h(key: str, tag: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {key}, {_q(tag)})), 1, 8)) AS BIGINT)"


def _rule_sql(key: str) -> str:
    n_ch = len(FV.SPECIAL_CHARS) + len(FV.LAUGH)
    p1 = f"(1 + {_h(key, 'ins_pos')} % greatest(length(s2) - 1, 1))"
    p2 = f"(1 + {_h(key, 'sp_pos')} % greatest(length(s2) - 1, 1))"
    idx = f"({_h(key, 'el_idx')} % greatest(length(s2), 1))"
    k = f"(1 + {_h(key, 'el_k')} % 3)"
    ch = f"{_lst(FV.SPECIAL_CHARS + FV.LAUGH)}[1 + {_h(key, 'ins_ch')} % {n_ch}]"
    jamo = "s2"
    for a, b in FV.JAMO_REWRITES:
        jamo = f"replace({jamo}, {_q(a)}, {_q(b)})"
    leet_from = "".join(a for a, _ in FV.NUM_MAP)
    leet_to = "".join(b for _, b in FV.NUM_MAP)
    return f"""CASE r
      WHEN 'insert_special' THEN CASE WHEN length(s2) <= 1 THEN s2
        ELSE substring(s2, 1, {p1}) || {ch} || substring(s2, {p1} + 1) END
      WHEN 'spacing' THEN CASE WHEN length(s2) <= 2 THEN s2
        ELSE substring(s2, 1, {p2}) || ' ' || substring(s2, {p2} + 1) END
      WHEN 'elongate' THEN CASE WHEN length(s2) <= 1 THEN s2
        ELSE substring(s2, 1, {idx} + 1) || repeat(substring(s2, {idx} + 1, 1), {k}) || substring(s2, {idx} + 2) END
      WHEN 'to_jamo' THEN {jamo}
      WHEN 'leet' THEN translate(s2, {_q(leet_from)}, {_q(leet_to)})
      WHEN 'prefix_suffix' THEN CASE WHEN {_h(key, 'affix')} % 2 = 0 THEN {_q(FV.AFFIX_PREFIX)} || s2
        ELSE s2 || {_q(FV.AFFIX_SUFFIX)} END
      ELSE s2 END"""


def _obf_sql(tok: str, typ: str, key: str) -> str:
    rules = (f"list_concat({_lst(FV.BASE_RULES)}, "
             f"CASE WHEN {typ} = 'profanity' OR starts_with({typ}, 'auto') THEN {_lst(FV.PROFANITY_RULES)} "
             f"ELSE CAST([] AS VARCHAR[]) END, "
             f"CASE WHEN starts_with({typ}, 'slur') THEN {_lst(FV.SLUR_RULES)} ELSE CAST([] AS VARCHAR[]) END)")
    n = f"(1 + {_h(key, 'n')} % least({FV.MAX_RULES_PER_TOKEN}, len({rules})))"
    ordered = (f"list_transform(list_sort(list_transform({rules}, lambda r0: "
               f"{{'k': md5(concat_ws(':', {key}, 'order', r0)), 'rule': r0}})), lambda x0: x0.rule)")
    chosen = f"list_slice({ordered}, 1, {n})"
    return (f"CASE WHEN length({tok}) <= 1 THEN {tok} ELSE "
            f"list_reduce({chosen}, lambda s2, r: {_rule_sql(key)}, {tok}) END")


def _matches_cte(source_view: str) -> str:
    return f""",
pairs AS (
  SELECT p.doc_id, f.seed, f.seed_ord, f.form, f.form_ord, f.type, string_split(p.text, f.form) AS parts
  FROM {source_view} p, lexicon_forms f WHERE contains(p.text, f.form)),
occ AS (
  SELECT doc_id, seed_ord, form_ord, type,
    CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(form) AS INTEGER) AS st,
    CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * length(form) AS INTEGER) AS en
  FROM pairs, range(1, len(parts)) r(i)),
ms AS (
  SELECT doc_id, list({{'st': st, 'en': en, 'seed_ord': seed_ord, 'form_ord': form_ord, 'type': type}}
                      ORDER BY st DESC, seed_ord, form_ord) AS ms
  FROM occ GROUP BY doc_id)"""


def _variants_sql(source_view: str, max_new: int) -> str:
    key = f"{SEED}, t.doc_id, a, m.st, m.seed_ord, m.form_ord"
    tok = "substring(s, m.st + 1, m.en - m.st)"
    n_att = FV.ATTEMPTS_PER_VARIANT * max_new
    return _matches_cte(source_view) + f""",
att AS (
  SELECT t.doc_id, t.text AS orig, a,
    list_reduce(ms.ms, lambda s, m: substring(s, 1, m.st) || ({_obf_sql(tok, 'm.type', key)})
                || substring(s, m.en + 1), t.text) AS v
  FROM {source_view} t JOIN ms ON t.doc_id = ms.doc_id, range(0, {n_att}) r(a)),
firsts AS (SELECT doc_id, v, min(a) AS first_a FROM att WHERE v <> orig GROUP BY doc_id, v),
variants AS (
  SELECT doc_id, v FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_a) AS rn FROM firsts)
  WHERE rn <= {max_new})"""


_TARGETS = ", targets AS (SELECT * FROM posts WHERE hate_label IN ('hate', 'offensive'))"

_VARIANTS_SQL = (with_views("posts", "lexicon_forms") + _TARGETS + _variants_sql("targets", FV.MAX_NEW_OFFLINE)
                 + """
SELECT t.doc_id AS parent_id, v.v AS text, t.hate_label
FROM variants v JOIN targets t ON v.doc_id = t.doc_id
""")


@register("augmented_variants", _VARIANTS_SQL)
def augmented_variants(spark, sf_dir):
    """G1 + G2 over the hate and offensive posts (offline setting, 3 variants)."""
    from ..operators.labels import class_filter
    targets = class_filter(B.posts(spark, sf_dir), FV.OFFLINE_TARGET_CLASSES)
    aug = AU.augment(targets, B.lexicon(spark), max_new=FV.MAX_NEW_OFFLINE, seed=SEED)
    return aug.select("parent_id", "text", "hate_label")


_COUNTS_SQL = (with_views("posts", "lexicon_forms") + _TARGETS + _variants_sql("targets", FV.MAX_NEW_OFFLINE)
               + """,
full_corpus AS (
  SELECT 'original' AS origin, hate_label FROM posts
  UNION ALL SELECT 'augmented', t.hate_label FROM variants v JOIN targets t ON v.doc_id = t.doc_id)
SELECT origin, hate_label, count(*) AS n FROM full_corpus GROUP BY 1, 2
""")


@register("augmented_corpus_counts", _COUNTS_SQL)
def augmented_corpus_counts(spark, sf_dir):
    """G3 + S2 + A22: originals plus variants, counted by origin and class."""
    _, full = AU.augment_corpus(B.posts(spark, sf_dir), B.lexicon(spark))
    return full.groupBy("origin", "hate_label").agg(F.count(F.lit(1)).alias("n"))


def _training_set_sql() -> str:
    from ..operators.split import split_oracle_sql
    sp = split_oracle_sql("posts", "hate_label", "doc_id", FV.THREE_WAY_RATIOS, FV.SPLIT_NAMES_3, SEED)
    return (with_views("posts", "lexicon_forms") + f""",
sp AS (SELECT * FROM {sp}),
targets AS (SELECT * FROM sp WHERE split = 'train' AND hate_label = 'hate')"""
            + _variants_sql("targets", FV.MAX_NEW_ONLINE) + """,
allrows AS (
  SELECT split, 'original' AS origin, hate_label FROM sp
  UNION ALL SELECT 'train', 'augmented', t.hate_label FROM variants v JOIN targets t ON v.doc_id = t.doc_id)
SELECT split, origin, hate_label, count(*) AS n FROM allrows GROUP BY 1, 2, 3
""")


@register("training_set_counts", _training_set_sql())
def training_set_counts(spark, sf_dir):
    """Split, then augment only the train rows of the hate class (2 variants)."""
    ts = AU.build_training_set(B.posts(spark, sf_dir), B.lexicon(spark), seed=SEED)
    return ts.groupBy("split", "origin", "hate_label").agg(F.count(F.lit(1)).alias("n"))


@register("written_set_counts", _training_set_sql())
def written_set_counts(spark, sf_dir):
    """The same counts, observed while the training set is written."""
    from ..session import scratch_path
    from ..sources.io import write_counted
    ts = AU.build_training_set(B.posts(spark, sf_dir), B.lexicon(spark), seed=SEED)
    keys = [(s, o, c) for s in FV.SPLIT_NAMES_3 for o in ("original", "augmented") for c in FV.COARSE_CLASSES]
    seen = write_counted(ts, scratch_path(spark, "training-set"), {"|".join(k): (F.col("split") == k[0]) & (F.col("origin") == k[1]) & (F.col("hate_label") == k[2]) for k in keys})
    return spark.createDataFrame([(*k, seen["|".join(k)]) for k in keys if seen["|".join(k)]], "split string, origin string, hate_label string, n long")


# ---------------------------------------------------------------- offline pipeline

def _offline_sql() -> str:
    from .q_lexicon import MERGED_CTE
    return (MERGED_CTE + """,
lexicon_forms AS (
  SELECT seed, seed_ord, type, CAST(i - 1 AS INTEGER) AS form_ord, forms[i] AS form
  FROM (SELECT *, string_split(canonical, '|') AS forms FROM merged), range(1, len(forms) + 1) r(i))"""
            + _TARGETS + _variants_sql("targets", FV.MAX_NEW_OFFLINE) + """
SELECT t.doc_id AS parent_id, v.v AS text, t.hate_label FROM variants v JOIN targets t ON v.doc_id = t.doc_id
""")


@register("offline_pipeline", _offline_sql())
def offline_pipeline(spark, sf_dir):
    """Mine -> clean -> merge -> write -> read back -> augment: the lexicon grown
    from the corpus is written once, and rewrites the corpus it came from."""
    from ..operators import lexicon as LX
    from ..operators.labels import class_filter
    from ..session import scratch_path
    from ..sources import io as IO
    from .q_lexicon import _data_rules, _toxic_terms
    path = scratch_path(spark, "lexicon")
    mined = LX.clean_terms(_toxic_terms(spark, sf_dir), rules=_data_rules())
    IO.write_lexicon(LX.merge_lexicon(B.lexicon(spark), mined), path)
    targets = class_filter(B.posts(spark, sf_dir), FV.OFFLINE_TARGET_CLASSES)
    aug = AU.augment(targets, IO.read_lexicon(spark, path), max_new=FV.MAX_NEW_OFFLINE, seed=SEED)
    return aug.select("parent_id", "text", "hate_label")


# ---------------------------------------------------------------- F5

def _jamo_sql(col: str) -> str:
    ini = _lst(FV.JAMO_INITIALS)
    vow = _lst(FV.JAMO_VOWELS)
    fin = _lst(FV.JAMO_FINALS)
    k = "(unicode(c) - 44032)"
    return (f"array_to_string(list_transform(string_split(coalesce({col}, ''), ''), lambda c: "
            f"CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN "
            f"{ini}[{k} // 588 + 1] || {vow}[({k} % 588) // 28 + 1] || {fin}[{k} % 28 + 1] "
            f"ELSE c END), '')")


@register("jamo_decomposition", with_views("posts") + f"""
SELECT doc_id, md5({_jamo_sql('text')}) AS decomposed_md5, CAST(length({_jamo_sql('text')}) AS INTEGER) AS n_chars
FROM posts
""")
def jamo_decomposition(spark, sf_dir):
    """F5 over every post text (md5 of the result keeps the output small)."""
    from ..functions.obfuscate import jamo_decompose
    p = B.posts(spark, sf_dir)
    return p.select("doc_id", jamo_decompose(F.col("text")).alias("_d")).select(
        "doc_id", F.md5("_d").alias("decomposed_md5"), F.length("_d").alias("n_chars"))
