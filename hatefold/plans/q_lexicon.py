"""Registered queries: lexicon matching, mining, cleaning and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import explode_kept
from ..operators import lexicon as LX
from ..session import written
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


# ---------------------------------------------------------------- J2 + A1 (flagship)

_HITS_SQL = with_views("posts", "lexicon_forms") + """,
counts AS (
  SELECT p.doc_id, p.hate_label, f.seed, f.form,
    CAST((length(p.text) - length(replace(p.text, f.form, ''))) / length(f.form) AS BIGINT) AS n
  FROM posts p, lexicon_forms f)
SELECT hate_label, seed, form, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_matches
FROM counts WHERE n > 0 GROUP BY 1, 2, 3
"""


@register("lexicon_hits_by_class", _HITS_SQL)
def lexicon_hits_by_class(spark, sf_dir):
    """Per coarse class and lexicon form: documents hit and total matches."""
    counted = LX.count_lexicon(B.posts(spark, sf_dir), B.lexicon(spark))
    per_doc = (counted.select("hate_label", explode_kept(F.col("counts")).alias("h"))
               .where(F.col("h").isNotNull()))
    return (per_doc.groupBy("hate_label", F.col("h.seed").alias("seed"), F.col("h.form").alias("form"))
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("h.n").cast("long")).alias("n_matches")))


# ---------------------------------------------------------------- J2 detail

_MATCHES_SQL = with_views("posts", "lexicon_forms") + """,
pairs AS (
  SELECT p.doc_id, f.seed, f.seed_ord, f.form, f.form_ord, string_split(p.text, f.form) AS parts
  FROM posts p, lexicon_forms f WHERE contains(p.text, f.form)),
occ AS (
  SELECT doc_id, seed, form, form_ord, parts, i FROM pairs, range(1, len(parts)) r(i))
SELECT doc_id, seed, form, CAST(form_ord AS INTEGER) AS form_ord,
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(form) AS INTEGER) AS start,
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * length(form) AS INTEGER) AS "end"
FROM occ
"""


@register("lexicon_matches", _MATCHES_SQL)
def lexicon_matches(spark, sf_dir):
    """Every (document, seed, form, start, end) occurrence, as finditer reports it."""
    matched = LX.match_lexicon(B.posts(spark, sf_dir), B.lexicon(spark))
    return LX.explode_matches(matched).select("doc_id", "seed", "form", "form_ord", "start", "end")


# ---------------------------------------------------------------- A4

_TERMS_SQL = with_views("posts") + """
SELECT term, count(*) AS freq
FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM posts)
GROUP BY term
"""


@register("term_frequencies", _TERMS_SQL)
def term_frequencies(spark, sf_dir):
    return LX.mine_terms(B.posts(spark, sf_dir))


# ---------------------------------------------------------------- P9 + A5 + J1

PREFIXES = [*B.WORDS, "thwh", "erwh", "ered"]


def _data_rules():
    """Insult rules bound to the fixture: its word list, and prefixes of invented
    words that the lexicon does not hold yet, as banned prefixes."""
    return LX.InsultRules(safe_words=[], ban_prefix=PREFIXES, exception_prefix=None,
                          safe_after_exception=[], fragments=[])


def _toxic_terms(spark, sf_dir):
    posts = B.posts(spark, sf_dir)
    return LX.mine_terms(posts.where(F.col("hate_label") != "clean"))


_CLEAN_SQL = with_views("posts") + """,
terms AS (
  SELECT term, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM posts WHERE hate_label <> 'clean')
  GROUP BY term)
SELECT term, freq FROM terms
WHERE freq >= 3 AND length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$')
  AND (""" + " OR ".join(f"starts_with(term, '{w}')" for w in PREFIXES) + """)
"""


@register("clean_mined_terms", _CLEAN_SQL)
def clean_mined_terms(spark, sf_dir):
    """A4 over toxic posts, then A5 with the fixture's rule binding."""
    return LX.clean_terms(_toxic_terms(spark, sf_dir), rules=_data_rules()).select("term", "freq")


MERGED_CTE = with_views("posts", "lexicon") + """,
terms AS (
  SELECT term, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM posts WHERE hate_label <> 'clean')
  GROUP BY term),
mined AS (
  SELECT term, freq FROM terms
  WHERE freq >= 3 AND length(term) >= 2 AND NOT regexp_matches(term, '^[0-9]+$')
    AND (""" + " OR ".join(f"starts_with(term, '{w}')" for w in PREFIXES) + """)),
existing AS (
  SELECT seed AS term FROM lexicon UNION SELECT unnest(canonical) FROM lexicon
  UNION SELECT unnest(jamo) FROM lexicon),
merged AS (
  SELECT seed, seed_ord, type, array_to_string(canonical, '|') AS canonical FROM lexicon
  UNION ALL
  SELECT term AS seed, row_number() OVER (ORDER BY freq DESC, term) - 1 + (SELECT max(seed_ord) + 1 FROM lexicon) AS seed_ord,
    'auto_profanity' AS type, term AS canonical
  FROM mined WHERE term NOT IN (SELECT term FROM existing WHERE term IS NOT NULL))
"""
_MERGE_SQL = MERGED_CTE + "SELECT seed, seed_ord, type, canonical FROM merged"


@register("merged_lexicon", _MERGE_SQL)
def merged_lexicon(spark, sf_dir):
    mined = LX.clean_terms(_toxic_terms(spark, sf_dir), rules=_data_rules())
    merged = LX.merge_lexicon(B.lexicon(spark), mined)
    return merged.select("seed", "seed_ord", "type", F.array_join("canonical", "|").alias("canonical"))


# ---------------------------------------------------------------- J2, both paths

_PATHS_SQL = with_views("talk_forms") + """,
hits AS (
  SELECT c.conv_id, c.turn, f.seed, f.form,
    CAST((length(c.text) - length(replace(c.text, f.form, ''))) / length(f.form) AS INTEGER) AS n
  FROM (SELECT conv_id, turn, lower(text) AS text FROM conversations) c, talk_forms f)
SELECT p.path, conv_id, turn, seed, form, n FROM hits, (VALUES ('inline'), ('automata'), ('distributed')) p(path) WHERE n > 0
"""

#: (forms, characters of an automaton) up to which a tier is used.
MATCHER_TIERS = {"inline": (LX.MAX_INLINE_FORMS, LX.MAX_AUTOMATON_CHARS), "automata": (0, LX.MAX_AUTOMATON_CHARS), "distributed": (0, 0)}


@register("matcher_paths", _PATHS_SQL)
def matcher_paths(spark, sf_dir):
    """The same lexicon through all three matchers, over messages whose conv_id repeats."""
    conv = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    lexicon, out = B.talk_lexicon(spark, sf_dir), None
    for path, (n_forms, n_chars) in MATCHER_TIERS.items():
        matcher = LX.prepare_matcher(lexicon, max_inline_forms=n_forms, counts_only=True, max_automaton_chars=n_chars)
        rows = (matcher(conv, "text", "conv_id", "counts").select("conv_id", "turn", explode_kept(F.col("counts")).alias("c"))
                .where(F.col("c").isNotNull())
                .select(F.lit(path).alias("path"), "conv_id", "turn", "c.seed", "c.form", "c.n"))
        out = rows if out is None else out.unionByName(rows)
    return out


_MINED_SQL = with_views("posts") + """,
forms AS (SELECT DISTINCT term AS form FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM posts) WHERE length(term) >= 3),
sizes AS (SELECT DISTINCT length(form) AS k FROM forms),
msgs AS (SELECT conv_id, turn, lower(text) AS text FROM conversations),
pairs AS (SELECT DISTINCT conv_id, turn, text, g AS form FROM (
  SELECT conv_id, turn, text, unnest(list_distinct(list_transform(range(1, length(text) - k + 2), lambda i: text[i:i + k - 1]))) AS g FROM msgs, sizes WHERE length(text) >= k)
  WHERE g IN (SELECT form FROM forms))
SELECT form, count(*) AS n_messages, CAST(sum((length(text) - length(replace(text, form, ''))) / length(form)) AS BIGINT) AS n_matches FROM pairs GROUP BY form
"""


@register("mined_form_matches", _MINED_SQL)
def mined_form_matches(spark, sf_dir):
    """J2 with a large mined lexicon, every term of three letters or more of the posts,
    over the messages: partitioned automata, no shuffle of texts."""
    mined = LX.mine_terms(B.posts(spark, sf_dir)).where(F.length("term") >= 3)
    lexicon = mined.select(F.col("term").alias("seed"), F.lit(0).cast("long").alias("seed_ord"), F.array("term").alias("canonical"),
                           F.array().cast("array<string>").alias("jamo"), F.lit(FV.AUTO_TYPE).alias("type"), F.array().cast("array<string>").alias("targets"))
    conv = B.table(spark, sf_dir, "conversations").select(F.lower("text").alias("text"))
    counted = LX.prepare_matcher(written(lexicon, "mined"), counts_only=True)(conv, "text", "conv_id", "counts")
    hits = counted.select(explode_kept(F.col("counts")).alias("c")).where(F.col("c").isNotNull())
    return hits.groupBy("c.form").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(F.col("c.n").cast("long")).alias("n_matches"))
