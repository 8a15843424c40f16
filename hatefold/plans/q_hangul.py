"""Registered queries that run the Hangul rules on data where they bite.

The documents hold no Hangul, so Latin letters are mapped to syllables one to one
(``translate`` does the same in Spark and in DuckDB). The mapping makes the words of
the rewriting rules frequent: "th" becomes the first of them, "sh" the second, e, n, a become the
three numeric look-alikes, and "w" the prefix that has exceptions ("wh" is one).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.obfuscate import jamo_decompose
from ..operators import augment as AU
from ..operators import lexicon as LX
from . import bindings as B
from . import fixed_values as FV
from .oracle_views import with_views
from .q_augment import SEED, _jamo_sql, _variants_sql

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYLLABLES = "팔각닭도이파가발년쿠굴몫라일오푸코로씨시우비개와야종"
#: Seeds: the two words of the jamo rules, and two more syllable pairs that are frequent.
SEEDS = [("th", "profanity"), ("sh", "auto_profanity"), ("en", "slur_gender"), ("an", "abuse_general")]


def hangul(word: str) -> str:
    return word.translate(str.maketrans(LETTERS, SYLLABLES))


def hangul_posts(spark, sf_dir):
    return B.posts(spark, sf_dir).withColumn("text", F.translate("text", LETTERS, SYLLABLES))


def hangul_lexicon(spark):
    return spark.createDataFrame([(hangul(w), i, [hangul(w)], [], t, []) for i, (w, t) in enumerate(SEEDS)], LX.LEXICON_SCHEMA)


_HANGUL_CTE = with_views("posts") + f""",
hangul_posts AS (SELECT doc_id, translate(text, '{LETTERS}', '{SYLLABLES}') AS text, hate_label FROM posts),
lexicon_forms AS (SELECT * FROM (VALUES {", ".join(f"('{hangul(w)}', CAST({i} AS BIGINT), '{t}', 0, '{hangul(w)}')" for i, (w, t) in enumerate(SEEDS))})
                  t(seed, seed_ord, type, form_ord, form))"""


@register("hangul_jamo", _HANGUL_CTE + f"""
SELECT doc_id, md5({_jamo_sql('text')}) AS decomposed_md5, CAST(length({_jamo_sql('text')}) AS INTEGER) AS n_chars,
  {_jamo_sql('text')} <> text AS changed FROM hangul_posts
""")
def hangul_jamo(spark, sf_dir):
    """F5 over syllables with and without final consonants."""
    p = hangul_posts(spark, sf_dir).select("doc_id", "text", jamo_decompose(F.col("text")).alias("d"))
    return p.select("doc_id", F.md5("d").alias("decomposed_md5"), F.length("d").alias("n_chars"), (F.col("d") != F.col("text")).alias("changed"))


_VARIANTS = (_HANGUL_CTE + ", targets AS (SELECT * FROM hangul_posts WHERE hate_label = 'hate')" + _variants_sql("targets", FV.MAX_NEW_ONLINE))


@register("hangul_variants", _VARIANTS + "SELECT doc_id AS parent_id, v AS text FROM variants")
def hangul_variants(spark, sf_dir):
    """G1 with F4, F6 and F7 in force: jamo and numeric rewrites and affixes over
    texts with hundreds of matches."""
    targets = hangul_posts(spark, sf_dir).where(F.col("hate_label") == "hate")
    return AU.augment(targets, hangul_lexicon(spark), max_new=FV.MAX_NEW_ONLINE, seed=SEED).select("parent_id", "text")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _insult_sql(t: str) -> str:
    """The default decision chain over a stripped token, as SQL."""
    r = LX.InsultRules()
    whens = [f"WHEN length({t}) < 2 THEN false", f"WHEN {t} IN {_in(r.safe_words)} THEN false",
             f"WHEN regexp_matches({t}, '{r.year_pattern}') THEN false", f"WHEN regexp_matches({t}, '^[0-9]+$') THEN false"]
    for p in r.ban_prefix:
        if p == r.exception_prefix:
            whens.append(f"WHEN starts_with({t}, '{p}') AND substring({t}, {len(p) + 1}, 1) IN {_in(r.safe_after_exception)} THEN false")
        whens.append(f"WHEN starts_with({t}, '{p}') THEN true")
    fragment = "(" + " OR ".join(f"contains({t}, '{f}')" for f in r.fragments) + ")"
    whens += [f"WHEN {fragment} AND regexp_matches({t}, '^(?:{r.year_prefix_pattern})') THEN false", f"WHEN {fragment} THEN true"]
    return "CASE " + " ".join(whens) + " ELSE false END"


@register("hangul_mined_terms", _HANGUL_CTE + f""",
terms AS (SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS term FROM hangul_posts) GROUP BY 1)
SELECT term, freq FROM terms WHERE freq >= {FV.MIN_FREQ} AND {_insult_sql('term')}
""")
def hangul_mined_terms(spark, sf_dir):
    """A4, then P9 with its default word lists, prefixes, exception and fragments."""
    return LX.clean_terms(LX.mine_terms(hangul_posts(spark, sf_dir))).select("term", "freq")
