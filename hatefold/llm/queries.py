"""The corpus operators bound to the given tables, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (bpe_codec, chat_format, exact_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, periodic_runs,
               source_divergence, suffix_dedup, token_counts, topk)
from ..functions.text import let
from .common import table

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


@register("op2_html_extraction")
def op2(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op3_cost_balanced_packing")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op5_language_id")
def op5(spark, sf_dir):
    """Documents declare their language in ``lang``; their host is ``source``."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs), declared_col="lang", host_col="source", suffix=False)


@register("page_language")
def page_language(spark, sf_dir):
    """The same over pages: markup language, address suffix, host and main text."""
    pages = table(spark, sf_dir, "pages")
    hosts = language_id.page_evidence(pages).select(F.col("page_id").alias("__id"), "__declared", "__host")
    text = html_extract.extract(pages).join(hosts, F.col("page_id") == F.col("__id"))
    return (language_id.identify(text, language_id.fit(table(spark, sf_dir, "documents")), id_col="page_id",
                                 declared_col="__declared", host_col="__host").withColumnRenamed("doc_id", "page_id"))


@register("op6_bpe_codec")
def op6(spark, sf_dir):
    return bpe_codec.codec_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@register("op7_voronoi_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op7(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@register("op8_suffix_dedup")
def op8(spark, sf_dir):
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"))


@register("op9_exact_dedup", """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""")
def op9(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@register("op10_line_dedup")
def op10(spark, sf_dir):
    """Every line that is not blank; an edit for each 10 code points, two at most."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"), max_edits=2, min_exact=1, min_near=10, chars_per_edit=10)


def looped(docs):
    """``docs`` with the words of every tenth document, by the CRC of its id, repeated
    from some word on with some period, as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def around(w):
        def at(a):
            p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
            return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: w[F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")])
        n = F.size(w).cast("long")
        return F.when(n > 0, F.array_join(let(g % n, at), " ")).otherwise("")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, around)).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11(spark, sf_dir):
    found = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")), min_length=6, exponent=4)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("strongest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@register("op12_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
      FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY ALL),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(sum(n), 0) + 2) // (any_value(total) + 2 * any_value(v)) AS q
      FROM k JOIN v USING (lang) JOIN ln USING (lang) LEFT JOIN c USING (lang, term) GROUP BY ALL),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
""")
def op12(spark, sf_dir):
    return source_divergence.audit(table(spark, sf_dir, "documents"), min_documents=10, top=10)


#: A conversation that says the control strings of the template.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@register("op13_chat_format", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|<ROLE>>)', '\1\2\\\3', 'g'))
      + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 10 WHEN 'assistant' THEN 14
             ELSE 9 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|<ROLE>>)', '\1\2\\\3', 'g')) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op13(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.chat_digest(turns.unionByName(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")))
