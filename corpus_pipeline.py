"""A training corpus from raw documents: five stages, each a corpus operator.

Every stage takes what the one before kept, as a Parquet table, and returns the
columns of ``documents``; the last returns the packed pieces. Rows that share an id
share a stage's decision, and rows with a null id pass the language and the
near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hatefold.llm import exact_dedup, jaccard_join, language_id, packing, suffix_dedup
from hatefold.llm.common import table, written


def known_language(spark, docs, sf_dir):
    """Documents whose language the fused evidence accepts. The declared language
    is ``lang`` and the host ``source``; the text models are fitted on a bounded
    sample of the documents, by their declared language."""
    judged = language_id.identify(docs, language_id.fit(docs), declared_col="lang", host_col="source", suffix=False)
    rejected = written(judged.filter(~F.col("accepted")).select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def distinct_texts(spark, docs, sf_dir):
    """Of documents equal after lower-casing A-Z the largest id stays."""
    return exact_dedup.keep_one(docs)


def no_near_copies(spark, docs, sf_dir):
    """Of documents that Jaccard links of 0.8 over five-word shingles join, the
    smallest id stays."""
    groups = jaccard_join.near_duplicates(docs, k=5, percent=80)
    copies = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def no_repeated_passages(spark, docs, sf_dir):
    """Texts without the passages of 50 bytes or more that a smaller id has; a
    document of which nothing is left goes."""
    cut = suffix_dedup.remove_repeats(docs).filter("__removed = 0 OR text <> ''")
    return cut.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed_sequences(spark, docs, sf_dir):
    """What is left, in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("exact_dedup", distinct_texts), ("ngram_jaccard_join", no_near_copies),
          ("suffix_dedup", no_repeated_passages), ("packing", packed_sequences)]

#: Trained models, signatures of n-gram sets, byte strings and token ids have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
