"""Text features (M1) and fixed-length encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import posexplode_kept, text_or_empty
from ..session import written
from .ranking import numbered

DEFAULT_DIM = 1 << 13


def char_ngrams(col: Column, sizes=(2, 3)) -> Column:
    """All character n-grams of the whole text for each n in ``sizes``.

    One regex pass per size: a lookahead capture of n code points at every
    code-point offset (``(?s)`` so newlines count as characters). This stays inside one
    JVM expression; building grams by substring at an offset would rescan the
    UTF-8 string and make long texts quadratic."""
    t = text_or_empty(col)
    # \P{Cs}: the match loop steps one UTF-16 unit past an empty match, so a
    # gram must not start on the low half of a surrogate pair (emoji etc.).
    return F.concat(*[F.regexp_extract_all(t, F.lit("(?s)(?=(\\P{Cs}" + "." * (n - 1) + "))"), 1)
                      for n in sizes])


def hashed_features(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM, idf: bool = False,
                    out_col: str = "features") -> DataFrame:
    """M1: char 2-3-grams -> HashingTF term counts (sparse vector),
    optionally IDF-weighted; the stand-in for an encoder's sentence vector."""
    out, _ = mllib_features(df, text_col, dim, idf, out_col)
    return out


def mllib_features(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM, idf: bool = False,
                   out_col: str = "features", sizes=(2, 3)):
    """Char n-gram counts in HashingTF's buckets (+ IDF). Returns (frame, fitted stages).

    The counts are those of HashingTF over :func:`char_ngrams`, without a string per gram:
    a batch's grams are numbered by its alphabet, only different ones are hashed, and the
    buckets of each row are counted."""
    from pyspark.ml.feature import IDF
    out = _counted(df, text_col, dim, out_col if not idf else "_tf", tuple(sizes))
    if not idf:
        return out, []
    model = IDF(inputCol="_tf", outputCol=out_col).fit(out)
    return model.transform(out).drop("_tf"), [model]


#: Numbers of grams, or of (row, bucket) cells, up to which a table has one entry for each.
MAX_CELLS = 1 << 23


def _counted(df: DataFrame, text_col: str, dim: int, out_col: str, sizes) -> DataFrame:
    """``df`` with the bucket counts of each text as a sparse vector."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType
    at, kept = df.columns.index(text_col), [f for f in df.schema.fields if f.name != out_col]
    places = [df.columns.index(f.name) for f in kept]

    def run(batches):
        import pyarrow as pa

        from ..llm.common import slices, text_buffer
        for b in batches:
            buf, off = text_buffer(b.column(at))
            for i, j in slices(off):
                bounds, buckets, counts = gram_counts(buf, off[i:j + 1], sizes, dim)
                vectors = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(j - i, np.int8)), pa.array(np.full(j - i, dim, np.int32)),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(buckets, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts, pa.float64()))],
                    names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in places), vectors],
                                                 names=[*(f.name for f in kept), out_col])
    return df.mapInArrow(run, StructType([*kept, StructField(out_col, VectorUDT())]))


def gram_counts(buf: np.ndarray, off: np.ndarray, sizes, dim: int):
    """(bounds, buckets, counts): text d has counts[bounds[d]:bounds[d + 1]] grams in these
    buckets, in order."""
    n_rows, raw = len(off) - 1, buf[off[0]:off[-1]]
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off - off[0]]
    row = np.repeat(np.arange(n_rows), np.diff(begins))
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    codes, cells = number[chars], []
    for n in sizes:
        if len(codes) < n:
            continue
        inside = row[:len(row) - n + 1] == row[n - 1:]
        grams = codes[:len(codes) - n + 1]
        for k in range(1, n):
            grams = grams * len(alphabet) + codes[k:len(codes) - n + 1 + k]
        grams = grams[inside]
        if len(alphabet) ** n <= MAX_CELLS:
            there = np.zeros(len(alphabet) ** n, bool)
            there[grams] = True
            distinct, which = np.flatnonzero(there), grams
            bucket = np.zeros(len(there), np.int64)
            bucket[distinct] = _buckets(_spelled(distinct, alphabet, n), dim)
        else:
            distinct, which = np.unique(grams, return_inverse=True)
            bucket = _buckets(_spelled(distinct, alphabet, n), dim)
        cells.append(row[:len(row) - n + 1][inside] * dim + bucket[which])
    cells = np.concatenate(cells) if cells else np.zeros(0, np.int64)
    if n_rows * dim <= MAX_CELLS:
        table = np.bincount(cells, minlength=n_rows * dim)
        cells = np.flatnonzero(table)
        counts = table[cells]
    else:
        cells, counts = np.unique(cells, return_counts=True)
    return np.searchsorted(cells, np.arange(n_rows + 1) * dim), (cells % dim).astype(np.int32), counts.astype(float)


def _spelled(grams: np.ndarray, alphabet: np.ndarray, n: int) -> np.ndarray:
    """The code points, gram by n, of grams numbered by the alphabet."""
    out = np.empty((len(grams), n), np.int64)
    for k in reversed(range(n)):
        grams, last = np.divmod(grams, max(len(alphabet), 1))
        out[:, k] = alphabet[last]
    return out


def _buckets(chars: np.ndarray, dim: int) -> np.ndarray:
    """The bucket in which HashingTF counts each gram: MurmurHash3 (32 bits, seed 42) of its
    UTF-8 bytes, modulo ``dim``."""
    n, width = chars.shape
    text, size = np.zeros((n, 4 * width + 4), np.uint8), np.zeros(n, np.int64)
    for k in range(width):
        c = chars[:, k]
        n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        for m, head in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            at = np.flatnonzero(n_bytes == m)
            for i in range(m):
                bits = c[at] >> 6 * (m - 1 - i)
                text[at, size[at] + i] = bits & 0x3F | 0x80 if i else bits | head
        size += n_bytes
    words = text.view("<u4")
    h = np.full(n, 42, np.uint32)

    def turned(x, r):
        return x << np.uint32(r) | x >> np.uint32(32 - r)
    for i in range(width + 1):  # the last, partial word holds zeros after the gram's end
        k = turned(words[:, i] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        whole = size >= 4 * (i + 1)
        h = np.where(whole, turned(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(size > 4 * i, h ^ k, h))
    h = h ^ size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % dim


def term_vocabulary(terms: DataFrame, vocab_size: int | None = None, term_col: str = "term",
                    freq_col: str = "freq", reserved: int = 2) -> DataFrame:
    """All terms, or the ``vocab_size`` most frequent ones, with ids by descending
    frequency (ties by term); ids 0 and 1 are reserved for padding and unknown.

    Terms are ranked over ranges of (frequency, term); no task sees the whole table."""
    ranked = numbered(terms.select(term_col, freq_col), [F.desc(freq_col), F.asc(term_col)], "token_id", reserved)
    if vocab_size is not None:
        ranked = ranked.where(F.col("token_id") < vocab_size + reserved)
    return ranked.select(term_col, F.col("token_id").cast("int").alias("token_id"))


def encode_text(df: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_len: int = 128, pattern: str = r"\p{L}+", unk_id: int = 1) -> DataFrame:
    """tokens -> ids (vocabulary equi-join), truncate/pad to ``max_len``,
    attention mask. Tokens keep their position through the join, and the ids
    are re-assembled in order per row."""
    # The whole text is tokenised; truncation to the model length happens on
    # the token array, so only max_len tokens per row are exploded. A row number
    # keeps rows that share an id apart; the tokens are written with it before they
    # are dealt, as a recomputed task could number its rows anew. A text without
    # tokens keeps its null row: the input is read once and joined with nothing but
    # the vocabulary.
    tokens = F.slice(F.regexp_extract_all(F.lower(text_or_empty(F.col(text_col))), F.lit(pattern), 0), 1, max_len)
    rows = written(df.select(id_col, F.monotonically_increasing_id().alias("_row"), tokens.alias("_tokens")), "tokens")
    toks = rows.select(id_col, "_row", posexplode_kept("_tokens").alias("pos", "term"))
    # No broadcast hint: a small vocabulary is broadcast by its measured size.
    ids = (toks.join(vocab.withColumnRenamed(vocab.columns[0], "term"), "term", "left")
           .withColumn("token_id", F.when(F.col("term").isNotNull(), F.coalesce("token_id", F.lit(unk_id)))))
    enc = ids.groupBy(id_col, "_row").agg(F.transform(F.sort_array(F.collect_list(
        F.when(F.col("token_id").isNotNull(), F.struct("pos", "token_id")))), lambda s: s["token_id"]).alias("_ids"))
    n = F.size("_ids")
    return enc.select(
        id_col,
        F.concat("_ids", F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0)))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0))))
        .alias("attention_mask"))
