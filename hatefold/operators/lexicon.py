"""Lexicon operators: schema, matching (J2), term mining (A4), cleaning (P9, A5),
merging (J1).

Matching is row-local. The lexicon's forms are compiled once into a regex trie
whose greedy optional tails make the longest form at each offset win; a
prefix-closure map then recovers every shorter form that starts at the same
offset. Each occurring form is located with one ``split`` per text, which gives
Python ``re.finditer``'s left-to-right non-overlapping matches. No shuffle and
no text x lexicon nested loop.

The compiled lexicon is inlined in the plan, as one constant, only behind a
size check (form count and total characters). Above it, up to a bound on their
characters, the forms are broadcast as the shards of an automaton, still row-local
(``automata``). Above that, a distributed join finds the forms that may occur in each
chunk of texts, and each chunk is run through an automaton of these, so an unbounded
mined lexicon never passes through the driver or a worker. All three give the same
matches for every row.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (explode_kept, let, prefix_sum, py_isdigit, py_strip, regex_escape_char,
                              text_or_empty)
from ..plans import fixed_values as FV
from ..session import written
from .automata import MAX_AUTOMATON_CHARS, automaton_matcher, match_chunk
from .ranking import numbered

LEXICON_SCHEMA = T.StructType([
    T.StructField("seed", T.StringType(), False),
    T.StructField("seed_ord", T.LongType(), False),
    T.StructField("canonical", T.ArrayType(T.StringType()), True),
    T.StructField("jamo", T.ArrayType(T.StringType()), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("targets", T.ArrayType(T.StringType()), True),
])

MATCH_TYPE = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("seed_ord", T.LongType()),
    T.StructField("form_ord", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("seed", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("type", T.StringType()),
])

# Inline-trie bounds (checked on the lexicon before anything is collected).
MAX_INLINE_FORMS = 5000
MAX_INLINE_CHARS = 200_000


def lexicon_forms(lexicon: DataFrame) -> DataFrame:
    """One row per searchable (canonical) form. Jamo forms are not searched."""
    return (lexicon
            .select("seed", "seed_ord", "type",
                    F.posexplode(F.coalesce("canonical", F.array().cast("array<string>")))
                    .alias("form_ord", "form"))
            .where(F.col("form").isNotNull() & (F.length("form") > 0)))


# --------------------------------------------------------------------------
# trie compilation (driver side, over a size-checked lexicon)
# --------------------------------------------------------------------------

class _Node:
    __slots__ = ("children", "terminal")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.terminal = False


def _build_trie(forms) -> _Node:
    root = _Node()
    for f in forms:
        node = root
        for ch in f:
            node = node.children.setdefault(ch, _Node())
        node.terminal = True
    return root


def _node_regex(node: _Node) -> str:
    # Iterative post-order to avoid recursion limits on long forms.
    out: dict[int, str] = {}
    stack = [(node, False)]
    while stack:
        cur, done = stack.pop()
        if not done:
            stack.append((cur, True))
            for child in cur.children.values():
                stack.append((child, False))
            continue
        alts = [regex_escape_char(ch) + out[id(child)]
                for ch, child in sorted(cur.children.items())]
        if not alts:
            out[id(cur)] = ""
            continue
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        out[id(cur)] = "(?:" + body + ")?" if cur.terminal else body
    return out[id(node)]


def trie_pattern(forms) -> str:
    """Regex whose match at an offset is the longest form starting there."""
    return _node_regex(_build_trie(forms))


def prefix_closure(forms) -> dict[str, list[str]]:
    """form -> every form that is a prefix of it (itself included)."""
    fs = set(forms)
    clo = {}
    for f in fs:
        clo[f] = sorted({f[:i] for i in range(1, len(f) + 1)} & fs)
    return clo


def _quote_regex(form: Column) -> Column:
    """Java Pattern.quote as a column expression."""
    return F.concat(F.lit("\\Q"), F.replace(form, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _starts(text: Column, form: Column) -> Column:
    """0-based start offsets of the non-overlapping occurrences of ``form``:
    one literal split, then start_i = (length of parts before i) + i * |form|
    from a log-depth prefix sum (a text repeating a form k times costs
    O(k log k), not O(k^2))."""
    lens = F.transform(F.split(text, _quote_regex(form), -1), lambda p: F.length(p))

    def from_prefix(pre):
        k = F.size(pre) - 1
        return F.when(k <= 0, F.array().cast("array<int>")).otherwise(
            F.transform(F.slice(pre, 1, F.greatest(k, F.lit(1))),
                        lambda p, i: (p + i * F.length(form)).cast("int")))
    return let(prefix_sum(lens), from_prefix)


def _match_structs(text: Column, form: Column, entries: Column) -> Column:
    flen = F.length(form)
    return let(_starts(text, form), lambda starts: F.flatten(F.transform(entries, lambda e: F.transform(
        starts, lambda s: F.struct(
            s.alias("start"), e["seed_ord"].alias("seed_ord"), e["form_ord"].alias("form_ord"),
            (s + flen).cast("int").alias("end"), e["seed"].alias("seed"), form.alias("form"),
            e["type"].alias("type"))))))


def match_lexicon(df: DataFrame, lexicon: DataFrame, text_col: str = "text",
                  id_col: str = "doc_id", out_col: str = "matches",
                  max_inline_forms: int = MAX_INLINE_FORMS,
                  max_inline_chars: int = MAX_INLINE_CHARS,
                  max_automaton_chars: int = MAX_AUTOMATON_CHARS) -> DataFrame:
    """Add ``out_col``: array of match structs ordered by (start, seed_ord, form_ord).

    Every non-overlapping occurrence of every canonical form is reported;
    overlaps between different forms are kept.
    """
    return prepare_matcher(lexicon, max_inline_forms, max_inline_chars, max_automaton_chars=max_automaton_chars)(df, text_col, id_col, out_col)


def prepare_matcher(lexicon: DataFrame, max_inline_forms: int = MAX_INLINE_FORMS,
                    max_inline_chars: int = MAX_INLINE_CHARS, counts_only: bool = False,
                    max_automaton_chars: int = MAX_AUTOMATON_CHARS):
    """Compile the lexicon once; returns ``f(df, text_col, id_col, out_col)``.

    Reused across micro-batches of a stream so the lexicon is read once. With
    ``counts_only`` the output is ``array<struct<seed, form, n>>`` (matches per
    occurring form) and no offsets are computed."""
    forms = lexicon_forms(lexicon)
    # Both sizes are checked before anything is fetched.
    n, n_chars = forms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("form")), F.lit(0))).first()
    if n <= max_inline_forms and n_chars <= max_inline_chars:
        compiled = _compile_inline(forms.collect())
        return lambda df, text_col="text", id_col="doc_id", out_col="matches": _apply_inline(
            df, compiled, text_col, out_col, counts_only)
    if n_chars <= max_automaton_chars:
        find = automaton_matcher(forms, counts_only)
        return lambda df, text_col="text", id_col="doc_id", out_col="matches": df.withColumn(out_col, find(F.col(text_col)))
    return lambda df, text_col="text", id_col="doc_id", out_col="matches": _match_distributed(
        df, forms, text_col, out_col, counts_only)


def _compile_inline(rows):
    """Trie pattern and form -> (prefix forms, entries), driver side, from the
    size-checked rows.

    The table is one JSON literal that ``from_json`` turns into a constant: an
    array of small maps, indexed by the CRC of the form, so a lookup does not
    scan the lexicon and thousands of forms cost one expression to build."""
    if not rows:
        return None
    by_form: dict[str, list] = {}
    for r in rows:
        by_form.setdefault(r["form"], []).append(r)
    names = sorted(by_form)
    first_chars = "".join(regex_escape_char(c) for c in sorted({f[0] for f in names}))
    pattern = "(?=[" + first_chars + "])(?=(" + trie_pattern(names) + "))"
    clo = prefix_closure(names)
    buckets = [{} for _ in range(len(names))]
    for f in names:
        entries = [{"seed": r["seed"], "seed_ord": r["seed_ord"], "form_ord": r["form_ord"], "type": r["type"]} for r in by_form[f]]
        buckets[zlib.crc32(f.encode()) % len(buckets)][f] = {"prefixes": clo[f], "entries": entries}
    table = F.from_json(F.lit(json.dumps(buckets)), _TABLE_TYPE)
    return pattern, lambda form: F.element_at(F.get(table, F.pmod(F.crc32(form), F.lit(len(buckets))).cast("int")), form)


_ENTRY_TYPE = "struct<seed:string,seed_ord:bigint,form_ord:int,type:string>"
_TABLE_TYPE = f"array<map<string,struct<prefixes:array<string>,entries:array<{_ENTRY_TYPE}>>>>"

COUNT_TYPE = T.ArrayType(T.StructType([T.StructField("seed", T.StringType()),
                                       T.StructField("form", T.StringType()),
                                       T.StructField("n", T.IntegerType())]))


def _count_structs(text: Column, form: Column, entries: Column) -> Column:
    """(seed, form, n) per lexicon entry of an occurring form; n is the
    non-overlapping occurrence count (literal split)."""
    n = (F.size(F.split(text, _quote_regex(form), -1)) - 1).cast("int")
    return let(n, lambda k: F.transform(entries, lambda e: F.struct(
        e["seed"].alias("seed"), form.alias("form"), k.alias("n"))))


def _apply_inline(df: DataFrame, compiled, text_col: str, out_col: str, counts_only: bool = False) -> DataFrame:
    if compiled is None:
        return df.withColumn(out_col, F.array().cast(COUNT_TYPE if counts_only else T.ArrayType(MATCH_TYPE)))
    pattern, lookup = compiled
    text = text_or_empty(F.col(text_col))
    tmp = f"__{out_col}_forms"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    occurring = F.array_distinct(F.flatten(F.transform(found, lambda k: lookup(k)["prefixes"])))
    out = df.withColumn(tmp, occurring)
    structs = _count_structs if counts_only else _match_structs
    hits = F.flatten(F.transform(F.col(tmp), lambda f: structs(text, f, lookup(f)["entries"])))
    return out.withColumn(out_col, F.sort_array(hits)).drop(tmp)


#: Lengths of the grams that find forms with white space in whole texts, the longest gram
#: of a word, and the characters of a chunk of texts.
TEXT_GRAMS = (1, 2, 3, 4, 8, 16)
MAX_GRAM = 16
CHUNK_CHARS = 1_000_000


def _grams(text: Column, lengths: list) -> Column:
    """The distinct substrings of the given lengths."""
    found = [F.regexp_extract_all(text, F.lit("(?s)(?=(\\P{Cs}" + "." * (q - 1) + "))"), 1) for q in lengths]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def _match_distributed(df: DataFrame, forms: DataFrame, text_col: str, out_col: str, counts_only: bool = False,
                       chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The forms that may occur in each chunk of texts, by equi-joins, then one automaton
    per chunk over its texts.

    The rows are written and dealt into chunks of about ``chunk_chars`` characters, copies
    of a text apart, so that ids need be neither unique nor present. A form without white
    space lies in a word (a run without white space): each distinct word of all texts is
    joined once, by its substrings, with the forms, which are keyed by their first
    MAX_GRAM characters or all; only words that hold a form are joined with the chunks. A form with white space is keyed by the longest prefix of
    a length in TEXT_GRAMS, and joined with the distinct grams of each chunk. Only the
    pairs (chunk, form) are then shuffled: no text travels with a candidate, and no list
    of candidates is made per text."""
    n_chars = F.length("form")
    spaced = F.col("form").rlike(r"\s")
    prefix = F.when(spaced, F.greatest(*[F.when(n_chars >= q, q) for q in TEXT_GRAMS], F.lit(0))).otherwise(F.least(n_chars, F.lit(MAX_GRAM)))
    keyed = written(forms.groupBy("form").agg(F.collect_list(F.struct("seed", "seed_ord", "form_ord", "type")).alias("entries"))
                    .select("form", "entries", spaced.alias("spaced"), F.left("form", prefix).alias("gram")), "forms")
    # A row per length: at most MAX_GRAM + len(TEXT_GRAMS).
    lengths = sorted(tuple(r) for r in keyed.select("spaced", F.length("gram")).distinct().collect())
    in_words, in_texts = [q for s, q in lengths if not s], [q for s, q in lengths if s]
    columns = [c for c in df.columns if c != out_col]
    rows = written(df.select(*columns, F.monotonically_increasing_id().alias("__row")), "texts")
    text = text_or_empty(F.col(text_col))
    n = max(1, -(-(rows.agg(F.sum(F.length(text))).first()[0] or 0) // chunk_chars))
    chunk = F.pmod(F.xxhash64("__row"), F.lit(n))

    def exploded(src, key, array, name):
        return src.select(key, explode_kept(array).alias(name)).where(F.col(name).isNotNull())
    found = []
    if in_words:
        # twice from the texts: the words that hold a form are few, the words of each chunk many
        of_row = exploded(rows, chunk.alias("__chunk"), F.array_distinct(F.split(text, r"\s+")), "word").where("word <> ''")
        grams = exploded(of_row.select("word").distinct(), "word", _grams(F.col("word"), in_words), "gram")
        of_word = written(grams.join(keyed.where(~F.col("spaced")), "gram").where(F.col("word").contains(F.col("form"))).select("word", "form"), "words")
        in_chunk = of_row.join(of_word, "word").select("__chunk", "form").distinct()
        found.append(in_chunk.join(keyed.select("form", "entries"), "form").select("__chunk", "form", "entries"))
    if in_texts:
        grams = exploded(rows, chunk.alias("__chunk"), _grams(text, in_texts), "gram").distinct()
        found.append(grams.join(keyed.where("spaced"), "gram").select("__chunk", "form", "entries"))
    out_type = COUNT_TYPE if counts_only else T.ArrayType(MATCH_TYPE)
    if not found:
        return df.withColumn(out_col, F.array().cast(out_type))
    of_chunk = reduce(DataFrame.unionByName, found).groupBy("__chunk", "form").agg(F.first("entries").alias("entries"))
    texts = rows.select(*columns, chunk.alias("__chunk"))
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField(out_col, out_type)])
    return texts.groupBy("__chunk").cogroup(of_chunk.groupBy("__chunk")).applyInArrow(
        match_chunk(text_col, out_col, "__chunk", counts_only), schema)


def explode_matches(df: DataFrame, matches_col: str = "matches", keep=("doc_id",)) -> DataFrame:
    return (df.select(*keep, explode_kept(F.col(matches_col)).alias("m"))
            .where(F.col("m").isNotNull()).select(*keep, "m.*"))


def count_lexicon(df: DataFrame, lexicon: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  out_col: str = "counts") -> DataFrame:
    """J2 when only counts are needed: ``out_col`` = array of (seed, form, n)
    for every form occurring in the text, n = non-overlapping matches."""
    return prepare_matcher(lexicon, counts_only=True)(df, text_col, id_col, out_col)


def form_counts(matches: Column) -> Column:
    """Per text: array of (seed, form, n) with n = matches of that form, from
    one native sort of the match keys and a run-length pass, O(k log k)."""
    keys = F.sort_array(F.transform(matches, lambda m: F.struct(
        m["seed_ord"].alias("seed_ord"), m["form_ord"].alias("form_ord"),
        m["seed"].alias("seed"), m["form"].alias("form"))))

    def runs(k):
        n = F.size(k)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                          lambda i: (n > 0) & ((i == 1) | (F.element_at(k, i) != F.element_at(
                              k, F.greatest(i - 1, F.lit(1))))))
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                        F.when(F.size(starts) > 0, F.array(n + 1)).otherwise(F.array().cast("array<int>")))
        return F.zip_with(starts, ends, lambda a, b: F.struct(
            F.element_at(k, a)["seed"].alias("seed"), F.element_at(k, a)["form"].alias("form"),
            (b - a).alias("n")))
    return let(keys, runs)


# --------------------------------------------------------------------------
# A4: term mining
# --------------------------------------------------------------------------

WORD_PATTERN = r"\p{L}+"


def mine_terms(df: DataFrame, text_col: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """(term, freq): lower-cased runs of letters. Partial aggregation happens
    map-side, so a term holding a third of all tokens does not skew the shuffle."""
    words = df.select(explode_kept(F.regexp_extract_all(F.lower(text_or_empty(F.col(text_col))),
                                                        F.lit(pattern), 0)).alias("term"))
    words = words.where(F.col("term").isNotNull())
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


# --------------------------------------------------------------------------
# Cleaning mined terms
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class InsultRules:
    safe_words: list = field(default_factory=lambda: list(FV.SAFE_WORDS))
    ban_prefix: list = field(default_factory=lambda: list(FV.BAN_PREFIX))
    exception_prefix: str | None = FV.EXCEPTION_PREFIX
    safe_after_exception: list = field(default_factory=lambda: list(FV.SAFE_AFTER_EXCEPTION_PREFIX))
    fragments: list = field(default_factory=lambda: list(FV.FRAGMENTS))
    year_pattern: str = FV.YEAR_PATTERN
    year_prefix_pattern: str = FV.YEAR_PREFIX_PATTERN


def looks_like_insult(col: Column, rules: InsultRules = InsultRules()) -> Column:
    """Heuristic insult-likeness of a (stripped) token as one CASE chain; the token is
    stripped once."""
    return let(py_strip(col), lambda t: _insult_chain(t, rules))


def _insult_chain(t: Column, rules: InsultRules) -> Column:
    expr = F.when(t.isNull() | (F.length(t) < 2), F.lit(False))
    if rules.safe_words:
        expr = expr.when(t.isin(*rules.safe_words), F.lit(False))
    # (?U): Unicode \d and \b, as in Python's re on str.
    expr = expr.when(t.rlike("(?U)" + rules.year_pattern), F.lit(False))
    expr = expr.when(py_isdigit(t), F.lit(False))
    for p in rules.ban_prefix:
        hit = t.startswith(p)
        if rules.exception_prefix is not None and p == rules.exception_prefix and rules.safe_after_exception:
            nxt = F.substring(t, len(p) + 1, 1)
            expr = expr.when(hit & nxt.isin(*rules.safe_after_exception), F.lit(False))
        expr = expr.when(hit, F.lit(True))
    if rules.fragments:
        any_frag = None
        for frag in rules.fragments:
            c = t.contains(frag)
            any_frag = c if any_frag is None else (any_frag | c)
        expr = expr.when(any_frag & t.rlike("(?U)^(?:" + rules.year_prefix_pattern + ")"), F.lit(False))
        expr = expr.when(any_frag, F.lit(True))
    return expr.otherwise(F.lit(False))


def parse_count(raw: Column) -> Column:
    """Python ``int(cnt)`` with fallback 1: integer literal -> value, JSON number
    with a fraction -> truncated, anything else -> 1."""
    s = py_strip(raw)
    as_int = F.when(s.rlike(r"^[+-]?\d+$"), s.cast("long"))
    as_frac = F.when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?\d+[eE][+-]?\d+$"),
                     s.cast("double").cast("long"))
    return F.coalesce(as_int, as_frac, F.lit(1).cast("long"))


def clean_terms(terms: DataFrame, min_freq: int = FV.MIN_FREQ, rules: InsultRules = InsultRules(),
                term_col: str = "term", freq_col: str = "freq", pos_col: str | None = None) -> DataFrame:
    """Strip, keep freq >= min_freq and insult-like terms; on duplicates after
    stripping the last one (by ``pos_col``) wins, placed at its first position.

    Returns (term, freq, pos)."""
    t = terms.select(py_strip(F.col(term_col)).alias("term"),
                     F.col(freq_col).cast("long").alias("freq"),
                     (F.col(pos_col).cast("long") if pos_col else F.lit(None).cast("long")).alias("pos"))
    # One expression over both columns: the rules alone would be pushed below the count
    # of mined terms, and run on every occurrence instead of on each frequent term.
    t = t.where(F.when(F.col("freq") >= min_freq, looks_like_insult(F.col("term"), rules)))
    if pos_col is None:
        return t.groupBy("term").agg(F.max("freq").alias("freq"), F.lit(None).cast("long").alias("pos"))
    return t.groupBy("term").agg(F.max_by("freq", "pos").alias("freq"), F.min("pos").alias("pos"))


# --------------------------------------------------------------------------
# Merging mined terms into the manual lexicon
# --------------------------------------------------------------------------

def merge_lexicon(manual: DataFrame, mined: DataFrame, auto_type: str = FV.AUTO_TYPE) -> DataFrame:
    """Keep every manual seed; add a mined term only when it is neither a seed
    nor any canonical / jamo form of the manual lexicon.

    Added seeds follow the manual ones with an ordinal each, by their position
    in the mined table, else by descending frequency, then by term; the ranking
    is distributed (``numbered``)."""
    existing = (manual.select(F.explode(F.array_union(
        F.array(F.col("seed")),
        F.array_union(F.coalesce("canonical", F.array().cast("array<string>")),
                      F.coalesce("jamo", F.array().cast("array<string>"))))).alias("term"))
        .distinct())
    max_ord = manual.agg(F.max("seed_ord")).first()[0]
    base = (max_ord + 1) if max_ord is not None else 0
    # The side is broadcast if its measured size allows it; no hint.
    added = mined.join(existing, "term", "left_anti").select("term", "pos", "freq")
    added = (numbered(added, [F.asc_nulls_last("pos"), F.desc("freq"), F.asc("term")], "rank", base)
             .select(F.col("term").alias("seed"), F.col("rank").alias("seed_ord"),
                     F.array(F.col("term")).alias("canonical"),
                     F.array().cast("array<string>").alias("jamo"),
                     F.lit(auto_type).alias("type"),
                     F.array().cast("array<string>").alias("targets")))
    return manual.select(*LEXICON_SCHEMA.fieldNames()).unionByName(added)
