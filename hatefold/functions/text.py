"""String column helpers with Python-compatible semantics (JVM-side only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode whitespace; Spark's trim only U+0020.
# (?U) makes \s Unicode-aware in Java regex.
_STRIP_RE = r"(?U)^\s+|\s+$"


def py_strip(col: Column) -> Column:
    return F.regexp_replace(col, _STRIP_RE, "")


def py_isdigit(col: Column) -> Column:
    """str.isdigit() for the decimal-digit case (Unicode aware)."""
    return col.rlike(r"(?U)^\d+$")


def text_or_empty(col: Column) -> Column:
    """Null text is treated as empty: no match, no variant, zero tokens."""
    return F.coalesce(col, F.lit(""))


def regex_escape_char(ch: str) -> str:
    """Escape one character for a Java regex (letters/digits stay literal)."""
    if ch.isalnum() and ch.isascii():
        return ch
    return "\\x{%x}" % ord(ch)


def chars(col: Column) -> Column:
    """Code points of a string as an array (empty string -> empty array)."""
    return F.filter(F.split(col, ""), lambda c: c != F.lit(""))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable
    (keeps the optimizer from copying a costly expression into each use)."""
    return F.transform(F.array(value), fn)[0]


def explode_kept(col: Column) -> Column:
    """``explode`` written as ``explode_outer``; callers drop the null row of
    empty arrays with a filter on the output.

    A plain explode makes the optimizer infer ``size(array) > 0`` and push it
    below joins and projections, which evaluates a costly array expression
    (lexicon matching, rewriting) on rows the join would have removed, and
    twice on the rest."""
    return F.explode_outer(col)


def posexplode_kept(col: Column) -> Column:
    """``posexplode`` counterpart of :func:`explode_kept`."""
    return F.posexplode_outer(col)


def running(arr: Column, op, start) -> Column:
    """Inclusive running ``op`` (associative, ``start`` neutral) of an array.

    Two levels: blocks of about sqrt(n) elements are folded first, then each
    element folds its block's start with its own part of the block, so an
    element touches about sqrt(n) values."""
    def of(a):
        n = F.size(a)
        size = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, size)).otherwise(F.array().cast("array<int>"))
        fold = lambda x, s: F.aggregate(x, s, op)
        blocks = F.transform(starts, lambda at: F.slice(a, at + 1, size))

        def scan(bs):
            folds = F.transform(bs, lambda b: fold(b, F.lit(start)))
            return F.flatten(F.transform(bs, lambda b, i: let(fold(F.slice(folds, F.lit(1), i), F.lit(start)), lambda before: F.transform(
                b, lambda x, j: fold(F.slice(b, F.lit(1), j + 1), before)))))
        return let(blocks, scan)
    return let(arr, of)


def prefix_sum(arr: Column) -> Column:
    """Inclusive running sum of an int array."""
    return running(arr, lambda s, v: s + v, 0)
