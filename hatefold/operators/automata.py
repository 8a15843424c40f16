"""Lexicon matching (J2) by partitioned automata: the tier between the inlined trie and
the distributed q-gram join.

The forms, sorted, are cut into shards of bounded size, so that a shard holds the forms
between two prefixes; all shards travel as one broadcast, behind a check of its size. A
task turns a shard into an Aho-Corasick automaton when it meets the first text with one
of the shard's first characters, and runs each text through the shards it may match. The
matcher is a column expression over the text alone: no row is moved, and no other column
passes through Python.

The join (``match_chunk``) uses the same automata, one for each chunk of texts, of the
forms that may occur in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all forms together, which the driver and every Python worker hold (some
#: hundred bytes a character there), and of a shard.
MAX_AUTOMATON_CHARS = 2_000_000
SHARD_CHARS = 500_000

_MATCH = "array<struct<start:int,seed_ord:bigint,form_ord:int,end:int,seed:string,form:string,type:string>>"
_COUNT = "array<struct<seed:string,form:string,n:int>>"


def shards(rows, shard_chars: int = SHARD_CHARS) -> list:
    """[(first characters, [(form, [(seed, seed_ord, form_ord, type)])])] from rows (form, seed, seed_ord, form_ord, type)."""
    by_form: dict[str, list] = {}
    for r in rows:
        by_form.setdefault(r["form"], []).append((r["seed"], r["seed_ord"], r["form_ord"], r["type"]))
    out, size = [], shard_chars
    for form in sorted(by_form):
        if size >= shard_chars:
            out.append((set(), []))
            size = 0
        out[-1][0].add(form[0])
        out[-1][1].append((form, by_form[form]))
        size += len(form)
    return out


def automaton(entries):
    """Aho-Corasick automaton over [(form, own entries)], not empty."""
    import ahocorasick
    made = ahocorasick.Automaton()
    for form, own in entries:
        made.add_word(form, (form, own))
    made.make_automaton()
    return made


def found(texts, automata, counts_only: bool):
    """Arrow array of the matches, or counts, of each text in ``automata(text)``."""
    import pyarrow as pa

    def occurrences(text: str):
        """(start, form, entries) left to right, none overlapping an earlier one of the form."""
        for a in automata(text):
            free: dict[str, int] = {}
            for last, (form, own) in a.iter(text):
                start = last + 1 - len(form)
                if start >= free.get(form, 0):
                    free[form] = last + 1
                    yield start, form, own

    def matches(text: str):
        return sorted(((s, o, k, s + len(form), seed, form, kind) for s, form, own in occurrences(text) for seed, o, k, kind in own),
                      key=lambda m: tuple((x is not None, x) for x in m))

    def counts(text: str):
        n: dict = {}
        for _, form, own in occurrences(text):
            n[form] = (own, n.get(form, (None, 0))[1] + 1)
        return sorted((seed, form, k) for form, (own, k) in n.items() for seed, *_ in own)

    ends, rows = [0], []
    for text in texts.to_pylist():
        if text:
            rows += counts(text) if counts_only else matches(text)
        ends.append(len(rows))
    names, kinds = (("seed", "form", "n"), (pa.string(), pa.string(), pa.int32())) if counts_only else (
        ("start", "seed_ord", "form_ord", "end", "seed", "form", "type"),
        (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))
    columns = list(zip(*rows)) or [()] * len(names)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


#: Rows of a chunk whose matches are made and sent at a time.
ROWS_PER_BATCH = 64


def match_chunk(text_col: str, out_col: str, key: str, counts_only: bool):
    """Function of two Arrow tables, the rows of a chunk and the forms (form, entries) that
    may occur in it: the rows without ``key``, with their matches."""
    def run(rows, forms):
        import pyarrow as pa
        entries = [(form, [(e["seed"], e["seed_ord"], e["form_ord"], e["type"]) for e in own])
                   for form, own in zip(forms["form"].to_pylist(), forms["entries"].to_pylist())]
        made = [automaton(entries)] if entries else []
        rows, parts = rows.drop_columns([key]), []
        for at in range(0, max(rows.num_rows, 1), ROWS_PER_BATCH):
            part = rows.slice(at, ROWS_PER_BATCH)
            parts.append(part.append_column(out_col, found(part[text_col], lambda text: made, counts_only)))
        return pa.concat_tables(parts)
    return run


def automaton_matcher(forms: DataFrame, counts_only: bool = False, shard_chars: int = SHARD_CHARS):
    """``f(text column) -> Column``: the matches of every form, or with ``counts_only``
    (seed, form, n), as the inlined matcher gives them. ``forms`` is fetched here: check
    its size first."""
    sent = forms.sparkSession.sparkContext.broadcast(shards(forms.select("form", "seed", "seed_ord", "form_ord", "type").collect(), shard_chars))
    built: dict = {}

    def automata(text: str):
        here = set(text)
        for k, (heads, entries) in enumerate(sent.value):
            if heads.isdisjoint(here):
                continue
            if k not in built:
                built[k] = automaton(entries)
            yield built[k]

    def run(texts):
        return found(texts, automata, counts_only)

    import pyarrow as pa
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, _COUNT if counts_only else _MATCH)

    def matcher(text: Column) -> Column:
        return udf(text)
    return matcher
