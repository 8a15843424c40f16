"""Language identification by Bayesian evidence fusion.

Four pieces of evidence multiply into one posterior per document:

* the text's likelihood under byte-trigram models, one per language and one
  background model (``und``) in which every trigram is as likely as any other;
* the declared markup language, by how often it goes with each language;
* the address suffix (last label of the host), likewise;
* the host, as a prior smoothed hierarchically: host -> parent domain -> all.

The last three are estimated from all documents by one grouped aggregation over
the languages that the text alone suggests; every level is smoothed with ``alpha``
pseudo-counts of the level above it, so a small host leans on its domain.

The trigram models are fitted on a bounded sample of labelled rows
(``per_language`` rows of each label, drawn by the hash of the id), for every label
that occurs (256 KB a label); everything else covers all rows.

Cases: a null text is empty; a text without a trigram has no text evidence, its
language follows from the rest, and it is not accepted if it has no letter at all; null declared,
suffix or host values are a value of their own; ties go to the language that comes
first by name; repeated rows are judged each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mix64, released, slices, small_batches, text_buffer, written

CELLS = 1 << 16
UNKNOWN = "und"
#: Trigrams overlap and are far from independent; their log-likelihood counts by this much.
TEXT_WEIGHT = 0.25


def _fold_table() -> np.ndarray:
    """Byte -> lower-case letter, or space for all that is no letter; bytes of
    multi-byte characters stay."""
    t = np.full(256, 0x20, np.uint8)
    for b in range(256):
        if 0x61 <= b <= 0x7A or b >= 0x80:
            t[b] = b
        elif 0x41 <= b <= 0x5A:
            t[b] = b + 32
    return t


def trigram_cells(buf: np.ndarray) -> np.ndarray:
    """Cell of the trigram that begins at each byte but the last two; -1 where it
    begins with a space or has two of them, so that runs of symbols say nothing."""
    t = _fold_table()[buf].astype(np.uint32)
    a, b, c = t[:-2], t[1:-1], t[2:]
    cells = (mix64(a << 16 | b << 8 | c) >> np.uint64(48)).astype(np.int32)
    cells[(a == 0x20) | ((b == 0x20) & (c == 0x20))] = -1
    return cells


def _document_cells(buf: np.ndarray, off: np.ndarray):
    """(document number, cell) of every trigram that lies within one document."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    cells = trigram_cells(buf)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    use = (cells >= 0) & (doc[:-2] == doc[2:])
    return doc[:-2][use], cells[use]


def fit(labelled, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"):
    """(languages, log-probabilities [CELLS, languages + 1]) from about
    ``per_language`` rows of each label."""
    sizes = {r[0]: r[1] for r in (labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
                                  .groupBy(F.col(label_col).cast("string").alias("l")).count().collect())}
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / sizes[l]))]) if languages else None
    model = np.empty((CELLS, len(languages) + 1), np.float32)
    model[:, -1] = -np.log(CELLS)
    if languages:
        number = {l: i for i, l in enumerate(languages)}
        draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
        sample = (labelled.filter(F.col(label_col).cast("string").isin(languages))
                  .select(F.col(label_col).cast("string").alias("l"), F.col(text_col).alias("t"), draw.alias("d"))
                  .filter(F.col("d") < share[F.col("l")]).select("l", "t"))

        def count(batches):
            for b in batches:
                label = [number[x] for x in b.column(0).to_pylist()]
                buf, off = text_buffer(b.column(1))
                for i, j in slices(off):
                    doc, cells = _document_cells(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                    which = np.array(label[i:j], np.int64)[doc]
                    at, n = np.unique(which * CELLS + cells, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at // CELLS), pa.array(at % CELLS), pa.array(n.astype(np.int64))], names=["l", "cell", "n"])

        with small_batches(labelled.sparkSession):
            rows = sample.mapInArrow(released(count), "l long, cell long, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")).toPandas()
        rows = rows.sort_values("l", kind="stable")
        label, cell, n = (rows[c].to_numpy(np.int64) for c in ("l", "cell", "n"))
        ends = np.searchsorted(label, np.arange(len(languages) + 1))
        for l, (i, j) in enumerate(zip(ends, ends[1:])):  # one label's counts at a time
            counts = np.zeros(CELLS)
            counts[cell[i:j]] = n[i:j]
            model[:, l] = np.log((counts + 0.05) / (counts.sum() + 0.05 * CELLS))
    return languages, model


def text_scores(docs, languages, model, columns, text_col: str = "text"):
    """``columns`` (column expressions by name) + ll (weighted log-likelihood per
    language, ``und`` last) + n_grams + n_letters (bytes), of every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # CELLS floats a language
    kept = docs.select(*[c.alias(k) for k, c in columns.items()], F.col(text_col).alias("__text"))
    width = len(languages) + 1
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["ll array<double>", "n_grams long", "n_letters long"])
    names, n_kept = [*columns, "ll", "n_grams", "n_letters"], len(columns)

    def run(batches):
        table, fold = shared.value, _fold_table()
        for b in batches:
            buf, off = text_buffer(b.column(n_kept))
            for i, j in slices(off):
                doc, cells = _document_cells(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.bincount(doc, minlength=j - i)
                ll = np.stack([np.bincount(doc, table[cells, k], minlength=j - i) for k in range(width)], 1) * TEXT_WEIGHT
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, j - i) for k in range(n_kept)),
                     pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * width, pa.int32()), pa.array(ll.reshape(-1))),
                     pa.array(n, pa.int64()),
                     pa.array(np.diff(np.concatenate([[0], np.cumsum(fold[buf[off[i]:off[j]]] != 0x20)])[off[i:j + 1] - off[i]]), pa.int64())],
                    names=names)

    return kept.mapInArrow(released(run), schema)


def _best(array, names):
    """The name at the (first) maximum of an array column."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(array, F.array_max(array)).cast("int"))


def identify(docs, model, id_col: str = "doc_id", text_col: str = "text", declared_col=None, host_col=None,
             suffix: bool = True, alpha: float = 20.0, threshold: float = 0.5):
    """(doc_id, lang, posterior, accepted, text_lang, declared, host, n_grams) of every row.

    ``model``: from ``fit``. ``declared_col`` and ``host_col``: names of columns, or
    None. ``suffix``: whether hosts are host names, with a suffix and a parent domain.
    """
    languages, table = model
    names = [*languages, UNKNOWN]
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col else F.lit("")
    columns = {
        "doc_id": F.col(id_col).cast("long"),
        "declared": F.coalesce(F.lower(F.col(declared_col).cast("string")), F.lit("")) if declared_col else F.lit(""),
        "host": host,
        "domain": F.regexp_extract(host, r"[^.]+\.[^.]+$", 0) if suffix else F.lit(""),
        "suffix": F.regexp_extract(host, r"[^.]+$", 0) if suffix else F.lit(""),
    }
    scored = written(text_scores(docs, languages, table, columns, text_col), "language-scores")
    guess = F.when(F.col("n_grams") > 0, _best(F.col("ll"), names))
    groups = ["declared", "suffix", "domain", "host"]
    counts = written(scored.withColumn("guess", guess).groupBy(*groups).agg(
        *[F.count(F.when(F.col("guess") == l, 1)).alias(f"n{i}") for i, l in enumerate(names)]), "language-counts")
    n = [F.col(f"n{i}") for i in range(len(names))]

    def added(of):
        return F.aggregate(F.array(*of), F.lit(0.0), lambda s, x: s + x)

    def level(keys, parent):
        """Smoothed log-shares by ``keys``: (n_i + alpha * parent_i) / (sum + alpha)."""
        g = counts.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(f"n{i}") for i, c in enumerate(n)])
        g, total = g.withColumn("total", added(n)), F.col("total")
        if parent is None:
            return g, F.array(*[(c + 1.0) / (total + float(len(names))) for c in n])
        g = g.join(parent, [k for k in keys if k in parent.columns]) if any(k in parent.columns for k in keys) else g.crossJoin(F.broadcast(parent))
        return g, F.array(*[(c + alpha * F.col("up")[i]) / (total + alpha) for i, c in enumerate(n)])

    whole, share = level([], None)
    whole = whole.select(share.alias("up"))  # one row
    domains, share = level(["domain"], whole)
    domains = domains.select("domain", share.alias("up"))
    hosts, share = level(["domain", "host"], domains)
    hosts = hosts.select("domain", "host", share.alias("prior"))

    def likelihood(key):
        """Per value of ``key``: P(value | language), smoothed by the share of the value over all languages."""
        g, _ = level([key], None)
        sums = counts.agg(*[F.sum(c).cast("double").alias(f"s{i}") for i, c in enumerate(n)])
        sums = sums.withColumn("whole", added([F.col(f"s{i}") for i in range(len(names))]))
        return g.crossJoin(F.broadcast(sums)).withColumn("usual", (F.col("total") + 1.0) / (F.col("whole") + 1.0)).select(key, F.array(*[
            (c + alpha * F.col("usual")) / (F.col(f"s{i}") + alpha) for i, c in enumerate(n)]).alias(f"of_{key}"))

    # one row per combination of evidence, then one join with the documents
    evidence = (counts.select(*groups).join(hosts, ["domain", "host"]).join(likelihood("declared"), "declared").join(likelihood("suffix"), "suffix")
                .select(*groups, F.array(*[F.log(F.col("prior")[i]) + F.log(F.col("of_declared")[i]) + F.log(F.col("of_suffix")[i])
                                           for i in range(len(names))]).alias("beside")))
    log_post = F.array(*[F.col("ll")[i] + F.col("beside")[i] for i in range(len(names))])
    best = F.array_max("lp")
    posterior = 1.0 / F.aggregate("lp", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    return (scored.join(evidence, groups).withColumn("lp", log_post)
            .select("doc_id", _best(F.col("lp"), names).alias("lang"), posterior.alias("posterior"), "n_grams", "n_letters",
                    F.when(F.col("n_grams") > 0, _best(F.col("ll"), names)).alias("text_lang"), "declared", "host")
            .select("doc_id", "lang", "posterior", ((F.col("lang") != UNKNOWN) & (F.col("posterior") >= threshold) & (F.col("n_letters") > 0)).alias("accepted"),
                    "text_lang", "declared", "host", "n_grams"))


def page_evidence(pages, url_col: str = "url", html_col: str = "html"):
    """``pages`` with __declared (lang of <html>, its first subtag) and __host."""
    return (pages.withColumn("__declared", F.lower(F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)))
            .withColumn("__host", F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)", 1))))
