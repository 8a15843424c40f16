"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import written


MAX_LINKS = 1 << 20


def _stars(batches):
    """The links of a partition, by a million, as stars around their smallest nodes:
    fewer and shorter links with the same components."""

    def star(held):
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        x, y = at.reshape(2, -1)
        low = np.arange(len(nodes))
        while (low[x] != low[y]).any():
            u, v = low[x], low[y]
            np.minimum.at(low, u, np.minimum(u, v))
            np.minimum.at(low, v, np.minimum(u, v))
            while (low[low] != low).any():
                low = low[low]
        tied = np.flatnonzero(low != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[low[tied]])], names=["a", "b"])

    held, size = [], 0
    for b in batches:
        held.append(np.stack([b.column(c).to_numpy() for c in range(2)]))
        size += b.num_rows
        if size >= MAX_LINKS:
            yield star(held)
            held, size = [], 0
    if size:
        yield star(held)


def _state(edges):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()


def components(edges):
    """(node, component) of every node of ``edges`` (a, b): the smallest node that
    links reach. Each step replaces the links by others with the same components:
    large stars tie a node's larger neighbours to its smallest one, small stars its
    smaller ones; after O(log**2) steps every node is tied to its component's smallest.
    Null ends are dropped; an empty table gives no rows."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if [t for _, t in edges.dtypes] == ["bigint"] * 2:
        edges = edges.mapInArrow(_stars, "a long, b long")
    edges = written(edges.distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select("a", F.col("m").alias("b")).union(tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(small, "links")
        before, state = state, _state(edges)
        if tuple(before) == tuple(state):
            break
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
