"""Connected components of an undirected graph, by alternating stars on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready, written


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of its component, with that smallest node."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars: fewer rows, the same components."""
    for batch in batches:
        node, root = stars(*(batch.column(c).to_numpy() for c in ("node", "root")))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    ``links`` has the long columns node and root, any link any number of times; links to
    oneself and links with a null end are no links. Each round hangs all larger neighbours
    of a node under its smallest one, then all smaller ones, until every link ends at a node
    without a smaller one. Minima are taken before rows move, and the joins on nodes are
    ones that adaptive execution can split, so a node with very many links is no bottleneck.
    """
    spark = links.sparkSession
    ready(spark)
    good = links.select("node", "root").filter("node <> root")
    edges = written(good.mapInArrow(_contracted, "node long, root long").distinct(), "links")
    while True:
        both = edges.union(edges.select("root", "node"))
        low = both.groupBy("node").agg(F.min("root").alias("low"))
        low = low.select("node", F.least("node", "low").alias("low"))
        larger = (
            both.filter("root > node")
            .join(low, "node")
            .select(F.col("root").alias("node"), F.col("low").alias("root"))
        )
        large = written(larger.filter("node <> root").distinct(), "links")
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        smaller = large.join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        small = smaller.union(low.select("node", F.col("low").alias("root")))
        edges = written(
            small.filter("node <> root")
            .mapInArrow(_contracted, "node long, root long")
            .distinct(),
            "links",
        )
        # Done when every node hangs under one root, and no root hangs anywhere.
        inner = edges.join(edges.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
        double = edges.groupBy("node").count().filter("count > 1").select("node")
        if inner.select("node").union(double).isEmpty():
            return edges
