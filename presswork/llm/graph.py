"""Connected components of links between numbered things, as rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same things as the links ``a``-``b``: each thing to the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links`` but the roots.

    ``links`` has two long columns ``a`` and ``b`` without nulls. Alternating
    rounds tie each node's larger, then its smaller neighbours to the least of
    them; the number of rounds grows with the logarithm of the nodes. Each round
    is written to the shared folder. Least neighbours are found by an aggregate
    and joined back through plain shuffles that Spark can split, so that a node
    may have any number of links.
    """
    ordered = (links.where("a <> b")
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges, before = stored(ordered, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        larger = (both.where("b > a").join(least, "a").where("b <> m")
                  .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        edges = stored(larger, "links")
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        met = edges.join(least, "a")
        smaller = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
                       "links")
