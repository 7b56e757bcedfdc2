"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import saved
from ._words import released


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these links and, for each, the smallest node that it reaches through them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


@released
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, batch by batch, as stars around the smallest node of each local component."""
    for batch in batches:
        a, b = (c.to_numpy() for c in batch.columns)
        nodes, roots = forest(a, b)
        far = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], ["a", "b"])


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): for every node of ``links`` the smallest node it reaches. Rows with a null end are left out.

    Each round turns the links of every partition into stars around their smallest nodes (a union-find over
    one Arrow batch at a time), then the large-star and small-star steps of Kiveris et al. (2014) with plain
    aggregations and joins. The only value the driver sees is a count and a checksum a round; every round's
    links are a table in the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null")
    loops = edges.where("a = b").select("a")
    stars = saved(edges.where("a != b").mapInArrow(_contract, "a long, b long").distinct())
    before = None
    while True:
        # large star: every neighbour above a node is tied to the smallest node next to that node
        both = stars.select("a", "b").union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")
        # small star: a node and the nodes below it are tied to the smallest of them
        large = large.distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").union(floor.select("a", F.col("low").alias("b")))
        new = saved(small.distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        stars = new
        if state == before:
            break
        before = state
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).union(loops.select(F.col("a").alias("node"), F.col("a").alias("component")))
    return found.union(roots).groupBy("node").agg(F.min("component").alias("component"))
