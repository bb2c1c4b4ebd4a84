"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task contracts at a time.
BLOCK_EDGES = 1_000_000
#: Parts that the neighbours of a node are dealt into where they meet its smallest one.
SALTS = 16


def salted(column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def copies() -> Column:
    """One row for each part."""
    return F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars (node, smallest node), by label propagation on arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a block by stars; at most as many rows leave as came."""
    held: list[pa.RecordBatch] = []
    count = 0

    def out():
        t = pa.Table.from_batches(held)
        a, b = (t.column(c).to_numpy() for c in ("a", "b"))
        child, root = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= BLOCK_EDGES:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest id reachable, for each node of ``edges`` (a long, b long).

    Isolated nodes are not listed; self loops and repeated edges do no harm; no edges give no rows.
    Each round first contracts the edges of each task, then links every neighbour of a node to the
    smallest one (large star, then small star). Rounds are written to the shared folder.
    """
    schema = "a long, b long"
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = written(edges.mapInArrow(_contract, schema).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        # only nodes with a larger neighbour link anything; a root with very many is dealt out in parts
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("top")).where("top > a")
        low = low.select("a", F.least("a", "m").alias("m"), copies())
        large = both.where("b > a").select("a", "b", salted("b")).join(low, ["a", "salt"])
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.mapInArrow(_contract, schema).distinct()
        # small star: each node (child) links its smaller neighbours, and itself, to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(low.select("a", F.col("m").alias("b"))).mapInArrow(_contract, schema).distinct()
        edges = written(small, "edges")
        # stars only: no node is both a child of one and a root of others, and no child has two roots
        stats = edges.agg(F.count("*"), F.countDistinct("a")).first()
        chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        if stats[0] == stats[1] and not chained:
            break
        state = (stats[0], stats[1])
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds: {seen}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
