"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import scratch
from waymark.llm.workers import tidy

#: Edges that a task reduces at once, and rows of a round's table for each of its tasks.
PER_TASK = 100_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes: each node, but the smallest of its group, with that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        found = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, PER_TASK):
            held.append(tuple(batch.column(k).slice(at, PER_TASK).to_numpy() for k in (0, 1)))
            size += len(held[-1][0])
            if size >= PER_TASK:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows ``node``, ``root``: the smallest node of its component, for every node in ``edges`` (``a``, ``b``: longs).

    Edges are written once. Each round, the large-star and the small-star step link a node's neighbours to the smallest of them, and tasks reduce
    the edges that they hold then to stars, ``PER_TASK`` at a time. The edge table never grows by more than a node's
    own row, and ends as stars after about the square of the logarithm of the longest chain, or far sooner where
    tasks hold much of a component. A hub's neighbours are never gathered: its minimum is a partial aggregation, and the
    join back to its edges is one that adaptive execution can split.

    A round writes one table to the shared folder, in as many parts as its rows ask for; its count and hash, taken as
    it is written, tell when nothing changes. Loops and repeated edges are harmless; no edges give no rows; rows
    with a null end are ignored.
    """
    same = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    # Written as they come: edges that Python workers make would need a second worker in the same task to be reduced.
    e, was = scratch.measured(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b"), "edges", **same)
    for _ in range(rounds):
        parts = max(1, -(-was["n"] // PER_TASK))
        now = e.coalesce(parts)  # a > b
        both = now.unionByName(now.selectExpr("b a", "a b"))
        both = both.coalesce(1) if parts == 1 else both  # one task needs no exchange
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").distinct()  # a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").selectExpr("b a", "m b").unionByName(low.selectExpr("a", "m b"))
        small = (small.coalesce(1) if parts == 1 else small).distinct()
        e, after = scratch.measured(small.coalesce(parts).mapInArrow(tidy(_reduced), "a long, b long"), "round", **same)
        if after == was:
            return e.selectExpr("a node", "b root").unionByName(e.selectExpr("b node", "b root").distinct())
        was = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
