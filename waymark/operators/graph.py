"""Graphs as edge tables: components, paths, dependency counts, contracts, roles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import rank
from waymark.stage import cut, written


def resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` from references (``a``, ``ref``) to nodes (``node``): by full name, else by base name, the first by name."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]+)$", 1))
    r = refs.withColumn("_base", base("ref"))
    whole = r.join(nodes, F.lower("ref") == F.lower("node")).select("a", "ref", F.lit(1).alias("tier"), "node")
    short = r.join(nodes.withColumn("_base", base("node")), "_base").select("a", "ref", F.lit(2).alias("tier"), "node")
    return rank.first_by(whole.unionByName(short), ["a", "ref"], ["tier", "node"]).selectExpr("a", "node as b").where("a <> b").distinct()


#: Edges that a task brings down to stars at once, and rows of a round's table for each of its tasks.
PER_TASK = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same nodes as a task's own: each node, but the smallest of its group there, with that one."""

    def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        edges = pa.Table.from_batches(held).combine_chunks()
        a, b = (edges.column(c).combine_chunks() for c in (0, 1))
        nodes = pc.unique(pa.concat_arrays([a, b]))
        nodes = nodes.take(pc.sort_indices(nodes))
        x, y = (pc.index_in(c, nodes).to_numpy() for c in (a, b))
        root = np.arange(len(nodes))
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
            x, y = root[x], root[y]
            x, y = x[x != y], y[x != y]
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, PER_TASK):
            held.append(batch.slice(at, PER_TASK))
            size += held[-1].num_rows
            if size >= PER_TASK:
                yield reduced(held)
                held, size = [], 0
    if held:
        yield reduced(held)


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 50) -> DataFrame:
    """``node``, ``component`` (its smallest node) and ``size`` for all nodes (P2); nodes are of one type that has an order.

    Tasks bring the edges that they hold down to stars. Rounds then link the neighbours of each node to the smallest of them, first
    the larger ones and then the smaller, and reduce again; a hub's neighbours are never gathered. A round writes one table, in as
    many parts as its rows ask for, and ends the search if it is that of the round before, by its count and hash.
    """
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    same = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    plain = edges.select("a", F.col("b").cast(kind).alias("b"))
    every = plain.where("a <> b").select(F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col("node").cast(kind).alias("node")))
    e, was = written(plain.where("a <> b").mapInArrow(_stars, schema), "edges", **same)
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
        e, after = written(small.coalesce(parts).mapInArrow(_stars, schema), "round", **same)
        if after == was:
            break
        was = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = every.where("node is not null").distinct().join(e.selectExpr("a as node", "b as root"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "component").select("node", "component", "size")


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, longest: int = 6) -> DataFrame:
    """A shortest path of at most ``longest`` edges between sources and targets (``node``), the first by name.

    Each round keeps one path for every pair of source and node reached, so rows never exceed those pairs.
    """
    e = edges.select("a", "b").distinct()
    front = sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    reached = front
    for _ in range(longest):
        step = front.join(e, front.at == e.a).select("source", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        step = step.join(reached.select("source", "at"), ["source", "at"], "left_anti").groupBy("source", "at").agg(F.min("path").alias("path"))
        front = cut(step)
        reached = cut(reached.unionByName(front))
        if front.isEmpty():
            break
    hit = reached.join(targets.select(F.col("node").alias("at")).distinct(), "at").where("source <> at")
    return hit.select("source", F.col("at").alias("target"), (F.size("path") - 1).alias("length"), "path")


def in_degrees(edges: DataFrame) -> DataFrame:
    """P4."""
    return edges.select("a", "b").distinct().groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def bucket_edges(edges: DataFrame, bucket: Column, of: Column, top: int = 12) -> DataFrame:
    """Edges between different buckets, the ``top`` pairs (P4); ``bucket`` and ``of`` are over ``a`` and ``b``."""
    pairs = edges.select(bucket.alias("from_bucket"), of.alias("to_bucket")).where("from_bucket <> to_bucket")
    return pairs.groupBy("from_bucket", "to_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_bucket", "to_bucket").limit(top)


def produced_for(writes: DataFrame, reads: DataFrame, most: int = 6) -> DataFrame:
    """Producers and consumers of a file by base name (P5), ``most`` of either for each file, as a report shows them."""
    def first(d: DataFrame, c: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("file").orderBy(c))
        return d.select(F.lower(F.regexp_extract("file", r"([^/\\]+)$", 1)).alias("file"), c).distinct().withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")

    return first(writes, "producer").join(first(reads, "consumer"), "file").where("producer <> consumer")


def shared(df: DataFrame, item: str, by: str) -> DataFrame:
    """Items that several use."""
    return df.select(item, by).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def labelled(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that a text meets."""
    found = F.lit(otherwise)
    for pattern, label in reversed(rules):
        found = F.when(text.rlike(pattern), label).otherwise(found)
    return found
