"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each block of candidates has one list for each dimension, sorted by component. For a query, the lists are read entry by
entry from both ends inwards, all to the same product: after a step, every entry whose product is ``t`` or more, or
``-t`` or less, has been met, wherever its list stands then. So a candidate's score lies within its products met so
far, give or take ``t - 1`` for each list that it wasn't met in. These are its lower and upper bound. Reading stops when
at most ``spare`` candidates can still reach the k-th best lower bound (an upper bound equal to it counts, for ties), or
nothing is left that could change a score; the scores of those left are then resolved.

How much is read depends on the vectors: products of long tails are met soon. Even ones, as of random unit vectors
in 64 dimensions, ask for most of the lists, and no bound can change that; see the README for measured shares.

Queries meet candidates in blocks of both, each pair in a task of its own; a block's k best are merged for each
query. Nothing is broadcast and no task holds more than a block of either side.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different
length aren't compared, empty ones score 0 with each other; repeated rows are candidates each, also for each other; ties
go to the smaller id (null last); fewer candidates than k give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import scratch


#: Components of a block, and so the memory of a task.
ENTRIES = 1 << 20
#: Shares of the lists' entries after which the bounds are looked at; then to the end.
LOOKS = (0.15, 0.4, 0.6, 0.68, 0.74, 0.8, 0.87, 0.94)


class Lists:
    """A block's sorted lists, one for each dimension."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x  # candidate, dimension: integers
        self.order = np.ascontiguousarray(np.argsort(-x, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(x.T, self.order, axis=1))
        self.down = -self.values  # ascending, to find how far a product reaches
        steps = np.linspace(0, len(x) - 1, 65).astype(np.int64) if len(x) else np.zeros(0, np.int64)
        self.sizes = np.sort(np.abs(x), axis=0)[steps].T  # what a share of a list reaches, to choose where to look

    def _products(self, weights: np.ndarray) -> list[int]:
        """The products down to which about the shares of :data:`LOOKS` are read, and 1 for the end."""
        reached = np.sort((self.sizes[weights > 0] * weights[weights > 0, None]).reshape(-1))[::-1]
        held = [int(reached[int(share * len(reached))]) for share in LOOKS] if len(reached) else []
        return sorted({t for t in held if t > 1} | {1}, reverse=True)

    def best(self, query: np.ndarray, k: int, spare: int, barred: int) -> tuple[np.ndarray, float]:
        """The candidates that can hold the query's k best scores, ties included, and the share of the lists' entries read.

        ``barred`` is the query's own candidate, or -1.
        """
        n, width = self.x.shape
        if n <= spare:
            return np.arange(n), 0.0
        lists = np.flatnonzero(query).tolist()
        bits = len(lists).bit_length()
        met = np.zeros(n, np.int64)  # a candidate's products, and in the lowest bits how many
        read = [(0, n)] * len(lists)  # what lies between is unread
        for t in self._products(np.abs(query)):
            for i, d in enumerate(lists):
                reach = -(-t // abs(int(query[d])))
                a, b = self.down[d].searchsorted((-reach, reach))
                a += int(self.down[d, a:].searchsorted(-reach, "right")) if a < n and self.down[d, a] == -reach else 0
                b = max(a, b)
                for at in (slice(read[i][0], a), slice(b, read[i][1])):
                    if at.start < at.stop:
                        met[self.order[d, at]] += (self.values[d, at] * (int(query[d]) << bits)) + 1
                read[i] = (a, b)
            score = met >> bits
            spread = (t - 1) * (len(lists) - (met & ((1 << bits) - 1)))
            lower, upper = score - spread, score + spread
            if barred >= 0:
                lower[barred] = upper[barred] = np.iinfo(np.int64).min
            least = np.partition(lower, n - k)[n - k] if n >= k else np.iinfo(np.int64).min
            open_ = np.flatnonzero(upper >= least)
            if len(open_) <= spare:
                break
        return open_, sum(a + n - b for a, b in read) / (n * max(1, width))


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("x").combine_chunks()
    return values.flatten().to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)


def pair_best(candidates: pa.Table, queries: pa.Table, k: int, spare: int = 64) -> pa.Table:
    """The k best candidates of a block for each query of a block."""
    rows: list[tuple] = []
    if candidates.num_rows and queries.num_rows:
        x, y = _matrix(candidates), _matrix(queries)
        raw = candidates.column("vec_id").to_pylist()
        ids = np.array([np.iinfo(np.int64).max if v is None else v for v in raw], np.int64)
        place = {r: i for i, r in enumerate(candidates.column("row").to_pylist())}
        lists = Lists(x)
        for query, row, query_id in zip(y, queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True):
            own = place.get(row, -1)
            left, _ = lists.best(query, k, spare, own)
            left = left[left != own]
            score = x[left] @ query
            rows += [(row, query_id, raw[left[j]], int(score[j])) for j in np.lexsort((ids[left], -score))[:k].tolist()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])


def top(vectors: DataFrame, queries: Column, k: int = 5, block: int | None = None, query_block: int = 1024) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` over ``vectors`` (``vec_id``, ``x``: an array of integers as doubles, or null).

    ``queries`` is a condition over ``vec_id``; every other row is a candidate. A block has ``block`` candidates, by default
    as many as hold ``ENTRIES`` components.
    """
    sound = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("x").isNotNull() & sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("x").cast("array<long>").alias("x"))
    rows = rows.withColumn("width", F.size("x"))
    rows, about = scratch.measured(rows, "vectors", n=F.count(F.lit(1)), asked=F.count(F.when(queries, 1)), width=F.max("width"))
    blocks = -(-max(1, about["n"]) // (block or max(1, ENTRIES // max(1, about["width"] or 0))))
    query_blocks = -(-max(1, about["asked"]) // query_block)
    asked = rows.where(queries)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumns({"cb": dealt(blocks)}).withColumn("qb", each(query_blocks))
    right = asked.withColumns({"qb": dealt(query_blocks)}).withColumn("cb", each(blocks))
    keys = ["width", "cb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: pair_best(a, b, k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
