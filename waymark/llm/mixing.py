"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources are alike to the mixture, so they are counted by that set (the
pattern). Words flow from patterns to the sources they belong to, up to each source's target; taking a pattern's
words a first time costs nothing, each further time costs more (convex), so nothing is repeated before all else is
used. The flow has a node for each pattern and source, whose number doesn't follow the number of documents.

Then each pattern takes documents in a seeded order until its words are met, to the nearest document: the order is
the MD5 of the document's id, a seed and its text, running sums are taken in buckets of that hash and over the buckets, and
the result is one limit of the hash for each pattern and repetition. A document's share is read off its own hash.

Defined results: a null text has no words; a null source is a source, after all others; documents without words
take none; rows that share ``doc_id`` and text share the order's place and are taken together, so that a source's words
miss its target by half the largest such group at most; an empty table gives no rows. The driver holds one row for
each pattern, and plans no more than ``MOST_PATTERNS``: sources as many as hosts are to be grouped first.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm import scratch

#: Patterns of membership that the driver plans; more are refused, none is left out.
MOST_PATTERNS = 200_000
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """Words wanted of each source: ``share`` of all words by weight, at most ``most`` times a source's own size.

    What a source can't take is shared again by weight among the others until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * weight[s] > most * sizes[s]]
        for s in over or open_:
            out[s] = Fraction(most * sizes[s]) if over else rate * weight[s]
            left -= out[s]
        open_ -= set(over or open_)
    return out


def flow(patterns: dict[frozenset, int], wanted: dict, most: int = 2) -> dict[frozenset, int]:
    """Words that each pattern gives, so that sources (members of patterns) get what is wanted, repetitions last.

    Successive shortest paths, each connected part of the graph by itself.
    """
    beside = defaultdict(set)
    for p in patterns:
        for s in p:
            beside[s].add(p)
    out, seen = {}, set()
    for first in sorted(patterns, key=lambda p: sorted(map(str, p))):
        if first in seen:
            continue
        part, queue = {first}, [first]
        while queue:
            for s in queue.pop():
                for p in beside[s] - part:
                    part.add(p)
                    queue.append(p)
        seen |= part
        out |= _flow({p: patterns[p] for p in part}, {s: wanted[s] for s in set().union(*part)}, most)
    return out


def _flow(patterns: dict[frozenset, int], wanted: dict, most: int) -> dict[frozenset, int]:
    edges: list[list] = []  # to, room, cost; each second one goes back
    at = defaultdict(list)

    def edge(a, b, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            at[x].append(len(edges))
            edges.append([y, r, c])

    first = {}
    for p in sorted(patterns, key=lambda p: sorted(map(str, p))):
        first[p] = len(edges)
        for r in range(most):
            edge("from", ("p", p), patterns[p], r)
        for s in sorted(p, key=str):
            edge(("p", p), ("s", s), sum(wanted.values()), 0)
    for s, n in wanted.items():
        edge(("s", s), "to", n, 0)
    while True:
        cost, by, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in at[a]:
                b, room, c = edges[e]
                if room and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], by[b] = cost[a] + c, e
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in by:
            return {p: sum(edges[first[p] + 2 * r + 1][1] for r in range(most)) for p in patterns}
        path, b = [], "to"
        while b != "from":
            path.append(by[b])
            b = edges[by[b] ^ 1][0]
        n = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= n
            edges[e ^ 1][1] += n


def order_of(doc_id: str, text: str, seed: int) -> Column:
    """A document's place in the seeded order: the text is in it, so that rows without an id, or with one id, are apart."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(blank(doc_id), F.lit(f":{seed}:"), blank(text)))


def _by_size(table: DataFrame, rows: int) -> DataFrame:
    """A table made on the driver, of known length; marked for broadcast up to 100,000 rows, joined by a shuffle beyond."""
    return F.broadcast(table) if rows <= 100_000 else table


def limits(sized: DataFrame, gives: Iterable[tuple[str, int, int]], most: int = 2) -> DataFrame:
    """``pattern`` and, for each repetition, the largest hash that is taken (``limit_1``…; null: none).

    ``sized`` has ``pattern``, ``size`` and ``at`` (the hash) for each document; ``gives`` the words that each pattern
    gives and has. A document is taken if the middle of its words lies within what its pattern gives.
    """
    spark = sized.sparkSession
    gives = list(gives)
    given = _by_size(spark.createDataFrame(gives, "pattern string, gives long, has long"), len(gives))
    # Buckets hold some hundreds of documents each, and a pattern has 65,536 of them at most.
    n = sized.count()
    digits = next(d for d in (1, 2, 3, 4) if n <= 256 * 16**d or d == 4)
    bucketed = sized.withColumn("bucket", F.substring("at", 1, digits))
    sums = bucketed.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("pattern", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("pattern", "bucket").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = bucketed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, ["pattern", "bucket"]).join(given, "pattern")
    middle = 2 * (F.col("before") + F.col("inside")) + F.col("size")
    part = lambda r: F.least(F.greatest(F.col("gives") - r * F.col("has"), F.lit(0)), F.col("has"))
    taken = [F.max(F.when((part(r) > 0) & (middle <= 2 * part(r)), F.col("at"))).alias(f"limit_{r + 1}") for r in range(most)]
    return placed.groupBy("pattern").agg(*taken)


def planned(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 0, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """The documents (``doc_id``, ``pattern``, ``size``, ``at``), and for each pattern its sources' ``source_size`` and
    ``target`` (of its first source) with the limits. ``docs`` has ``doc_id``, ``text`` and ``sources`` (an array)."""
    pattern = F.to_json(F.array_sort(F.array_distinct("sources")), {"ignoreNullFields": "false"})
    sized = scratch.stored(docs.select(F.col("doc_id").cast("long"), pattern.alias("pattern"), F.array_sort(F.array_distinct("sources")).alias("sources"), n_words().alias("size"), order_of("doc_id", "text", seed).alias("at")), "sizes")
    found = sized.groupBy("pattern", "sources").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()  # a row for each pattern
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources: group the rare sources before mixing")
    sizes: dict[str | None, int] = defaultdict(int)
    for row in found:
        for s in row.sources:
            sizes[s] += row.size
    wanted = targets(sizes, weights, most=most) if sizes else {}
    whole = {s: int(t + Fraction(1, 2)) for s, t in wanted.items()}
    gives = flow({frozenset(r.sources): r.size for r in found if r.sources}, whole, most)
    rows = [(r.pattern, gives.get(frozenset(r.sources), 0), r.size) for r in found]
    about = [(r.pattern, sizes[r.sources[0]], round(float(wanted[r.sources[0]]), 6)) for r in found if r.sources]
    spark = docs.sparkSession
    table = spark.createDataFrame(about, "pattern string, source_size long, target double")
    return sized, _by_size(scratch.stored(table.join(limits(sized, rows, most), "pattern", "left"), "limits"), len(about))


def copies(most: int = 2) -> Column:
    """How often a document (``at``) is taken under its pattern's limits."""
    return sum((F.coalesce((F.col("at") <= F.col(f"limit_{r + 1}")).cast("int"), F.lit(0)) for r in range(most)), F.lit(0))


def sampled(docs: DataFrame, source: str = "source", weights: Sequence[int] = (5, 2, 1), seed: int = 0, most: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each as often as it takes them.

    Every document finds the limits by its pattern and decides by its own hash; texts aren't shuffled as long as the
    table of patterns is small enough to be broadcast, which Spark decides by its size.
    """
    own = docs.withColumn("_sources", F.array(source))
    _, table = planned(own.select("doc_id", "text", F.col("_sources").alias("sources")), weights, seed, most)
    table = table.withColumnRenamed("pattern", "_pattern")
    pattern = F.to_json(F.array_sort(F.array_distinct("_sources")), {"ignoreNullFields": "false"})
    d = own.withColumns({"_pattern": pattern, "at": order_of("doc_id", "text", seed)}).join(table.select("_pattern", *[f"limit_{r + 1}" for r in range(most)]), "_pattern")
    d = d.withColumn("_copies", F.when(n_words() > 0, copies(most)).otherwise(0)).where("_copies > 0")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 0, most: int = 2) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs``."""
    sized, table = planned(docs, weights, seed, most)
    joined = sized.join(table, "pattern", "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(most)).cast("long").alias("taken"))
