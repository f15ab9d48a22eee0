"""Near-duplicates by the exact Jaccard similarity of shingle sets.

Candidates come from MinHash bands: sets that share the part J of their shingles meet in a band's list with probability
J ** ROWS, and in one of BANDS lists nearly surely (at J = 0.8 all but 7 of 100,000 pairs). Every link is then verified on the
sets of shingle hashes themselves, so nothing below the similarity is linked.

Only distinct sets are indexed, and sets are made only for those that share a list. The pairs of short lists are verified one by
one, each once. In a longer list, every set is first verified against one leader, and what these and the short lists' links
connect is one class: near copies of one text are then done with, in proportion to their number. Sets outside a list's largest class
are held against all of other classes, in blocks that meet in tasks of their own; a task returns links that join classes, not all pairs.

Defined results: texts without words have no shingles and are one another's copies; fewer words than a shingle's make one
shingle of all words; a shingle that a text repeats counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import scratch
from waymark.llm.components import components
from waymark.llm.workers import tidy

SEED = 42
ROWS, BANDS = 5, 24
#: Lists up to this length give all their pairs.
SHORT = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 2**63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**64, ROWS * BANDS, np.uint64, endpoint=False)


def hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The hashes of a text's shingles of ``width`` words, in the order of the text."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = max(1, len(found) - width + 1), xxhash.xxh64_intdigest
    last = ends[width - 1 :] if len(found) >= width else ends[-1:]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The set of hashes of a text's shingles of ``width`` words, in order."""
    return np.unique(hashes(text, width))


def bands(found: np.ndarray) -> list[int]:
    """The keys of a set's lists; none for the empty set."""
    if not len(found):
        return []
    least = np.full(ROWS * BANDS, np.uint64(2**64 - 1))
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (_TIMES[:, None] * found[None, i : i + 2048] + _PLUS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that a worker holds the sets of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def marked(docs: DataFrame, width: int = 5, fingerprint: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """The columns of ``docs`` but its text, with the hash of its set of shingles (``id``), the keys of its lists (``bands``) and, if asked
    for, the fingerprint of its shingles (``fp``)."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    long = T.LongType()
    schema = T.StructType([*rest, T.StructField("id", long), T.StructField("bands", T.ArrayType(long)), *([T.StructField("fp", long)] if fingerprint else [])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [hashes(x.as_py(), width) for x in batch.column("text")]
            fps = [pa.array(_signed([fingerprint(h) for h in found]))] if fingerprint else []
            sets = [np.unique(h) for h in found]
            ids = _signed([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets])
            keys = pa.array([_signed(bands(s)) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(ids), keys, *fps], names=schema.names)

    return docs.select(*(f.name for f in rest), F.col("text").cast("string")).mapInArrow(tidy(work), schema)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``id`` and ``text`` to ``id`` and ``found``, the set of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = pa.array([shingles(x.as_py(), width).view(np.int64) for x in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets], names=["id", "found"])

    return texts.select("id", F.col("text").cast("string")).mapInArrow(tidy(work), "id long, found array<long>")


def joining(ids: np.ndarray, roots: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs at ``similarity`` or more, of one that ``asks`` and one of another class (``roots``), as many as join the classes; the sets
    are not empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(int(at.max()) + 1, np.int32)
    classes = np.unique(roots, return_inverse=True)[1]
    out = []
    for f in np.flatnonzero(asks).tolist():
        other = classes != classes[f]
        if not other.any():
            break  # all are one class
        own = at[starts[f] : starts[f] + sizes[f]]
        held[own] = 1
        shared = np.add.reduceat(held[at], starts)
        held[own] = 0
        hit = other & (shared / (sizes + sizes[f] - shared) >= similarity)
        for c in np.unique(classes[hit]).tolist():
            w = int(np.flatnonzero(hit & (classes == c))[0])
            out.append((int(ids[w]), int(ids[f])))
            classes[classes == c] = classes[f]
    return out


def links(docs: DataFrame, distinct: DataFrame, similarity: float, width: int = 5, block: int = 1024, candidates: DataFrame | None = None) -> DataFrame:
    """Edges ``a``, ``b`` between ids that connect all sets at ``similarity`` or more.

    ``candidates`` (``a``, ``b``) are verified first, and what they connect is one class: pairs of lists within a class are done with.
    ``distinct`` has each ``id`` once, with its ``bands`` and the key ``_k`` of a row of ``docs`` (``_k``, ``text``) that has it.
    """
    posted = distinct.select("id", F.explode("bands").alias("key"))
    counts = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).where("n > 1")
    counts, about = scratch.measured(counts, "lists", longest=F.max("n"))
    listed = scratch.stored(posted.join(counts, "key"), "listed")
    short = listed.where(F.col("n") <= SHORT).groupBy("key").agg(F.collect_list("id").alias("ids"))
    pairs = short.select(F.explode("ids").alias("a"), "ids").select("a", F.explode(F.expr("filter(ids, x -> x > a)")).alias("b"))
    long = listed.where(F.col("n") > SHORT)
    has_long = (about["longest"] or 0) > SHORT
    if has_long:
        pairs = pairs.unionByName(long.where("id <> leader").selectExpr("leader as a", "id as b"))
    pairs = scratch.stored(pairs.distinct(), "pairs")
    candidates = distinct.where("false").selectExpr("id as a", "id as b") if candidates is None else candidates
    asked = listed.select("id").unionByName(candidates.select(F.explode(F.array("a", "b")).alias("id"))).distinct().join(distinct.select("id", "_k"), "id")
    found = scratch.stored(_sets(docs.select("_k", "text").join(asked, "_k").dropDuplicates(["id"]), width), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(found.selectExpr("id as a", "found as fa"), "a").join(found.selectExpr("id as b", "found as fb"), "b")
        both = both.select("a", "b", F.size("fa").alias("na"), F.size("fb").alias("nb"), F.size(F.array_intersect("fa", "fb")).alias("shared"))
        return both.where(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) >= similarity).select("a", "b")

    first = scratch.stored(verified(candidates), "first")
    classes = scratch.stored(components(first).select("node", "root"), "classes")
    rooted = pairs.join(classes.selectExpr("node as a", "root as ra"), "a", "left").join(classes.selectExpr("node as b", "root as rb"), "b", "left")
    checked = first.unionByName(verified(rooted.where("ra is null or rb is null or ra <> rb").select("a", "b")))
    if not has_long:
        return checked
    checked = scratch.stored(checked, "checked")
    classed = long.select("key", "id").join(components(checked).selectExpr("node as id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = classed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    open_ = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    open_ = open_.select("key", "most.root", F.ceil((F.col("n") - F.col("most.m")) / block).cast("int").alias("outer"), F.ceil(F.col("n") / block).cast("int").alias("whole")).withColumnRenamed("root", "largest")
    met = scratch.stored(classed.join(scratch.stored(open_, "open"), "key"), "met")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = met.where("root <> largest").select("id", "root", F.lit(True).alias("asks"), F.explode(F.transform(each("whole"), lambda j: F.xxhash64("key", own("outer"), j))).alias("part"))
    others = met.select("id", "root", F.lit(False).alias("asks"), F.explode(F.transform(each("outer"), lambda i: F.xxhash64("key", i, own("whole")))).alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handled(rows: pa.Table) -> pa.RecordBatch:
            part = rows["part"].to_numpy()
            ids, roots, asks = (rows[c].to_numpy() for c in ("id", "root", "asks"))
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            sets = [x.values.to_numpy() for x in rows["found"]]
            edges = [e for a, b in zip(cuts, cuts[1:], strict=False) for e in joining(ids[a:b], roots[a:b], asks[a:b], sets[a:b], similarity)]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held = None
        for batch in _sliced(batches):
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            part = held["part"].to_numpy()
            cut = int(np.flatnonzero(part == part[-1])[0])  # the last part may go on in the next batch
            if cut:
                yield handled(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield handled(held)

    dealt = asking.unionByName(others).join(found, "id")
    return checked.unionByName(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(work), "a long, b long"))
