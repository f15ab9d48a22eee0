"""Near-duplicate documents by SimHash fingerprints and an inverted index over their byte positions.

A fingerprint's eight bytes are eight features (position, byte). Two fingerprints that differ in at most four
bits agree in at least four of the eight. The index lists fingerprints under *triples* of positional bytes:
twenty triples, chosen so that any four positions contain one of them (:func:`_triples`), so each pair in
question shares a list, and lists stay 2 ** 24 times shorter than the table of fingerprints rather than 2 ** 8.
A list is indexed by each single positional byte, pairs are tallied over that index by the bytes that they share,
and those that reach the guaranteed four are verified bit by bit.

Only distinct fingerprints are indexed. A task returns a forest for a list (each linked fingerprint with the smallest of
its group), not all pairs; what is linked stays linked through it. Lists too long for a task need no pairs
either (:func:`links`).

For a similarity of shingle sets rather than a number of bits (:func:`representatives`), the index gives the first candidates, each
verified on the sets themselves, as no number of bits goes with a similarity for sure. Pairs that are alike by their sets but not
by four bits come from the lists of :mod:`waymark.llm.shingles`.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any others; fewer than
four words make one shingle of all words; a null ``doc_id`` keeps its row, and groups of only such rows have a
null component; repeated rows are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import scratch, shingles
from waymark.llm.components import components
from waymark.llm.workers import tidy



def _triples() -> list[tuple[int, int, int]]:
    """Twenty triples of 0..7 such that every four positions contain one: three rings of 3, 3 and 2 positions;
    a triple within a ring, or two positions of a ring and one of the next."""
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        held = [[p for p in t if ring[p] == r] for r in range(3)]
        if any(len(h) == 3 for h in held) or any(len(held[r]) == 2 and len(held[(r + 1) % 3]) == 1 for r in range(3)):
            out.append(t)
    assert all(any(set(t) <= set(q) for t in out) for q in combinations(range(8), 4))
    return out


TRIPLES = _triples()


def summed(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes, repeats included: a bit is 1 if over half of them have it."""
    n, held = len(hashes), hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if not n:
        return 0
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        set_in += np.unpackbits(held[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text's shingles of ``width`` words."""
    return summed(shingles.hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """The columns of ``docs`` but its text, and the fingerprint as a signed long (``fp``), for every row."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found)], names=[*(f.name for f in kept), "fp"])

    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])
    return docs.select(*(f.name for f in kept), F.col("text").cast("string")).mapInArrow(tidy(work), schema)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Index:
    """Fingerprints by positional byte: for each of eight positions, the places that hold each value of the byte."""

    def __init__(self, fps: np.ndarray) -> None:
        self.fps, self.bytes = fps, fps.view(np.uint8).reshape(-1, 8)
        self.places = [np.argsort(column, kind="stable") for column in self.bytes.T]
        self.bounds = [np.searchsorted(column[at], np.arange(257)) for column, at in zip(self.bytes.T, self.places, strict=True)]

    def sharing(self, place: int, least: int) -> np.ndarray:
        """Places that share ``least`` or more positional bytes with ``place``, by a tally of its eight lists."""
        tally = np.zeros(len(self.fps), np.uint8)
        for value, places, bounds in zip(self.bytes[place].tolist(), self.places, self.bounds, strict=True):
            tally[places[bounds[value] : bounds[value + 1]]] += 1
        return np.flatnonzero(tally >= least)


def forest(fps: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its group) for the groups of a list; what a group has reached is verified no more.

    Candidates are those that a tally over the index gives the guaranteed minimum of shared bytes.
    """
    fps = fps[np.argsort(fps.view(np.int64), kind="stable")]
    index, reached = Index(fps), np.zeros(len(fps), bool)
    a, b = [], []
    for root in range(len(fps)):
        if reached[root]:
            continue
        reached[root] = True
        frontier = [root]
        while frontier:
            place = frontier.pop()
            near = index.sharing(place, 8 - most_bits)
            near = near[~reached[near]]
            near = near[_bits(fps[near], fps[place]) <= most_bits]
            reached[near] = True
            frontier += near.tolist()
            a.append(fps[near])
            b.append(np.full(len(near), fps[root]))
    return np.concatenate(a or [fps[:0]]), np.concatenate(b or [fps[:0]])


def _pairs_of_short(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The verified pairs of all short lists, those of one size at once; bits are counted for those with the minimum of shared bytes."""
    a, b = [fps[:0]], [fps[:0]]
    held = fps.view(np.uint8).reshape(-1, 8)
    for n in np.unique(sizes):
        at = starts[sizes == n]
        for i, j in combinations(range(n), 2):
            x, y = at + i, at + j
            tally = (held[x] == held[y]).sum(axis=1)
            x, y = x[tally >= 8 - most_bits], y[tally >= 8 - most_bits]
            near = _bits(fps[x], fps[y]) <= most_bits
            a.append(fps[x[near]])
            b.append(fps[y[near]])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, most_bits: int = 4, block: int = 8192) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints (``fp``, each once) linked at ``most_bits`` or fewer bits.

    Lists of up to ``block`` fingerprints are read by the task that holds them. Those of longer lists are linked through what lies
    between: two fingerprints are linked at four bits just if some 64-bit word is within two bits of both, so each names the
    2,081 words within two bits of it, and those that name a word are linked, which needs no pairs; a word is named
    by 2,081 distinct fingerprints at most.
    """
    if most_bits not in (0, 2, 4):
        raise ValueError("the index guarantees a common list up to four bits, and long lists are halved evenly")
    byte = [F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    key = [F.lit(k << 24).cast("long") + byte[x] * 65536 + byte[y] * 256 + byte[z] for k, (x, y, z) in enumerate(TRIPLES)]
    posted = distinct.select("fp", F.explode(F.array(*key)).alias("key"))
    counts, about = scratch.measured(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists", longest=F.max("n"))
    listed = posted.join(counts, "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def handled(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            short = (sizes > 1) & (sizes <= 8)
            found = [_pairs_of_short(fps, starts[short], sizes[short], most_bits)]
            found += [forest(fps[s : s + n], most_bits) for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True)]
            pairs = set(zip(*(np.concatenate(x).view(np.int64).tolist() for x in zip(*found, strict=True)), strict=True)) - seen
            seen.update(pairs)  # within one task: a pair that several lists hold leaves it once
            if len(seen) > 200_000:
                seen.clear()
            rows = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on in the next batch
            if cut:
                yield handled(key[:cut], fps[:cut])
                key, fps = key[cut:], fps[cut:]
        if len(key):
            yield handled(key, fps)

    found = listed.where(F.col("n") <= block).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(work), "a long, b long")
    if (about["longest"] or 0) > block:
        found = found.unionByName(_between(listed.where(F.col("n") > block).select("fp").distinct(), most_bits // 2))
    return found


def _between(fps: DataFrame, radius: int) -> DataFrame:
    """Edges between fingerprints that are within ``radius`` (at most two) bits of one word."""
    second = "transform(sequence(i + 1, 64), j -> shiftleft(1L, i) ^ if(j < 64, shiftleft(1L, j), 0L))"
    flips = ("array(0L)", "concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))", f"concat(array(0L), flatten(transform(sequence(0, 63), i -> {second})))")[radius]
    named = fps.select("fp", F.explode(F.expr(f"transform({flips}, x -> x ^ fp)")).alias("word"))
    held = named.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return held.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def representatives(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of its smallest ``doc_id`` (null last; ties by a hash of the
    text). Documents are linked at ``similarity`` of their sets of shingles of ``width`` words, or more, verified exactly."""
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    marked = scratch.stored(shingles.marked(keyed.select("doc_id", "text", "_k"), width, summed), "marked")
    distinct = scratch.stored(marked.groupBy("id").agg(F.min("_k").alias("_k"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    linked = components(shingles.links(keyed, distinct.drop("fp"), similarity, width, candidates=near_sets(distinct)))
    linked = scratch.stored(linked.selectExpr("node as id", "root as component"), "linked")
    grouped = marked.drop("bands", "fp").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k")).alias("m"))
    stay = scratch.stored(first.select(F.col("m._k").alias("_k")), "representatives")
    return keyed.join(stay, "_k", "left_semi").dropDuplicates(["_k"]).select(*docs.columns)


def near_sets(distinct: DataFrame, most_bits: int = 4) -> DataFrame:
    """Pairs ``a``, ``b`` of ids (``id``, ``fp``) by the index of fingerprints: sets of one fingerprint with the least of them, and those
    with each other whose fingerprints are linked."""
    heads = scratch.stored(distinct.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = distinct.join(heads, "fp").where("id <> head").selectExpr("head as a", "id as b")
    edges = links(heads.select("fp"), most_bits).distinct()
    near = edges.join(heads.selectExpr("fp as a", "head as ha"), "a").join(heads.selectExpr("fp as b", "head as hb"), "b")
    return scratch.stored(same.unionByName(near.selectExpr("ha as a", "hb as b")).distinct(), "near")


def near_duplicates(docs: DataFrame, most_bits: int = 4, width: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` reachable over links, for every row."""
    marked = scratch.stored(fingerprints(docs.select("doc_id", "text"), width), "fingerprints")
    distinct = scratch.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct.select("fp"), most_bits)).withColumnRenamed("node", "fp")
    held = linked.join(distinct, "fp")
    least = held.groupBy("root").agg(F.min("least").alias("component_id"))
    named = distinct.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left")
    # A table of its own: rows that share a fingerprint by the thousands then meet it in a join that can be split.
    named = scratch.stored(named.select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
