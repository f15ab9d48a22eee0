"""Removal of every passage of 200 bytes that the corpus has more than once, over suffix-sorted phrases.

Prefix-free parsing, dealt out over a cluster:

1. *Triggers.* Each text is read as bytes. A rolling hash runs over all strings of ``GRAM`` bytes; the trigger of a
   200-byte window is the smallest hash inside it. It depends on the window's bytes alone, so equal windows
   have equal triggers, wherever they stand.
2. *Phrases.* Consecutive windows with one trigger form a phrase: their bytes, including the 199 that the last
   window reaches ahead. Phrases overlap in these bytes, so that each window lies whole within one phrase.
3. *Dictionary and parse.* The parse lists, for each text, its phrases (trigger, hash of the bytes, place). A trigger
   seen once in the corpus is done with: its windows are unique. A trigger whose phrases are all the same one needs no
   sorting either: all those windows repeat. What is left are the distinct phrases under triggers that have
   several; they make the dictionary.
4. *Suffix arrays.* The dictionary is dealt out by trigger, and the suffixes of each part are sorted to a depth of 200
   bytes by prefix doubling that goes on only among ties. Since a window never leaves its phrase, the order of
   the corpus at that depth is the order of the dictionary's suffixes; the parse contributes how often each
   phrase occurs. Windows that tie with another one, or whose phrase occurs twice, are repeats.
5. Repeats go back along the parse to the texts, where covered bytes are merged and cut.

A trigger shared by very many phrases (a common passage in changing surroundings) would bring them all to one task, and no
function of a window can part them, as 199 of their 200 bytes may be the same. The windows of its distinct phrases
are compared one by one, by 128 bits of hash, and counted after a partial aggregation. Whole phrases are compared by their XXH3 hashes and
those of their triggers, two functions of 64 bits each; suffixes by their bytes.

Defined results: a null text is empty; texts under 200 bytes are kept whole; repeated rows are repeats of each other;
``doc_id`` may be null or repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import scratch
from waymark.llm.workers import tidy

WINDOW, GRAM = 200, 32
WIDTH = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
#: Windows in a phrase at most, windows of a text that are hashed at once, and bytes that are sorted at once.
LONGEST, BLOCK, SORTED = 4096, 1 << 20, 2 << 20
#: Phrases of one trigger that a task sorts at most: some 200 MB of ranks.
COMMON = 8000
U = np.uint64


class Rolling:
    """Polynomial hashes of byte strings modulo 2 ** 64, of a random table's entries."""

    def __init__(self, seed: int = 1000) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        base = int(rng.integers(1 << 62)) * 8 + 3
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, by in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, by, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:], dtype=np.uint64)
        return out

    def grams(self, sums: np.ndarray) -> np.ndarray:
        n = len(sums) - GRAM
        return _mixed((sums[GRAM:] - sums[:n]) * self.down[:n])


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(32)
    x *= U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, U(2**64 - 1))
    padded[: len(x)] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(table, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


_function = Rolling()


def _triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of ``data``: their triggers; and the hash at each byte."""
    grams = _function.grams(_function.sums(data))
    return _least(grams, WIDTH), grams


def _several(grams: np.ndarray, trigger: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each phrase holds its trigger more than once: only then can one of its windows equal another of them."""
    edge = np.full(WIDTH - 1, U(2**64 - 1))
    largest = ~_least(np.concatenate([edge, ~trigger, edge]), WIDTH)  # trigger of the windows that hold the place
    spots = np.flatnonzero(largest == grams)
    a, b = np.searchsorted(spots, start), np.searchsorted(spots, start + size + WIDTH - 1)
    phrase = np.repeat(np.arange(len(start)), b - a)
    nth = np.arange(len(phrase)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    same = grams[spots[np.repeat(a, b - a) + nth]] == trigger[start][phrase]
    return np.bincount(phrase[same], minlength=len(start)) > 1


def _phrases(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of joined texts that start at ``bounds``: text, place in ``data``, windows, trigger and hash of each phrase, and
    whether it holds its trigger more than once."""
    trigger, grams = _triggers(data)
    new = np.ones(len(trigger), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    whole = np.zeros(len(trigger) + 1, np.int64)  # windows that lie in one text
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WINDOW:
            new[a] = True
            whole[a] += 1
            whole[b - WINDOW + 1] -= 1
            new[b - WINDOW + 1 : b - WINDOW + 2] = True
    whole = np.cumsum(whole[:-1]) > 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(trigger)))
    if (size > LONGEST).any():
        parts = -(-size // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * LONGEST
        size = np.diff(np.append(start, len(trigger)))
    start, size = start[whole[start]], size[whole[start]]
    text = np.searchsorted(bounds, start, side="right") - 1
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    phrase = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), (start + size + WINDOW - 1).tolist(), strict=True)), np.uint64, len(start))
    return text, start, size, trigger[start].view(np.int64), phrase.view(np.int64), _several(grams, trigger, start, size)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (``k``, ``body``) to their phrases. Texts are joined to blocks; long ones are read in overlapping pieces."""

    def flushed(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        bounds = np.cumsum([0, *(len(x[2]) for x in held)])
        text, start, size, trigger, phrase, several = _phrases(data, bounds)
        key = np.array([x[0] for x in held], np.int64)[text]
        lo = np.array([x[1] for x in held], np.int64)[text] + start - bounds[text]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, lo, size.astype(np.int32), trigger, phrase, several)], names=["k", "lo", "n", "v", "ph", "several"])

    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for k, body in zip(batch.column("k").to_pylist(), batch.column("body"), strict=True):
            whole = body.as_py()
            for at in range(0, max(1, len(whole) - WINDOW + 1), BLOCK):
                piece = whole[at : at + BLOCK + WINDOW - 1] if len(whole) > BLOCK else whole
                if len(piece) >= WINDOW:
                    held.append((k, at, piece))
                    size += len(piece)
                if size >= BLOCK:
                    yield flushed(held)
                    held, size = [], 0
    if held:
        yield flushed(held)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict, bytes]]]:
    """Texts with the places of their dictionary phrases, to these with their bytes."""
    for batch in batches:
        out = []
        for body, wanted in zip(batch.column("body"), batch.column("wanted"), strict=True):
            whole = body.as_py()
            out += [(w, whole[w["lo"] : w["lo"] + w["n"] + WINDOW - 1]) for w in wanted.as_py()]
        yield out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary phrases with their bytes."""
    for found in _wanted(batches):
        arrays = [*(pa.array([w[c] for w, _ in found], pa.int64()) for c in ("v", "ph", "c", "n")), pa.array([data for _, data in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["v", "ph", "c", "n", "data"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary phrases to their windows: place and 128 bits of hash."""
    digest = xxhash.xxh3_128_digest

    def rows(held: list[tuple[dict, bytes]]) -> pa.RecordBatch:
        n = np.array([w["n"] for w, _ in held], np.int64)
        at = np.concatenate([np.arange(x) for x in n])
        hashes = np.frombuffer(b"".join([digest(data[i : i + WINDOW]) for w, data in held for i in range(w["n"])]), np.int64).reshape(-1, 2)
        columns = [np.repeat(np.array([w[c] for w, _ in held], np.int64), n) for c in ("v", "ph", "c")]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(at), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["v", "ph", "c", "at", "g", "h"])

    for found in _wanted(batches):
        for i in range(0, len(found), 64):
            yield rows(found[i : i + 64])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted places of a phrase's repeated windows, to the stretches that they cover."""
    for batch in batches:
        rows = []
        for v, ph, at in zip(batch.column("v").to_pylist(), batch.column("ph").to_pylist(), batch.column("at"), strict=True):
            places = at.values.to_numpy()
            cuts = np.flatnonzero(np.diff(places) > 1) + 1
            rows += [(v, ph, int(x[0]), int(x[-1]) + WINDOW) for x in np.split(places, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["v", "ph", "a", "b"])


def suffix_ranks(data: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The rank of each suffix among all, compared to ``depth`` bytes; equal ones share a rank. Bytes past the end count as 0."""
    n = len(data)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = data
    for step in (1, 2, 4):
        key[:n] = (key[:n] << U(8 * step)) | key[step : n + step]
    key = key[:n]
    rank = np.zeros(n + depth, np.int64)
    order = np.argsort(key)
    tied = key[order]
    known, where = 8, order
    first = np.append(True, tied[1:] != tied[:-1])
    base = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[where] = base + 1
    while known < depth and len(where):
        lone = first & np.append(first[1:], True)
        where, base = where[~lone], base[~lone]
        if not len(where):
            break
        step = min(known, depth - known)
        key = (rank[where] << 32) | rank[where + step]
        order = np.argsort(key)
        where, key, old = where[order], key[order], rank[where[order]]
        first = np.append(True, key[1:] != key[:-1])
        group = np.append(True, old[1:] != old[:-1])
        i = np.arange(len(where))
        base = old - 1 + np.maximum.accumulate(np.where(first, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        rank[where] = base + 1
        known += step
    return rank[:n]


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary phrases in the order of their triggers ``v``, to the stretches of each that repeat: (v, ph, from, to)."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        n, c = (rows.column(x).to_numpy() for x in ("n", "c"))
        pieces = rows.column("data").to_pylist()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = n + WINDOW - 1
        begin = np.cumsum(sizes) - sizes
        rank = suffix_ranks(data)
        window = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = rank[window]
        times = np.bincount(own, weights=np.repeat(c, n))
        twice = np.zeros(len(data) + 1, bool)
        twice[window] = times[own] >= 2
        first = np.flatnonzero(twice[:-1] & ~np.append(False, twice[:-2])) if len(data) > 1 else np.flatnonzero(twice[:-1])
        # A phrase ends in bytes where no window starts, so stretches never run over its end.
        last = np.flatnonzero(twice[:-1] & ~twice[1:])
        row = np.searchsorted(begin, first, side="right") - 1
        v, ph = (rows.column(x).to_numpy()[row] for x in ("v", "ph"))
        a, b = first - begin[row], last - begin[row] + WINDOW
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (v, ph, a, b)], names=["v", "ph", "a", "b"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("v").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if held and cut == 0 and held[-1].column("v")[-1].as_py() != g[0]:
            yield done(pa.Table.from_batches(held))
            held, size = [], 0
        while cut:  # groups that end in this batch
            ends = np.append(np.flatnonzero(g[1 : cut + 1] != g[:cut]) + 1, cut) if cut > 1 else np.array([cut])
            bytes_to = np.cumsum(batch.column("n").to_numpy() + WINDOW - 1)
            fits = ends[np.searchsorted(bytes_to[ends - 1] + size, SORTED) :]
            stop = int(fits[0]) if len(fits) else cut
            held.append(batch.slice(0, stop))
            size += int(bytes_to[stop - 1])
            if size >= SORTED:
                yield done(pa.Table.from_batches(held))
                held, size = [], 0
            batch, g, cut = batch.slice(stop), g[stop:], cut - stop
        if batch.num_rows:
            held.append(batch)
            size += int((batch.column("n").to_numpy() + WINDOW - 1).sum())
    if held:
        yield done(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, spans in zip(batch.column("body"), batch.column("spans"), strict=True):
            whole = body.as_py()
            merged: list[list[int]] = []
            for s in sorted((x["a"], x["b"]) for x in spans.as_py() or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            left, at = hashlib.sha256(), 0
            for a, b in merged:
                left.update(whole[at:a])
                at = b
            left.update(whole[at:])
            out.append((len(whole), sum(b - a for a, b in merged), len(merged), left.hexdigest(), [{"from": a, "to": b} for a, b in merged]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
        arrays = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def removed(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """For every row of ``docs`` (``doc_id``, ``text``): what goes (``spans``, in bytes, end exclusive) and digests of it.

    The texts are shuffled once; the cut of the dictionary and that of the texts read the same exchange. Triggers that occur more
    than ``common`` times have the windows of their phrases compared one by one.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long"), body.alias("body"))
    parse = scratch.stored(keyed.select("k", "body").mapInArrow(tidy(_parse), "k long, lo long, n int, v long, ph long, several boolean"), "parse")
    by_trigger = parse.groupBy("v").agg(F.count(F.lit(1)).alias("times"), F.min("ph").alias("p"), F.max("ph").alias("q"), F.max("several").alias("several"))
    kinds = by_trigger.where("times > 1 or several").selectExpr("v", "p <> q or several as mixed", f"(p <> q or several) and times > {common} as common")
    kinds, about = scratch.measured(kinds, "triggers", common=F.max("common"))
    hits = scratch.stored(parse.drop("several").join(kinds, "v"), "hits")
    whole = hits.where("not mixed").select("k", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + WINDOW - 1).alias("b"))
    mixed = hits.where("mixed")
    chosen = mixed.groupBy("v", "ph").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "lo", "n", "common")).alias("r"))
    wanted = chosen.select("v", "ph", "c", "r.*").groupBy("k", "common").agg(F.collect_list(F.struct("v", "ph", "c", "lo", "n")).alias("wanted"))
    wanted = scratch.stored(wanted, "dictionary")
    texts = keyed.repartition("k")
    phrases = lambda which: texts.join(wanted.where(which).drop("common").hint("shuffle_hash"), "k").select("doc_id", "body", "wanted")
    stretch = "v long, ph long, a long, b long"
    dictionary = phrases("not common").mapInArrow(tidy(_cut), "v long, ph long, c long, n long, data binary")
    found = dictionary.repartition("v").sortWithinPartitions("v").mapInArrow(tidy(_sorted_repeats), stretch)
    if about["common"]:
        single = scratch.stored(phrases("common").mapInArrow(tidy(_single), "v long, ph long, c long, at long, g long, h long"), "windows")
        twice = scratch.stored(single.groupBy("g", "h").agg(F.sum("c").alias("times")).where("times > 1").select("g", "h"), "repeated")
        places = single.join(twice, ["g", "h"]).groupBy("v", "ph").agg(F.sort_array(F.collect_list("at")).alias("at"))  # LONGEST at most
        found = found.unionByName(places.mapInArrow(tidy(_stretches), stretch))
    partly = mixed.join(found, ["v", "ph"]).select("k", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    spans = whole.unionByName(partly).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>"
    return texts.join(spans, "k", "left").select("doc_id", "body", "spans").mapInArrow(tidy(_kept), result)
