"""A byte-level convolutional network for document quality, trained and run in numpy.

Filters of six bytes slide over a whole text; their largest answers are taken for chunks of 1,024 bytes that overlap
by half and cover the text to its end; a hidden layer turns a chunk's answers into a logit, and the mean of a
document's logits is its probability. A filter is held as one table of 256 weights for each of its bytes, so the
convolution is a sum of table rows; rows of two bytes together are added up beforehand.

Training takes a bounded sample of labelled rows (``sample`` of each class, by a hash of the id; two chunks of each
text at hashed places); classes are weighted back to their shares. Labels of held-out rows are never read.
Everything is seeded, so a rerun gives the same network.

Defined results: a null text is empty; an empty text is scored as padding alone; without labels of both classes the
network stays untrained and scores are those of its seed; repeated rows are scored each; an empty table gives no
rows. Of columns only ``doc_id`` and ``text`` are read, and only the text counts for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.workers import tidy

WIDTH, BLOCK, FILTERS, HIDDEN = 6, 512, 24, 16
CHUNK = 2 * BLOCK
HELD_OUT = (4, 2)  # rows whose crc32 of the id leaves this remainder


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


@dataclass
class Net:
    """Filter tables (byte of the filter, byte value, filter), hidden layer, output."""

    table: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray

    @staticmethod
    def fresh(seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        a = rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32)
        return Net(table, a, np.zeros(HIDDEN, np.float32), rng.normal(0, 0.3, HIDDEN).astype(np.float32), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.a, self.b, self.c, self.d]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.a + self.b, 0) @ self.c + self.d[0]


class Scorer:
    """A trained network with the tables of two bytes."""

    def __init__(self, net: Net) -> None:
        self.net = net
        t = net.table
        self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text."""
        pad = b"\0" * (WIDTH - 1)
        joined = b"".join(x + b"\0" + pad for x in texts)  # so an empty text has one place for a filter
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(x) + 1 for x in texts])
        begin = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        nth = np.arange(blocks.sum()) - np.repeat(first, blocks)
        start = np.repeat(begin, blocks) + nth * BLOCK
        end = np.minimum(start + BLOCK, np.repeat(begin + sizes, blocks))
        two = data[:-1].astype(np.uint16) * 256 + data[1:]
        pooled = np.empty((len(start), FILTERS), np.float32)
        for i in range(0, len(start), 64):
            lo, hi = int(start[i]), int(end[min(i + 64, len(start)) - 1])
            x = self.pairs[0][two[lo:hi]]
            for j in range(1, WIDTH // 2):
                x += self.pairs[j][two[lo + 2 * j : hi + 2 * j]]
            cuts = np.stack([start[i : i + 64], end[i : i + 64]], axis=1).reshape(-1) - lo
            # Bytes between texts are in no block; the last block ends where x ends.
            pooled[i : i + 64] = np.maximum.reduceat(x, cuts[:-1], axis=0)[::2]
        ahead = np.append(np.arange(1, len(start)), len(start) - 1)
        last = nth + 1 == np.repeat(blocks, blocks)
        chunks = np.maximum(pooled, pooled[np.where(last, np.arange(len(start)), ahead)])
        # A chunk is a block and the next one; the last block alone is one only if it is the text's only one.
        use = ~last | (np.repeat(blocks, blocks) == 1)
        logit = np.where(use, self.net.logits(chunks), 0)
        mean = np.add.reduceat(logit, first) / np.maximum(blocks - 1, 1)
        return 1 / (1 + np.exp(-np.clip(mean.astype(np.float64), -40, 40)))


def trained(samples: np.ndarray, good: np.ndarray, weight: np.ndarray, seed: int = 0, rounds: int = 14, batch: int = 96) -> Net:
    """A network from chunks of bytes (a row of CHUNK + WIDTH - 1 each), labels and weights; Adam on the log loss.

    Few samples are gone over more often, up to 80 times, so that the steps add up.
    """
    net = Net.fresh(seed)
    if not len(samples) or good.min() == good.max():
        return net
    rounds = max(rounds, min(80, 30_000 // len(samples)))
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for r in range(rounds):
        order = rng.permutation(len(samples))
        rate = 0.03 * 0.5 ** (4 * r / rounds)
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x, y, w = samples[pick], good[pick], weight[pick]
            answer = net.table[0][x[:, :CHUNK]]
            for j in range(1, WIDTH):
                answer = answer + net.table[j][x[:, j : j + CHUNK]]
            at = answer.argmax(axis=1)  # row, filter
            pooled = np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0]
            pre = pooled @ net.a + net.b
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.c + net.d[0], -30, 30)))
            g = ((p - y) * w / w.sum()).astype(np.float32)
            to_hidden = g[:, None] * net.c * (pre > 0)
            to_pooled = to_hidden @ net.a.T
            to_table = np.zeros_like(net.table)
            filters = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                np.add.at(to_table[j], (np.take_along_axis(x, at + j, axis=1), filters), to_pooled)
            grads = [to_table, pooled.T @ to_hidden, to_hidden.sum(axis=0), hidden.T @ g, np.array([g.sum()])]
            step += 1
            for part, grad, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 1200, chunks: int = 2, seed: int = 0) -> Net:
    """The network for ``docs`` (``doc_id``, ``text``) with ``labels`` (``doc_id``, ``quality`` 0 or 1), from at most ``sample``
    labelled rows of each class."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Net.fresh(seed)
    ranked = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(ranked[0].unionByName(ranked[1]).withColumnRenamed("doc_id", "_id"))  # 2 * sample rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, quality in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("quality").to_pylist(), strict=True):
                data = (text.as_py() or "").encode("utf-8", "replace")
                rng = np.random.default_rng(abs(int(doc)))
                for _ in range(chunks if len(data) > CHUNK else 1):
                    a = int(rng.integers(0, max(1, len(data) - CHUNK + 1)))
                    rows.append((doc, quality, data[a : a + CHUNK + WIDTH - 1].ljust(CHUNK + WIDTH - 1, b"\0")))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "quality", "data"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("data", pa.binary())]))

    found = docs.select(F.col("doc_id").cast("long"), "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("quality").cast("int"))
    rows = sorted(map(tuple, found.mapInArrow(tidy(cut), "doc_id long, quality int, data binary").collect()))
    if not rows:
        return Net.fresh(seed)
    data = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
    good = np.array([r[1] for r in rows], np.float32)
    weight = np.where(good == 1, counts[1] / max(1, (good == 1).sum()), counts[0] / max(1, (good == 0).sum()))
    return trained(data, good, weight.astype(np.float32), seed)


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """``doc_id`` and ``score`` for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(net)
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column("text"):
                held.append((text.as_py() or "").encode("utf-8", "replace"))
                size += len(held[-1])
                if size >= 1 << 20:
                    out.append(own.scores(held))
                    held, size = [], 0
            if held:
                out.append(own.scores(held))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(work), "doc_id long, score double")
