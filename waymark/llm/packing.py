"""Documents as token sequences, packed online by the sum-of-squares rule.

Each task packs the documents of its own partition. A document's whole sequences are cut off at once; its rest goes to
the fill level that leaves the least sum of squared counts of partially filled sequences (a new sequence is level 0),
read off one array of counts by level. What is still open at the end of a partition, about one sequence for each level, is
dissolved into its pieces, and those of ``POOL`` partitions are packed by one more packer under the same rule. Only what
that one leaves open is topped up: pieces of the emptiest sequences are cut to fill the gaps of the fullest. The one that is left
then is cut into powers of two, so that no sequence of the result is padded.

Lengths that don't fit together (all documents just over half a sequence, say) leave a sequence open each. A packer
tops up as soon as ``most_open`` are open, which bounds its memory.

Sequence numbers carry the partition's number above ``2 ** 33`` and the second packing above ``2 ** 62``, so they are
unique without a count of all.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import pretokens, scratch
from waymark.llm.workers import tidy

#: Bytes of text that are tokenised at once.
CHUNK = 1 << 20
#: Partitions whose open sequences are packed together.
POOL = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A piece: document, its tokens in all, where the piece starts in it, its ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Packer:
    """Places pieces of less than ``window`` ids; ``take`` returns the sequences that are finished."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # open sequences by fill level; level 0 and the full one stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def take(self, piece: Piece) -> list[list[Piece]]:
        size, window = len(piece[3]), self.window
        # Growth of the sum of squares, halved, for each level that has room.
        room = window - size
        grow = self.counts[size : window + 1] - self.counts[: room + 1] + 1.0
        grow[0] -= 0.5
        grow[room] -= 0.5
        grow[1:][self.counts[1 : room + 1] == 0] = np.inf
        level = int(np.argmin(grow))
        sequence = self.open[level].pop() if level else []
        sequence.append(piece)
        self.counts[level] -= level > 0
        self.n_open -= level > 0
        if level == room:
            return [sequence]
        self.open[level + size].append(sequence)
        self.counts[level + size] += 1
        self.n_open += 1
        return []

    def dissolved(self) -> list[Piece]:
        """The pieces of all open sequences, which are closed."""
        return [p for _, sequence in self._emptied() for p in sequence]

    def _emptied(self) -> list[tuple[int, list[Piece]]]:
        held = [(level, sequence) for level in range(self.window - 1, 0, -1) for sequence in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.counts[:] = 0
        self.n_open = 0
        return held

    def topped(self) -> list[list[Piece]]:
        """Full sequences out of the open ones: pieces of the emptiest fill the fullest. Less than one window is left open."""
        held = self._emptied()
        full: list[list[Piece]] = []
        spare: list[Piece] = []
        at, end = 0, len(held)
        while at < end:
            fill, sequence = held[at]
            at += 1
            while fill < self.window and (spare or at < end):
                if not spare:
                    end -= 1
                    spare = held[end][1]
                doc, total, start, ids = spare.pop()
                part = ids[: self.window - fill]
                sequence.append((doc, total, start, part))
                fill += len(part)
                if len(part) < len(ids):
                    spare.append((doc, total, start + len(part), ids[len(part) :]))
            if fill == self.window:
                full.append(sequence)
            else:
                spare = sequence  # the last one
        if spare:
            fill = sum(len(p[3]) for p in spare)
            self.open[fill].append(spare)
            self.counts[fill] = self.n_open = 1
        return full

    def rest(self) -> list[list[Piece]]:
        """What is left open, after :meth:`topped`, in sequences of powers of two."""
        out = []
        for pieces in (s for level in self.open for s in level):
            left = sum(len(p[3]) for p in pieces)
            room, now = 0, []
            for doc, total, start, ids in pieces:
                while len(ids):
                    if not room:
                        now, room = [], 1 << (left.bit_length() - 1)
                        out.append(now)
                    part = ids[:room]
                    now.append((doc, total, start, part))
                    start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
        return out


def tokenised(batches: Iterator[pa.RecordBatch], path: str, ranks_path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """``doc_id`` and token ids of each row, tokenised in chunks of bounded size."""
    ids = pretokens.ids(path, ranks_path)
    for batch in batches:
        docs: list[int | None] = []
        texts: list[str] = []
        size = 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            docs.append(doc)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= CHUNK:
                yield from zip(docs, ids.of(texts), strict=True)
                docs, texts, size = [], [], 0
        yield from zip(docs, ids.of(texts), strict=True)


def packed(
    docs: DataFrame, window: int = 1024, end_id: int = 0, path: str | None = None, ranks_path: str | None = None, most_open: int = 8192
) -> DataFrame:
    """One row for each piece of each document (``doc_id``, ``text``): where it starts there, and where it is packed.

    ``path`` and ``ranks_path`` are the vocabulary's two files, the same tokens in either; executors read them.
    """
    path = path or pretokens.default_path("byte_bpe_50k.json")
    ranks_path = ranks_path or pretokens.default_path("byte_bpe_50k.tiktoken")

    def packing(pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[Piece]], base: int, last: bool) -> Callable:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            partition = TaskContext.get().partitionId()
            number = base + (partition << 33)
            packer = Packer(window)
            rows: list[tuple] = []

            def close(sequences: list[list[Piece]]) -> None:
                nonlocal number
                for sequence in sequences:
                    offset = 0
                    for doc, total, start, ids in sequence:
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset, None, None))
                        offset += len(ids)
                    number += 1

            def flushed() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [()] * 9
                batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, [pa.int64()] * 8 + [pa.binary()], strict=True)], names=names)
                rows.clear()
                return batch

            for doc, total, start, ids in pieces(batches):
                whole = len(ids) - len(ids) % window
                close([[(doc, total, start + at, ids[at : at + window])] for at in range(0, whole, window)])
                if whole < len(ids):
                    close(packer.take((doc, total, start + whole, ids[whole:])))
                if packer.n_open >= most_open:
                    close(packer.topped())
                if len(rows) >= 20_000:
                    yield flushed()
            if last:
                close(packer.topped())
                close(packer.rest())
            else:
                for doc, total, start, ids in packer.dissolved():
                    rows.append((doc, start, None, None, total, None, None, partition // POOL, ids.astype("<u4").tobytes()))
            yield flushed()

        return work

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for doc, ids in tokenised(batches, path, ranks_path):
            ids = np.append(ids, np.uint32(end_id))
            yield doc, len(ids), 0, ids

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for doc, total, start, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids")), strict=True):
                yield doc, total, start, np.frombuffer(ids, "<u4")

    schema = f"{SCHEMA}, pool long, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = scratch.stored(texts.mapInArrow(tidy(packing(read, 0, False)), schema), "packed")
    second = first.where("pool is not null").repartition("pool").mapInArrow(tidy(packing(again, 1 << 62, True)), schema)
    return first.where("pool is null").unionByName(second).select(*names[:7])
