"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token's best segmentation is the one with the highest sum of its tokens' scores (ties: fewer tokens). The
forward value of a prefix (best score, tokens) is the same for all pre-tokens that begin with it; so distinct
pre-tokens are walked as a trie, in depth-first order (sorted order: the path to a node is what a word shares
with the one before), and each node's value is computed once from the values on its path. Terminal nodes'
values are kept for later batches; documents add them up. Pre-tokens of more than ``LONG`` bytes go by themselves. Documents stay where they are: nothing is shuffled.

Scores come from the vocabulary file's order: the token of rank r has the log-probability of Zipf's law, held as an
integer in units of 2 ** -20 so that sums are exact.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated rows are counted each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import pretokens
from waymark.llm.workers import tidy

UNIT = 1 << 20
#: Bytes of a pre-token beyond which it is scored by itself: its values would fill the path, and nobody shares them.
LONG = 1 << 16


def scores(path: str) -> dict[bytes, int]:
    """The integer log-probability of each token of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    total = sum(1 / (r + 1) for r in ranks.values())
    return {token: round(-math.log((r + 1) * total) * UNIT) for token, r in ranks.items()}


class Counter:
    """Best segmentations of pre-tokens; remembers up to ``held`` of them between batches."""

    def __init__(self, path: str, held: int = 1_000_000) -> None:
        own = scores(path)
        #: Every ending of every token, with the score of those that are tokens themselves.
        self._endings: dict[bytes, int | None] = {}
        for token in own:
            for i in range(len(token)):
                self._endings.setdefault(token[i:])
        self._endings |= own
        self._longest = max(map(len, own), default=1)
        self.known: dict[bytes, tuple[int, int]] = {}  # pre-token: score, tokens
        self._held = held

    def learn(self, words: set[bytes]) -> None:
        """Walk the trie of the words that aren't known yet."""
        if len(self.known) > self._held:
            self.known = {}
        path: list[tuple[int, int]] = [(0, 0)]  # values of the nodes on the way to the last word
        endings, known, last = self._endings, self.known, b""
        for word in sorted(w for w in words - known.keys() if len(w) <= LONG):
            n = shared = min(len(word), len(last))
            if word[:n] != last[:n]:
                shared = next(i for i in range(n) if word[i] != last[i])
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = (-(1 << 62), 0)
                for begin in range(end - 1, -1, -1):
                    ending = word[begin:end]
                    if ending not in endings:
                        break  # no token ends in it, nor in anything longer
                    if (score := endings[ending]) is not None:
                        before = path[begin]
                        best = max(best, (before[0] + score, before[1] - 1))  # fewer tokens are a larger -n
                path.append(best)
            known[word] = (path[-1][0], -path[-1][1])
            last = word

    def alone(self, word: bytes) -> tuple[int, int]:
        """Score and tokens of a pre-token too long for the trie; only the values that a token can reach back to are held."""
        held = [(0, 0)] * (self._longest + 1)
        for end in range(1, len(word) + 1):
            best = (-(1 << 62), 0)
            for begin in range(end - 1, max(-1, end - self._longest - 1), -1):
                ending = word[begin:end]
                if ending not in self._endings:
                    break
                if (score := self._endings[ending]) is not None:
                    before = held[begin % len(held)]
                    best = max(best, (before[0] + score, before[1] - 1))
            held[end % len(held)] = best
        return held[len(word) % len(held)][0], -held[len(word) % len(held)][1]

    def of(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Pre-tokens, tokens and score of each text."""
        plain = [i for i, t in enumerate(texts) if not pretokens.is_odd(t)]
        cuts: list[list[bytes]] = [[]] * len(texts)
        data, starts, count = pretokens.cut([texts[i] for i in plain])
        body, at = data.tobytes(), starts.tolist()
        words = list(map(body.__getitem__, map(slice, at, at[1:])))
        first = 0
        for i, n in zip(plain, count.tolist(), strict=True):
            cuts[i] = words[first : first + n]
            first += n
        for i in set(range(len(texts))) - set(plain):
            cuts[i] = pretokens.plain_cut(texts[i])
        self.learn({w for c in cuts for w in c})
        out = []
        for c in cuts:
            values = np.array([self.known[w] if len(w) <= LONG else self.alone(w) for w in c], np.int64).reshape(-1, 2).sum(axis=0)
            out.append((len(c), int(values[1]), int(values[0])))
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    """One for each worker process and vocabulary."""
    return Counter(path)


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_pretokens``, ``n_tokens`` and ``log_prob`` (of the best segmentations) for every row."""
    path = path or pretokens.default_path("byte_bpe_50k.tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            texts: list[str] = []
            size = 0
            for text in batch.column("text"):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= 1 << 20:
                    found += own.of(texts)
                    texts, size = [], 0
            found += own.of(texts)
            table = np.array(found, np.int64).reshape(-1, 3)
            columns = [batch.column("doc_id"), pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array(table[:, 2] / UNIT)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(work), "doc_id long, n_pretokens long, n_tokens long, log_prob double")
