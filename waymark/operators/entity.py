"""Names that mean the same: scores, matching, clusters and their spelling."""

from __future__ import annotations

import os
import re
from collections.abc import Collection, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from waymark import rank
from waymark.functions.text import fold, split_suffix


def ratio(a: str, b: str) -> float:
    """0 to 100, by matching blocks."""
    return 100 * SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one that starts at a matching block."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    blocks = SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
    return max(ratio(short, long[max(0, m.b - m.a) : max(0, m.b - m.a) + len(short)]) for m in blocks)


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and the common words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def score(a: str, b: str) -> float:
    """The best of the three."""
    return max(ratio(a, b), partial_ratio(a, b), token_set_ratio(a, b))


@pandas_udf(T.DoubleType())
def plain_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def _counts(texts: Sequence[str]) -> np.ndarray:
    """How often each text holds each sign, signs that differ beyond the first 96 taken together by their remainder."""
    out = np.zeros((len(texts), 96), np.int32)
    for row, x in zip(out, texts, strict=True):
        np.add.at(row, np.frombuffer(x.encode("utf-32-le"), np.uint32) % 96, 1)
    return out


class Choices:
    """A bounded list of choices, and the best of them for a text.

    Of ``c`` common signs and ``n`` in the shorter text, no score exceeds ``2 c / (n + c)``, unless a word is common; so choices
    are scored in the order of that bound, and no more once it falls below the best score found.
    """

    def __init__(self, choices: Sequence[tuple[str, object]]) -> None:
        self.choices = sorted(choices, key=lambda c: (c[1], c[0]))
        low = [c.lower() for c, _ in self.choices]
        self.low, self.words = low, [set(x.split()) for x in low]
        self.counts, self.sizes = _counts(low), np.array([min(len(x), len(" ".join(set(x.split())))) for x in low])
        self.holding: dict[str, list[int]] = {}
        for i, words in enumerate(self.words):
            for w in words:
                self.holding.setdefault(w, []).append(i)

    def best(self, text: str, threshold: float) -> tuple[int, float] | None:
        words = set(text.split())
        common = np.minimum(self.counts, _counts([text])).sum(axis=1)
        shorter = np.minimum(self.sizes, min(len(text), len(" ".join(words))))
        most = 100 * np.minimum(2 * common / np.maximum(shorter + common, 1), 1)
        most[self.sizes == 0] = 100
        for w in words:
            most[self.holding.get(w, [])] = 100
        found = None
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] < threshold - 1e-9 or found and most[i] < found[1] - 1e-9:
                break
            value = score(text, self.low[i])
            if value >= threshold and (found is None or (value, -i) > (found[1], -found[0])):
                found = i, value
        return found


def matched(queries: DataFrame, choices: DataFrame, text: str, choice: str, order: str, threshold: float, block: int = 2000) -> DataFrame:
    """The best choice for each distinct query text, if it scores enough (C13): ``match`` and ``score``, ties to the first choice.

    Every distinct text is held against every choice, in blocks of ``block`` choices that come as one array each; a bound on
    the score spares most of the scoring, and loses nothing (:class:`Choices`).
    """
    q = queries.select(F.col(text).alias("text")).distinct().where("text is not null")
    c = choices.where(F.col(choice).isNotNull()).groupBy(F.col(choice).alias("choice")).agg(F.min(order).alias("o"))
    parts = -(-max(1, c.count()) // block)
    lists = c.groupBy(F.pmod(F.xxhash64("choice"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("o", "choice"))).alias("choices"))
    dealt = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            held = Choices([(x["choice"], x["o"]) for x in right["choices"].iloc[0]])
            for x in left["text"]:
                if hit := held.best(x.lower(), threshold):
                    rows.append((x, *held.choices[hit[0]], hit[1]))
        return pd.DataFrame(rows, columns=["text", "match", "o", "score"])

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("match", T.StringType()), T.StructField("o", c.schema["o"].dataType), T.StructField("score", T.DoubleType())])
    # A block of choices meets the texts in tasks of at most about 10,000 texts.
    deals = -(-max(1, q.count()) // 10_000)
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("text"), F.lit(deals)))
    lists = lists.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    pairs = dealt.groupBy("part", "deal").cogroup(lists.groupBy("part", "deal")).applyInPandas(work, schema)
    best = rank.first_by(pairs, ["text"], [F.desc("score"), "o", "match"]).select(F.col("text").alias(text), "match", "score")
    return queries.join(best, text, "left")


def close_pairs(names: DataFrame, name: str, most: int) -> DataFrame:
    """Pairs of distinct names at most ``most`` edits apart (C13), all of them.

    A name cut into ``most + 1`` pieces keeps one of them under ``most`` edits, moved by as many signs at most. So names are
    listed by their pieces, with their length and the piece's number, and asked for by the stretches of the other name that
    may hold one: an equality join.
    """
    d = names.select(F.col(name).cast("string").alias("a")).where("a is not null").distinct()
    begin = lambda i, size: F.floor(F.lit(i) * size / (most + 1)).cast("int")
    length = F.length("a")
    piece = lambda i: F.struct(length.alias("n"), F.lit(i).alias("i"), F.substring(F.col("a"), begin(i, length) + 1, begin(i + 1, length) - begin(i, length)).alias("s"))
    listed = d.select("a", F.explode(F.array(*map(piece, range(most + 1)))).alias("k")).select("a", "k.*")
    asks = []
    for other in range(-most, most + 1):
        size = length + other
        for i in range(most + 1):
            for move in range(-most, most + 1):
                at, width = begin(i, size) + move, begin(i + 1, size) - begin(i, size)
                asks.append(F.when((size >= 0) & (at >= 0) & (at + width <= length), F.struct(size.alias("n"), F.lit(i).alias("i"), F.substring(F.col("a"), at + 1, width).alias("s"))))
    asked = d.select(F.col("a").alias("b"), F.explode(F.array_distinct(F.array_compact(F.array(*asks)))).alias("k")).select("b", "k.*")
    pairs = listed.join(asked, ["n", "i", "s"]).where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


def clustered(names: DataFrame, name: str, threshold: float = 86, longer: int = 2, protect: Collection[str] = (), block: int = 4) -> DataFrame:
    """``name`` and ``alias``, the name that stands for it (O2).

    Names meet if their first ``block`` letters are the same; they are taken by frequency, then length, then alphabet, and each
    becomes the alias of all later ones that are close enough. Names that share four letters and end in different ways for three
    or more aren't close. The order matters, so a block is one task: of distinct names with their counts, not of rows, and a
    bound on the score leaves few to be scored.
    """
    kept = {p.lower() for p in protect}
    counts = names.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("name <> ''")
    counts = counts.withColumn("block", F.substring(F.regexp_replace(fold(F.lower("name")), "[^a-z]", ""), 1, block))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group["name"], group["n"], strict=True), key=lambda r: (-r[1], -len(r[0]), r[0]))
        names = [r[0] for r in rows]
        low = [x.lower() for x in names]
        counted, sizes = _counts(low), np.array([len(x) for x in low])
        letters = np.array([len(_letters(x)) for x in low])
        free = np.array([x not in kept for x in low])
        alias: dict[str, str] = {}
        for i, a in enumerate(names):
            if a in alias:
                continue
            alias[a] = a
            if not free[i]:
                continue
            rest = np.flatnonzero(free[i + 1 :] & (np.abs(letters[i + 1 :] - letters[i]) <= longer)) + i + 1
            bound = 200 * np.minimum(counted[rest], counted[i]).sum(axis=1) / np.maximum(sizes[rest] + sizes[i], 1)
            for j in rest[bound >= threshold - 1e-9].tolist():
                if names[j] not in alias and not _ends_apart(low[i], low[j]) and ratio(low[i], low[j]) >= threshold:
                    alias[names[j]] = a
        return pd.DataFrame({"name": list(alias), "alias": list(alias.values())})

    return counts.groupBy("block").applyInPandas(one, "name string, alias string")


def _letters(x: str) -> str:
    return re.sub("[^a-z]", "", x)


def _ends_apart(a: str, b: str) -> bool:
    """Whether two names begin with four common letters and either goes on for three or more of its own."""
    x, y = _letters(a), _letters(b)
    both = len(os.path.commonprefix([x, y]))
    return both >= 4 and max(len(x), len(y)) - both >= 3


def hardened(aliases: DataFrame, names: DataFrame, name: str, protect: Collection[str] = (), apart: Collection[tuple[str, str]] = (), support: int = 2) -> DataFrame:
    """Aliases without those of protected names, of pairs known to differ, and of two well supported names unless they are very
    close (O3)."""
    n = names.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    d = aliases.join(n, "name").join(n.selectExpr("name as alias", "n as n_alias"), "alias")
    close = (plain_similarity(F.lower("name"), F.lower("alias")) > 92) & (F.abs(F.length("name") - F.length("alias")) < 2)
    fine = (F.col("name") == F.col("alias")) | (F.col("n") < support) | (F.col("n_alias") < support) | close
    if protect:
        fine &= (F.col("name") == F.col("alias")) | ~F.lower("name").isin([p.lower() for p in protect])
    for a, b in apart:
        fine &= ~F.array_contains(F.array(F.array(F.lit(a), F.lit(b)), F.array(F.lit(b), F.lit(a))), F.array("name", "alias"))
    return d.select("name", F.when(fine, F.col("alias")).otherwise(F.col("name")).alias("alias"))


def unified_streets(df: DataFrame, street: str, row_id: str, threshold: float = 86, protect: Sequence[str] = (), respect_suffix: bool = False) -> DataFrame:
    """Every row's street in the most frequent spelling of its cluster, the first on ties.

    Clusters are of names without their suffix, so ``X Road`` and ``X Street`` are one unless ``respect_suffix`` (T8).
    """
    parts = df.withColumn("_parts", split_suffix(street)).withColumns({"_base": F.col("_parts.base"), "_suffix": F.col("_parts.suffix")}).drop("_parts")
    aliases = hardened(clustered(parts, "_base", threshold, protect=protect), parts, "_base", protect)
    d = parts.join(aliases.withColumnsRenamed({"name": "_base", "alias": "_alias"}), "_base", "left").withColumn("_alias", F.coalesce("_alias", "_base"))
    keys = ["_alias", "_suffix"] if respect_suffix else ["_alias"]
    lead = rank.mode_first_seen(d.where(F.col("_base") != ""), keys, street, row_id).select(*keys, F.col(street).alias("_lead"))
    return d.join(lead, keys, "left").withColumn(street, F.coalesce("_lead", street)).select(*df.columns)
