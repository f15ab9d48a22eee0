"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0). Documents
are counted by their pattern of votes (at most 3 ** number of rules patterns, whatever the corpus), and
expectation-maximisation over those counts estimates how often each rule is right and how common good
documents are. A document's verdict is the posterior probability that it is good, given its votes.

The estimation runs as one nested ``aggregate`` expression over the array of pattern counts, so the whole
operator is a plan of scans, projections and one small grouped aggregation.

Defined results: a null text is an empty one; a document without words fails the base rule; an empty table
gives no rows; repeated rows get the same result each; columns other than the ones named are ignored by
the rules and kept by :func:`judge`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Signs that are counted, by the name of their count.
SIGNS = {"n_symbols": "[#*$%&|<>]", "n_capitals": "[A-Z]", "n_stops": "[.,;:?]", "n_shouts": "!"}


@dataclass(frozen=True)
class Rule:
    """A named vote; ``good`` and ``bad`` are conditions over the columns of :func:`measured`."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]

    def vote(self) -> Column:
        return F.when(self.bad(), -1).when(self.good(), 1).otherwise(0)


def _share(count: str, of: str = "n_words") -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


RULES = (
    Rule("symbols", lambda: _share("n_symbols") <= 0.01, lambda: _share("n_symbols") > 0.1),
    Rule("dense_symbols", lambda: _share("n_symbols", "word_chars") <= 0.005, lambda: _share("n_symbols", "word_chars") > 0.04),
    Rule("repeats", lambda: _share("n_repeat_words") < 0.15, lambda: _share("n_repeat_words") > 0.3),
    Rule("lines", lambda: (F.col("n_lines") > 2) & (_share("n_dup_lines", "n_lines") <= 0.1), lambda: (F.col("n_dup_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
    Rule("word_length", lambda: (F.col("n_words") >= 20) & _share("word_chars").between(4.4, 6.6), lambda: (F.col("n_words") >= 20) & ~_share("word_chars").between(4.2, 7)),
    Rule("capitals", lambda: _share("n_capitals", "word_chars") < 0.15, lambda: _share("n_capitals", "word_chars") > 0.4),
    Rule("length", lambda: F.col("n_words") >= 80, lambda: F.col("n_words") < 20),
    Rule("sentences", lambda: _share("n_stops").between(0.02, 0.35), lambda: _share("n_stops") < 0.004),
    Rule("shouting", lambda: _share("n_shouts") <= 0.02, lambda: _share("n_shouts") > 0.2),
)


def measured(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs``, without ``text`` unless ``with_text``, and with the counts that the rules use.

    ``n_repeat_words`` counts the words inside three-word windows that the text has twice or more. Windows
    are compared by 64-bit hashes of their words' within one text. Where they aren't all distinct they are sorted: equal
    neighbours are the repeated ones. Texts with few repeated windows look their positions up in that short list,
    the others sort positions along.
    """
    body = "_q_text"
    keep = [c for c in docs.columns if with_text or c != text]
    d = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_q_words", F.filter(F.split(body, SPACE), lambda w: w != ""))
    d = d.withColumn("_q_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        *keep,
        F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_words"),
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        *[F.regexp_count(body, F.lit(signs)).cast("long").alias(name) for name, signs in SIGNS.items()],
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
    )
    w = F.col("_q_words")
    window = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_q_win", F.when(F.col("n_words") >= 3, F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), window)).otherwise(none))
    lone = F.size(F.array_distinct("_q_win")) == F.size("_q_win")
    d = d.drop("_q_words").withColumn("_q_sorted", F.when(lone, none).otherwise(F.sort_array("_q_win")))
    s = F.col("_q_sorted")
    d = d.withColumn("_q_twice", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    twice, win = F.col("_q_twice"), F.col("_q_win")
    spots = F.filter(F.transform(win, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
    d = d.withColumn("_q_pairs", F.when(F.size(twice) > 24, F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    pairs = F.col("_q_pairs")
    near = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
    many = F.sort_array(F.transform(F.filter(pairs, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x["p"]))
    d = d.withColumn("_q_spots", F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) > 24, many).otherwise(spots))
    at = F.col("_q_spots")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", covered.cast("long"))
    return d.drop("_q_win", "_q_sorted", "_q_twice", "_q_pairs", "_q_spots")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Belief:
    """What is held before any document is seen, as if it came from ``weight`` times the documents (one more, at least).

    It tells the classes apart, as votes alone don't say which one is good: most documents are, and few of those raise
    an alarm. Rules that contradict it move away from it.
    """

    good: float = 0.85
    alarm_good: float = 0.01
    alarm_bad: float = 0.15
    weight: float = 0.05


def estimated(patterns: DataFrame, rules: int, rounds: int = 25, belief: Belief = Belief()) -> DataFrame:
    """One row with ``prior``, ``alarm_good`` and ``alarm_bad`` (arrays, by rule) from rows of ``votes`` and ``n``.

    ``alarm_good`` is the share of a rule's votes on good documents that say bad, ``alarm_bad`` that share on
    bad documents; abstentions are no evidence. An empty table gives the belief.
    """
    held = F.collect_list(F.struct(F.col("votes"), F.col("n").cast("double").alias("n")))
    one = patterns.agg(held.alias("held"), (F.coalesce(F.sum("n"), F.lit(0)) * belief.weight + 1).alias("weight"))
    summed = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))
    begin = F.struct(F.lit(belief.good).alias("prior"), F.array_repeat(F.lit(belief.alarm_good), rules).alias("alarm_good"), F.array_repeat(F.lit(belief.alarm_bad), rules).alias("alarm_bad"))

    def step(state: Column) -> Column:
        rows = F.transform(F.col("held"), lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p["votes"], state).alias("good")))

        def again(rows: Column) -> Column:
            worth = F.col("weight")
            prior = (summed(rows, lambda r: r["n"] * r["good"]) + worth * belief.good) / (summed(rows, lambda r: r["n"]) + worth)

            def share(part, believed: float, worth: Column, k: Column) -> Column:
                said = lambda wanted: summed(rows, lambda r: F.when(wanted(F.get(r["votes"], k)), r["n"] * part(r["good"])).otherwise(0.0))
                return (said(lambda v: v == -1) + worth * believed) / (said(lambda v: v != 0) + worth)

            each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), f)
            return F.struct(
                prior.alias("prior"),
                each(lambda k: share(lambda g: g, belief.alarm_good, worth, k)).alias("alarm_good"),
                each(lambda k: share(lambda g: 1 - g, belief.alarm_bad, worth * (1 - belief.good), k)).alias("alarm_bad"),
            )

        return F.get(F.transform(F.array(rows), again), F.lit(0))

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, lambda s, _: step(s)).alias("state")).select("state.*")


def posterior(votes: Column, state: Column) -> Column:
    """The probability that a document with these votes is good."""
    said = F.transform(
        votes,
        lambda v, k: F.when(v == -1, F.log(F.get(state["alarm_good"], k) / F.get(state["alarm_bad"], k)))
        .when(v == 1, F.log((1 - F.get(state["alarm_good"], k)) / (1 - F.get(state["alarm_bad"], k))))
        .otherwise(0.0),
    )
    odds = F.aggregate(said, F.log(state["prior"] / (1 - state["prior"])), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, rounds: int = 25, with_text: bool = False) -> DataFrame:
    """Counts, ``votes``, ``base_failed``, ``p_good`` and ``kept`` for every row of ``docs``, less its text unless ``with_text``.

    ``kept`` is false where the base rule fails, else whether good is likelier than bad.
    """
    counts = measured(docs, text, with_text).withColumn("base_failed", base_failed())
    counts = scratch.stored(counts.withColumn("votes", F.array(*[r.vote().cast("int") for r in rules])), "rules")
    fitted = estimated(counts.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(rules), rounds)
    d = counts.crossJoin(F.broadcast(fitted))  # one row
    d = d.withColumn("p_good", posterior(F.col("votes"), F.struct("prior", "alarm_good", "alarm_bad"))).drop("prior", "alarm_good", "alarm_bad")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
