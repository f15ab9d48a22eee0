"""Outcomes: which side a row goes to, why, and how many went where."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.numbers import loose_number, merge_unit
from waymark.functions.text import _col, append_note, blank, canon_text


@dataclass(frozen=True)
class Vocabulary:
    """Words that decide outcomes. The caller's own; the engine ships only the neutral ones."""

    clean: Sequence[str] = ("pass", "ok")
    skipped: Sequence[str] = ()  # statuses that aren't retried
    promoted: Sequence[str] = ()  # statuses that make a failed row clean again …
    kept_failed: Sequence[str] = ("duplicate",)  # … unless its outcome is one of these
    labels: Mapping[str, str] = field(default_factory=dict)  # status: outcome
    display_order: Sequence[str] = ("Pass", "Fail", "Duplicate")


def first_set(*columns: Column | str) -> Column:
    """The first value that isn't blank, trimmed; blank if none is."""
    return F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in columns], F.lit(""))


def is_clean(*columns: Column | str, words: Vocabulary = Vocabulary()) -> Column:
    """B4."""
    return F.lower(first_set(*columns)).isin(list(words.clean))


def routed(df: DataFrame, *columns: str, words: Vocabulary = Vocabulary()) -> DataFrame:
    """``route``: ``clean`` or ``fail`` for every row (B5); routing what is routed changes nothing."""
    return df.withColumn("route", F.when(is_clean(*columns, words=words), "clean").otherwise("fail"))


def route_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def is_retryable(outcome: Column | str, status: Column | str, words: Vocabulary) -> Column:
    """B6."""
    return (F.lower(first_set(outcome)) == "fail") & ~F.lower(first_set(status)).isin([s.lower() for s in words.skipped])


def reclassified(df: DataFrame, outcome: str, status: str, words: Vocabulary) -> DataFrame:
    """Failed rows whose status says otherwise become ``Pass``."""
    promote = F.lower(first_set(status)).isin([s.lower() for s in words.promoted]) & ~F.lower(first_set(outcome)).isin([s.lower() for s in words.kept_failed])
    return df.withColumn(outcome, F.when(promote, "Pass").otherwise(F.col(outcome)))


def cascade(rules: Sequence[tuple[Column, str | Column]], otherwise: str | Column) -> Column:
    """The outcome of the first rule that holds."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    found = as_col(otherwise)
    for condition, outcome in reversed(rules):
        found = F.when(F.coalesce(condition, F.lit(False)), as_col(outcome)).otherwise(found)
    return found


def classified(df: DataFrame, words: Vocabulary, has_point: Column, default_status: str = "Available") -> DataFrame:
    """The scheduler's cascade over ``Type``, ``Number``, ``Street``, ``Suburb``, ``Status``: ``Final Status``, and ``Status`` set where it passes."""
    status = F.lower(first_set("Status"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in words.labels.items() for x in (kv[0].lower(), kv[1])]), status) if words.labels else F.lit(None).cast("string")
    outcome = cascade(
        [
            (F.lower(F.coalesce("Type", F.lit(""))).contains("other"), "Pass"),
            (blank("Number") | blank("Street"), "Fail"),
            (blank("Suburb") & (F.instr(F.trim("Street"), " ") == 0), "Fail"),
            (~has_point & ~F.lower(F.coalesce("Type", F.lit(""))).contains("business"), "Fail"),
            (label.isNotNull(), label),
        ],
        "Pass",
    )
    passed = F.col("Final Status") == "Pass"
    return df.withColumn("Final Status", outcome).withColumn("Status", F.when(passed & (status == ""), default_status).otherwise(F.col("Status")))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())


def address_reasons(number: str, street: str, suburb: str, old_unit: str, old_number: str, old_street: str, is_new: Column) -> Column:
    """Why a cleaned address fails: parts missing, or other than the old ones where those are set."""
    old = merge_unit(old_unit, old_number)
    return reasons(
        [
            (blank(number) & ~is_new, "missing number"),
            (blank(street), "missing street"),
            (~blank(old_street) & (canon_text(F.concat_ws(" ", street, suburb)) != canon_text(old_street)), "street changed"),
            (~blank(old_number) & (loose_number(old) != loose_number(number)), "number changed"),
        ]
    )


def says_new_street(notes: Column | str) -> Column:
    """B10."""
    return F.coalesce(_col(notes), F.lit("")).rlike(r"(?i)\bnew\s*streets?\b")


def new_street_override(df: DataFrame, message: str, status: str = "Custom3", notes: str = "Notes") -> DataFrame:
    """Rows that tell of a new street lose their number and get the status and the message."""
    new = says_new_street(notes)
    return df.withColumns({"Number": F.when(new, "").otherwise(F.col("Number")), "Status": F.when(new, status).otherwise(F.col("Status")), notes: F.when(new, append_note(F.col(notes), F.lit(message))).otherwise(F.col(notes))})


def renamed_status(df: DataFrame, renames: Mapping[str, str], status: str = "Status") -> DataFrame:
    """Statuses by another name, compared without case; others stay."""
    low = F.lower(F.trim(F.col(status)))
    return df.withColumn(status, cascade([(low == k.lower(), v) for k, v in renames.items()], F.col(status)))


def restored(df: DataFrame, column: str, original: str) -> DataFrame:
    """A column back to what it was on input, where that wasn't blank."""
    return df.withColumn(column, first_set(original, column))


def overridden(df: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns patched by key from a small table (B13); null leaves a value alone. Several rows of a key: the least values."""
    values = [c for c in overrides.columns if c not in keys]
    table = overrides.groupBy(*keys).agg(*[F.min(c).alias(f"_o_{c}") for c in values])
    return df.join(table, list(keys), "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in values}).select(*df.columns)


def protected(value: Column | str, original: Column | str, names: Sequence[str]) -> Column:
    """The original where it is protected and was changed."""
    return F.when(F.lower(F.trim(_col(original))).isin([n.lower() for n in names]), _col(original)).otherwise(_col(value))


def public_columns(df: DataFrame, audit: Sequence[str] = ()) -> DataFrame:
    """Without technical (``_…``) and audit columns."""
    low = {a.lower() for a in audit}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_") and c.lower() not in low])


def mirrored(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both of two names for one column, side by side, blanks filled from the other."""
    both = {c: F.col(c) if c in df.columns else F.lit("") for c in (a, b)}
    value = first_set(both[a], both[b])
    out = df.withColumns({a: value, b: value})
    rest = [c for c in out.columns if c not in (a, b)]
    at = min(df.columns.index(c) if c in df.columns else len(rest) for c in (a, b))
    return out.select(*rest[:at], a, b, *rest[at:])


def allowed(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose value is on a list, without case."""
    return df.where(F.lower(F.trim(F.col(column))).isin([n.lower() for n in names]))


def blank_audit(df: DataFrame, keys: Sequence[str], placeholder: str = "") -> DataFrame:
    """Rows whose key columns are blank (or the placeholder), with the names of all empty fields and a snapshot."""
    empty = F.lit(True)
    for k in keys:
        empty &= blank(k) | (F.lower(F.trim(k)) == placeholder.lower())
    fields = [c for c in df.columns if not c.startswith("_")]
    names = F.filter(F.array(*[F.when(blank(c), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    snapshot = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))
    return df.where(empty).withColumns({"empty_fields": names, "snapshot": snapshot})


def defaulted(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Blanks replaced (B21); columns that aren't there are added."""
    return df.withColumns({c: F.when(blank(c), v).otherwise(F.col(c)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def submission_check(types: Sequence[str]) -> Column:
    """``ok``, ``message`` and ``destination`` of a submitted record (B22): number and street, a known type, and a map reference
    if the note says that something is to be changed."""
    change = F.coalesce("Notes", F.lit("")).rlike(r"(?i)\b(wrong|updated?)\b")
    message = cascade(
        [
            (blank("Number") | blank("Street"), "Number and Street are required"),
            (~F.coalesce("Type", F.lit("")).isin(list(types)), "Type is not known"),
            (change & blank("Map"), "Map is required for a change"),
        ],
        "",
    )
    return F.struct((message == "").alias("ok"), message.alias("message"), F.when(change, "updates").otherwise("new").alias("destination"))


def status_summary(df: DataFrame, status: str, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Rows by outcome (blank: Fail) with the total, in display order, then by name."""
    shown = F.when(F.trim(F.coalesce(status, F.lit(""))) == "", "Fail").otherwise(F.trim(status))
    counts = df.select(shown.alias("status")).rollup("status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("_total"))
    named = counts.withColumn("status", F.when(F.col("_total") == 1, "Total").otherwise(F.col("status")))
    order = cascade([(F.col("status") == s, F.lit(i)) for i, s in enumerate(words.display_order)], F.lit(len(words.display_order)))
    return named.withColumn("position", F.when(F.col("_total") == 1, len(words.display_order) + 1).otherwise(order)).drop("_total")
