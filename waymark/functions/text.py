"""Text expressions: folding, canonical keys, street and suburb names, notes.

All take and return Columns and treat null as blank. ``\\d``, ``\\w`` and ``\\b`` are Unicode-aware only under ``(?U)``,
which patterns here carry where it matters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that end street names, by abbreviation. Callers may pass their own.
SUFFIXES = {
    "ave": "Avenue", "blvd": "Boulevard", "cl": "Close", "cres": "Crescent", "ct": "Court", "dr": "Drive", "gr": "Grove", "hts": "Heights",
    "hwy": "Highway", "ln": "Lane", "pde": "Parade", "pkwy": "Parkway", "pl": "Place", "pt": "Point", "qy": "Quay", "rd": "Road", "sq": "Square",
    "st": "Street", "tce": "Terrace", "ter": "Terrace", "trl": "Trail", "wk": "Walk",
}
#: Misspellings of them.
SUFFIX_TYPOS = {"cresent": "Crescent", "hght": "Heights", "hghts": "Heights"}


def text(c: Column | str) -> Column:
    """Null as blank; the trailing ``.0`` of a number that went through a float is dropped (B1)."""
    return F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"^(-?\d+)\.0$", "$1")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Whether a value is missing, blank, a zero or one of its spellings (B2)."""
    t = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    return t.isin("", "0", "O", "None") | F.coalesce(t.try_cast("double") == 0, F.lit(False))


def number(c: Column | str) -> Column:
    """A double, or null where the text isn't a finite plain number (B3); ``nan``, ``inf`` and underscores aren't."""
    t = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Letters up to U+024F and of U+1E00-U+1EFF whose canonical decomposition is a letter and marks."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letters = unicodedata.normalize("NFD", chr(code))
        plain = "".join(x for x in letters if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


def fold(c: Column | str) -> Column:
    """Letters without their marks (H2); a letter that has no decomposition stays."""
    a, b = _fold_table()
    return F.translate(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\p{Mn}+", ""), a, b)


def canon_text(c: Column | str) -> Column:
    """The key of a text (H1): trimmed, lower case, a last word of four digits dropped, folded, letters and digits only."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), r"(?U)\b\d{4}\s*$", "")
    return F.regexp_replace(fold(t), "[^a-z0-9]+", "")


def canon_number(c: Column | str, legacy: bool = False) -> Column:
    """The key of a house number; ``legacy`` drops four digits at the end as :func:`canon_text` does."""
    return canon_text(c) if legacy else F.regexp_replace(fold(F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))), "[^a-z0-9]+", "")


def title(c: Column | str) -> Column:
    """A capital after any sign that is no letter, the rest lower (H3)."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))


def _lookup(c: Column, table: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None).cast("string")


def _last_word(c: Column) -> Column:
    return F.regexp_extract(c, r"([^ ]+)$", 1)


def expand_suffix(street: Column | str, table: Mapping[str, str] = SUFFIXES, typos: Mapping[str, str] = SUFFIX_TYPOS) -> Column:
    """A last word that abbreviates or misspells a suffix, written out, once (H4)."""
    s = squeeze(street)
    last = F.regexp_replace(F.lower(_last_word(s)), r"\.$", "")
    whole = _lookup(last, {**table, **typos})
    return F.when((F.instr(s, " ") > 0) & whole.isNotNull(), F.concat(F.regexp_replace(s, r"[^ ]+$", ""), whole)).otherwise(s)


def split_suffix(street: Column | str, table: Mapping[str, str] = SUFFIXES) -> Column:
    """``base`` and ``suffix`` of a street name (H5); no suffix is blank, and a lone suffix word is a base."""
    s = title(squeeze(street))
    known = sorted(set(table.values()))
    has = (F.instr(s, " ") > 0) & _last_word(s).isin(known)
    return F.struct(F.when(has, F.trim(F.regexp_replace(s, r"[^ ]+$", ""))).otherwise(s).alias("base"), F.when(has, _last_word(s)).otherwise("").alias("suffix"))


def _alternatives(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def strip_suburb_tail(street: Column | str, suburbs: Sequence[str], table: Mapping[str, str] = SUFFIXES) -> Column:
    """A known suburb after the last suffix word, with commas or dashes before it, dropped (H6)."""
    if not suburbs:
        return squeeze(street)
    suffix = _alternatives(sorted(set(table.values())))
    return F.regexp_replace(squeeze(street), rf"(?i)^(.*\b(?:{suffix}))[\s,\-–]+(?:{_alternatives(suburbs)})$", "$1")


def lift_suburb(street: Column | str, suburb: Column | str, suburbs: Sequence[str]) -> Column:
    """``street`` and ``suburb`` with a known suburb moved out of the street's end (H7); a suburb that is set stays.

    Suburbs are compared folded and without case; the longest that fits wins, and is returned as the caller spells it.
    """
    s, own = squeeze(street), squeeze(suburb)
    none = F.struct(s.alias("street"), own.alias("suburb"))
    if not suburbs:
        return none
    folded = {"".join(x for x in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(x) != "Mn"): w for w in suburbs}
    tail = F.regexp_extract(fold(F.lower(s)), rf"[\s,\-–]+({_alternatives(list(folded))})$", 1)
    rest = F.regexp_replace(F.substring(s, F.lit(1), F.length(s) - F.length(tail)), r"[\s,\-–]+$", "")
    return F.when((tail != "") & (rest != ""), F.struct(rest.alias("street"), F.when(own == "", _lookup(tail, folded)).otherwise(own).alias("suburb"))).otherwise(none)


def canon_suburb(c: Column | str, aliases: Mapping[str, str], noise: Sequence[str] = ()) -> Column:
    """Title case, words of ``noise`` and four-digit codes dropped, then the alias (H8). Keys of ``aliases`` are folded lower case."""
    t = squeeze(c)
    if noise:
        t = F.regexp_replace(t, rf"(?i)\b(?:{_alternatives(noise)})\b", " ")
    t = title(F.regexp_replace(squeeze(F.regexp_replace(t, r"\b\d{4}\b", " ")), r"^[\s,]+|[\s,]+$", ""))
    return F.coalesce(_lookup(fold(F.lower(t)), aliases), t)


def is_delivery_code(c: Column | str) -> Column:
    """Whether a value is a rural delivery code alone (H9)."""
    return squeeze(c).rlike(r"(?i)^R\.?\s?D\.?\s*\d*$")


def strip_delivery_code(c: Column | str) -> Column:
    return F.regexp_replace(squeeze(c), r"(?i)^R\.?\s?D\.?\s*\d+[\s,]+", "")


def address_parts(c: Column | str) -> Column:
    """``number``, ``street`` and ``suburb`` of ``number street, suburb[, city]``."""
    s = squeeze(c)
    first, rest = F.trim(F.split_part(s, F.lit(","), F.lit(1))), F.trim(F.split_part(s, F.lit(","), F.lit(2)))
    n = F.regexp_extract(first, r"^((?:[Uu]nit\s?\w+/)?\d+[A-Za-z]?(?:\s?[-/]\s?\w+)?)\s", 1)
    return F.struct(n.alias("number"), F.trim(F.substring(first, F.length(n) + 1, F.length(first))).alias("street"), rest.alias("suburb"))


def address_line(number: Column, street: Column, suburb: Column, city: str = "") -> Column:
    """The inverse of :func:`address_parts`."""
    head = F.concat_ws(" ", *[F.nullif(squeeze(x), F.lit("")) for x in (number, street)])
    return F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in (head, squeeze(suburb), F.lit(city))])


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def note_segments(c: Column | str, drop: Sequence[str] = (), drop_segments: Sequence[str] = ()) -> Column:
    """The parts of a note (H11, M1): dates, brackets and phrases of ``drop`` out, split at ``/`` and ``|``, parts with a word of
    ``drop_segments`` out, repeats (without case) out, first letters capital."""
    t = F.coalesce(_col(c), F.lit(""))
    for pattern in (r"\([^)]*\)", r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", *(rf"(?i){re.escape(p)}" for p in drop)):
        t = F.regexp_replace(t, pattern, " ")
    parts = F.transform(F.split(t, r"[/|]"), lambda p: F.regexp_replace(squeeze(p), r"^[\s,;:.\-]+|[\s,;:\-]+$", ""))
    parts = F.filter(parts, lambda p: p != "")
    if drop_segments:
        parts = F.filter(parts, lambda p: ~p.rlike(rf"(?i)\b(?:{_alternatives(drop_segments)})\b"))
    return F.transform(distinct_by_case(parts), sentence_case)


def clean_note(c: Column | str, drop: Sequence[str] = (), drop_segments: Sequence[str] = ()) -> Column:
    return F.array_join(note_segments(c, drop, drop_segments), " / ")


def distinct_by_case(parts: Column) -> Column:
    """An array without later items that equal an earlier one but for case."""
    low = F.transform(parts, F.lower)
    return F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)


def merge_notes(*parts: Column, between: str = " | ") -> Column:
    """Notes one after another, blanks and repeats out."""
    kept = F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != "")
    return F.array_join(distinct_by_case(kept), between)


def append_note(note: Column, more: Column, between: str = " / ") -> Column:
    """``more`` after ``note`` unless it is in it already."""
    a, b = F.trim(F.coalesce(note, F.lit(""))), F.trim(F.coalesce(more, F.lit("")))
    return F.when(b == "", a).when(a == "", b).when(F.contains(F.lower(a), F.lower(b)), a).otherwise(F.concat(a, F.lit(between), b))


def clean_label(c: Column, blanked: Sequence[str]) -> Column:
    """A label, blank if it is one of ``blanked``."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin([b.lower() for b in blanked]), "").otherwise(t) if blanked else t


def file_stem(c: Column | str) -> Column:
    """A name that any file system takes."""
    t = F.regexp_replace(squeeze(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    t = F.regexp_replace(t, r"^[. ]+|[. ]+$", "")
    return F.when(t == "", "Unassigned").otherwise(t)


def file_stem_of(names: Column) -> Column:
    return file_stem(F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: F.trim(n) != ""))), "_"))


def tokens(c: Column | str) -> Column:
    """Words of ASCII letters, digits and apostrophes, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("([A-Za-z0-9']+)"), F.lit(1))


def n_tokens(c: Column | str) -> Column:
    """How many there are, without making them."""
    return F.regexp_count(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[A-Za-z0-9']+"))


def has_digit(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(r"(?U)\d")


def letters_only(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z]+", "")


def strip_leading_number(c: Column | str) -> Column:
    """A text without its first words that hold a digit."""
    return F.regexp_replace(squeeze(c), r"^(?:\S*\d\S*\s+)+", "")


def issues(c: Column | str) -> Column:
    """Sorted labels of what doesn't belong into a name: ``digit``, ``symbol:x``."""
    t = F.coalesce(_col(c), F.lit(""))
    signs = F.regexp_extract_all(t, F.lit(r"(?U)([^\w\s'\-])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(F.when(t.rlike(r"\d"), F.array(F.lit("digit"))).otherwise(F.array().cast("array<string>")), F.transform(signs, lambda s: F.concat(F.lit("symbol:"), s)))))


def repair(c: Column | str, glitches: Mapping[str, str]) -> Column:
    """Known corruptions put right (H19), in the order given."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), glitches.items(), F.coalesce(_col(c), F.lit("")))


def strip_punctuation(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)[^\w\s]", " "))


def has_invalid_chars(c: Column | str) -> Column:
    """Any sign but ASCII letters, digits, white space, ``,'-/`` and the macron vowels."""
    return F.coalesce(_col(c), F.lit("")).rlike(r"[^A-Za-z0-9\s,'\-/āĀēĒīĪōŌūŪ]")
