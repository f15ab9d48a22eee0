"""House and unit numbers: splitting, flipping, normal forms and address keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import _col, canon_number, canon_text, squeeze

_UNIT_FIRST = r"(?i)^unit\s*([A-Za-z0-9]+)\s*/\s*(\d+[A-Za-z]?)$"
_HOUSE_FIRST = r"(?i)^(\d+[A-Za-z]?)\s*/\s*unit\s*([A-Za-z0-9]+)$"
_HOUSE_OR_RANGE = r"\d+[A-Za-z]?(?:\s*-\s*\d+[A-Za-z]?)?"
#: Month names as spreadsheets put them into numbers; signs that separate unit and house.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
SEPARATORS = "~_-,.\\:;!=+\"'()"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _text(c: Column | str) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit("")))


def split_unit(c: Column | str) -> Column:
    """``unit`` (as ``Unit…``) and ``house`` of ``UnitA/12`` or ``12/UnitA``; both blank for any other value."""

    def split(n: Column) -> Column:
        # The two sides of the stroke, whichever way round; a value of another form has neither.
        sides = F.when(n.rlike(_UNIT_FIRST), F.array(F.regexp_extract(n, _UNIT_FIRST, 1), F.regexp_extract(n, _UNIT_FIRST, 2)))
        sides = sides.when(n.rlike(_HOUSE_FIRST), F.array(F.regexp_extract(n, _HOUSE_FIRST, 2), F.regexp_extract(n, _HOUSE_FIRST, 1)))
        return _let(sides, lambda x: F.struct(F.coalesce(F.concat(F.lit("Unit"), F.get(x, F.lit(0))), F.lit("")).alias("unit"), F.coalesce(F.get(x, F.lit(1)), F.lit("")).alias("house")))

    return _let(_text(c), split)


def house_first(c: Column | str) -> Column:
    """``UnitX/12-14`` as ``12-14/UnitX``, the unit in capitals (I2); other values as they are."""
    n, p = _text(c), rf"(?i)^unit\s*([A-Za-z0-9]+)\s*/\s*({_HOUSE_OR_RANGE})$"
    flipped = F.concat(F.regexp_replace(F.regexp_extract(n, p, 2), r"\s*-\s*", "-"), F.lit("/Unit"), F.upper(F.regexp_extract(n, p, 1)))
    return F.when(n.rlike(p), flipped).otherwise(F.coalesce(_col(c), F.lit("")))


def unit_first(c: Column | str) -> Column:
    """``12/UnitX`` or ``12/FlatX`` as ``UnitX/12`` (I3); other values as they are."""
    n, p = _text(c), rf"(?i)^({_HOUSE_OR_RANGE})\s*/\s*(?:unit|flat)\s*([A-Za-z0-9]+)$"
    flipped = F.concat(F.lit("Unit"), F.upper(F.regexp_extract(n, p, 2)), F.lit("/"), F.regexp_replace(F.regexp_extract(n, p, 1), r"\s*-\s*", "-"))
    return F.when(n.rlike(p), flipped).otherwise(F.coalesce(_col(c), F.lit("")))


def toggle_unit(c: Column | str) -> Column:
    """Either order turned into the other (I4); twice gives the value back."""
    a, b, own = house_first(c), unit_first(c), F.coalesce(_col(c), F.lit(""))
    return F.when(a != own, a).otherwise(b)


def normal_number(c: Column | str) -> Column:
    """One spelling of unit and house number.

    A value is read as tokens: numbers, words and single signs, spaces left out. What it is shows in the sequence of their kinds: a
    month beside a number (a spreadsheet made it of ``n-m``) is that month's number, and the first two stand as unit and
    house; a number and one letter are house and unit. All else keeps its tokens, capital, with ``/`` for every
    separator; a value that has one then, or begins with it, begins with ``Unit``.
    """
    month = F.create_map(*[F.lit(str(x)) for kv in MONTHS.items() for x in kv])
    tokens = F.regexp_extract_all(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", ""), F.lit(r"(\d+|[A-Za-z]+|[^\dA-Za-z])"), F.lit(1))

    def kind(t: Column) -> Column:
        word = F.element_at(F.array(*map(F.lit, "awmw")), F.least(F.length(t), F.lit(4)))
        return F.when(t.rlike(r"^\d"), "n").when(t.rlike("^[A-Za-z]"), word).when(t.isin("-", "_", "/"), "-").otherwise("s")

    def spelt(tokens: Column) -> Column:
        parts = F.filter(tokens, lambda t: t.rlike(r"^[\dA-Za-z]"))
        dated = F.transform(parts, lambda t: F.when(t.rlike(r"^\d"), t).otherwise(F.coalesce(F.element_at(month, F.lower(t)), F.lit("1"))))
        joined = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(*SEPARATORS), "/").otherwise(t)), "")
        named = F.lower(F.substring(joined, 1, 4)) == "unit"
        rest = F.upper(F.when(named, F.substring(joined, F.lit(5), F.length(joined))).otherwise(joined))
        unit = lambda items: F.concat(F.lit("Unit"), F.array_join(items, "/"))
        kinds = F.array_join(F.transform(tokens, kind), "")
        return _let(kinds, lambda k: F.when(k.rlike("^n?-*m(-*n)?$"), unit(F.slice(dated, 1, 2))).when(k == "na", unit(F.reverse(F.transform(parts, F.upper)))).when(named | F.contains(joined, F.lit("/")), F.concat(F.lit("Unit"), rest)).otherwise(rest))

    return _let(tokens, spelt)


def loose_number(c: Column | str) -> Column:
    """The light normal form that comparisons use: no spaces, ``Unit`` and ``Flat`` in title case."""
    n = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(n, "UNIT|unit", "Unit"), "FLAT|flat", "Flat")


def is_number(c: Column | str) -> Column:
    """``Unit<token>/<n>[-<n>]`` or ``<n>[A][-<n>[A]]``."""
    return _text(c).rlike(r"^(?:Unit[A-Za-z0-9]+/\d+(?:-\d+)?|\d+[A-Za-z]?(?:-\d+[A-Za-z]?)?)$")


def merge_unit(unit: Column | str, house: Column | str) -> Column:
    """``Unit<u>/<n>``; if one is blank, the other."""
    u, h = _text(unit), _text(house)
    named = F.when(F.lower(u).rlike("^(unit|flat)"), u).otherwise(F.concat(F.lit("Unit"), u))
    return F.when((u != "") & (h != ""), F.concat(named, F.lit("/"), h)).when(h != "", h).otherwise(u)


def house_digits(c: Column | str) -> Column:
    """The first digits of the house part."""
    house = split_unit(c)["house"]
    return F.regexp_extract(F.when(house != "", house).otherwise(_text(c)), r"(\d+)", 1)


def without_leading_number(house: Column | str, street: Column | str) -> Column:
    """A street that doesn't begin with its own house number."""
    d, s = house_digits(house), squeeze(street)
    first = F.regexp_extract(s, r"^(\d+)[A-Za-z]?\s", 1)
    return F.when((d != "") & (first == d), F.regexp_replace(s, r"^\d+[A-Za-z]?\s+", "")).otherwise(s)


def has_unit(c: Column | str) -> Column:
    """I10."""
    return _text(c).rlike(r"(?i)(unit|flat)|/")


def without_unit(c: Column | str) -> Column:
    house = split_unit(c)["house"]
    return F.when(house != "", house).otherwise(_text(c))


def _bare_unit(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(?i)^(unit|flat)\s*", "")


def gate_key(unit: Column | str, house: Column | str, street: Column | str, legacy: bool = False) -> Column:
    """(unit, house, street) as the reference table compares them (C5); the unit may stand in the number, the suburb is left out."""

    def key(parts: Column) -> Column:
        own, inner = _bare_unit(_text(unit)), _bare_unit(parts["unit"])
        takes = (parts["house"] != "") & ((own == "") | (canon_text(own) == canon_text(inner)))
        return F.struct(
            canon_number(F.when((own == "") & (parts["house"] != ""), inner).otherwise(own), legacy).alias("unit"),
            canon_number(F.when(takes, parts["house"]).otherwise(_text(house)), legacy).alias("house"),
            canon_text(street).alias("street"),
        )

    return _let(split_unit(house), key)


def address_key(unit: Column | str, house: Column | str, street: Column | str, suburb: Column | str) -> Column:
    """The gate's key with the suburb, as one text (I8); blank if the street or the house is (T2: blanks are no duplicates)."""
    k = gate_key(unit, house, street)
    return F.when((k["house"] != "") & (k["street"] != ""), F.concat_ws("|", k["unit"], k["house"], k["street"], canon_text(suburb))).otherwise("")


def neighbours(n: Column | str, reach: int = 5) -> Column:
    """``n``, then n-1, n+1, n-2, … up to ``reach`` away, positive ones only."""
    c = _col(n).cast("int")
    steps = [0, *[s * d for d in range(1, reach + 1) for s in (-1, 1)]]
    return F.filter(F.array(*[c + F.lit(s) for s in steps]), lambda x: x > 0)
