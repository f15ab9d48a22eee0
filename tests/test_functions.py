"""The grammar of texts and numbers, a case to a row."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, numbers, text


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("1-Nov", "Unit1/11"), ("Nov-41", "Unit11/41"), ("Nov", "Unit11"), ("37b", "UnitB/37"), ("12-14", "Unit12/14"), ("unit a/12", "UnitA/12"), ("26/3", "Unit26/3"),
        ("5/1234", "Unit5/1234"), ("1234", "1234"), ("", ""), (None, ""), ("12 / unit b", "Unit12/UNITB"), (". Unit15/3", "Unit/UNIT15/3"),
    ],
)
def test_normal_number(spark, given, want):
    assert one(spark, numbers.normal_number(lit(given))) == want


@pytest.mark.parametrize(("given", "unit", "house"), [("UnitA/12", "UnitA", "12"), ("12/UnitA", "UnitA", "12"), ("Unit 3 / 219", "Unit3", "219"), ("12", "", ""), ("12-14", "", ""), (None, "", ""), ("Unit5A/12B", "Unit5A", "12B")])
def test_split_unit(spark, given, unit, house):
    assert tuple(one(spark, numbers.split_unit(lit(given)))) == (unit, house)


def test_flips(spark):
    assert one(spark, numbers.house_first(lit("Unita/12 - 14"))) == "12-14/UnitA"
    assert one(spark, numbers.unit_first(lit("12/flat3"))) == "Unit3/12"
    assert one(spark, numbers.unit_first(lit("UnitA/3"))) == "UnitA/3"
    for value in ("UnitA/12", "12/UnitA", "12", "", "7-9/Unit2"):
        assert one(spark, numbers.toggle_unit(numbers.toggle_unit(lit(value)))) == value


def test_keys(spark):
    key = lambda *a: one(spark, numbers.address_key(*map(lit, a)))
    assert key("", "UnitA/12", "Kauri Road", "x") == key("A", "12", " kauri  ROAD", "X") == key("", "12/UnitA", "Kāuri Road", "x")
    assert key("", "", "Kauri Road", "x") == "" == key("", "12", "", "x")
    gate = lambda legacy: [one(spark, numbers.gate_key(lit(""), lit(n), lit("K"), legacy)["house"]) for n in ("1234", "5678")]
    assert gate(True) == ["", ""]
    assert gate(False) == ["1234", "5678"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("  Tāmaki Drive 1071 ", "tamakidrive"), ("O'Neil-St.", "oneilst"), ("1234", ""), ("a1234", "a1234"), ("ß é", "e"), (None, ""), ("", "")],
)
def test_canon_text(spark, given, want):
    got = one(spark, text.canon_text(lit(given)))
    assert got == want
    assert one(spark, text.canon_text(lit(got))) == ("" if got.isdigit() and len(got) == 4 else got)


@pytest.mark.parametrize("given", ["3rd o'neil STREET", "āwhina-road", "", "x1y2", "ÉCOLE d'été"])
def test_title(spark, given):
    assert one(spark, text.title(lit(given))) == given.title()


def test_streets(spark):
    assert one(spark, text.expand_suffix(lit("Kauri  rd."))) == "Kauri Road"
    assert one(spark, text.expand_suffix(lit("Rd"))) == "Rd"
    assert tuple(one(spark, text.split_suffix(lit("kauri road")))) == ("Kauri", "Road")
    assert tuple(one(spark, text.split_suffix(lit("Road")))) == ("Road", "")
    assert one(spark, text.strip_suburb_tail(lit("Kauri Road - West Bay"), ["West Bay"])) == "Kauri Road"
    assert tuple(one(spark, text.lift_suburb(lit("Kauri Road, orere"), lit(""), ["Ōrere", "West Bay"]))) == ("Kauri Road", "Ōrere")
    assert tuple(one(spark, text.lift_suburb(lit("West Bay"), lit("x"), ["West Bay"]))) == ("West Bay", "x")
    assert one(spark, text.canon_suburb(lit("mt eden, Auckland 1024"), {"mt eden": "Mount Eden"}, ["auckland"])) == "Mount Eden"
    assert one(spark, numbers.without_leading_number(lit("UnitA/12"), lit("12 Kauri Road"))) == "Kauri Road"
    assert one(spark, numbers.without_leading_number(lit("1"), lit("12 Kauri Road"))) == "12 Kauri Road"


def test_notes(spark):
    assert one(spark, text.clean_note(lit("gate locked (old) / Gate Locked | seen 3/4/2024; dog"))) == "Gate locked / Seen ; dog"
    assert one(spark, text.clean_note(lit("call first / secret thing"), drop_segments=["secret"])) == "Call first"
    assert one(spark, text.merge_notes(lit("a"), lit(" A "), lit(None), lit("b"))) == "a | b"
    assert one(spark, text.append_note(lit("x / y"), lit("Y"))) == "x / y"


def test_values(spark):
    assert [one(spark, text.blank(lit(x))) for x in ("", " ", "0", "0.0", "O", None, "x", "00")] == [True, True, True, True, True, True, False, True]
    assert [one(spark, text.number(lit(x))) for x in ("1", " 2.5 ", "nan", "inf", "1_0", "", None, "1e2", "0x1")] == [1, 2.5, None, None, None, None, None, 100, None]
    assert one(spark, text.file_stem(lit(' a/b:"c" . '))) == "a_b__c_"
    assert one(spark, text.issues(lit("a1 (b) 2!"))) == ["digit", "symbol:!", "symbol:(", "symbol:)"]


def square():
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])


@pytest.mark.parametrize(("x", "y", "want"), [(1, 1, True), (0, 1, True), (2, 2, True), (3, 1, False), (1, -0.1, False), (0, 0, True)])
def test_in_ring(spark, x, y, want):
    assert one(spark, geo.in_ring(F.lit(float(x)), F.lit(float(y)), square())) is want
    assert one(spark, geo.in_ring(F.lit(float(x)), F.lit(float(y)), geo.closed(square()))) is want


def test_rings(spark):
    assert one(spark, geo.in_ring(F.lit(0.0), F.lit(0.0), F.slice(square(), 1, 2))) is False
    assert one(spark, geo.edge_distance(F.lit(1.0), F.lit(1.5), square())) == 0.5
    assert one(spark, geo.signed_area(square())) == 4
    assert tuple(one(spark, geo.centroid(F.array(square())))) == (1, 1)
    assert len(one(spark, geo.without_collinear(F.concat(square(), F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))))))) == 4
    box = geo.Box(-37.3, -36.6, 174.4, 175.5)
    assert tuple(one(spark, geo.unswapped(F.lit(174.8), F.lit(-36.9), box))) == (-36.9, 174.8)
    assert one(spark, box.holds(F.lit(None).cast("double"), F.lit(174.8))) is False
    assert abs(one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111194.93) < 0.01
    assert one(spark, F.size(geo.ring_of(F.lit("1,2,0 3,4\n x,y 5,6")))) == 3
