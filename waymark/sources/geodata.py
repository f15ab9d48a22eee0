"""Areas and lines in files: KML and KMZ, GeoPackage, GeoJSON and plain coordinates."""

from __future__ import annotations

import io
import os
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.functions.geo import closed, ring_of

_PLACEMARK = re.compile(r"<Placemark\b.*?</Placemark>", re.S)
_NAME = re.compile(r"<name>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</name>", re.S)
_OUTER = re.compile(r"<outerBoundaryIs>.*?<coordinates>(.*?)</coordinates>.*?</outerBoundaryIs>", re.S)
_ANY = re.compile(r"<coordinates>(.*?)</coordinates>", re.S)


def read_kml(spark: SparkSession, folder: str, by: str = "file", outer_only: bool = True) -> DataFrame:
    """``name``, ``ring`` and ``file`` of the areas in a folder's KML and KMZ files.

    ``by`` names areas after the file's stem (``file``) or the placemark (``placemark``; blank: the stem). ``outer_only`` takes the
    outer rings, or all coordinates of a placemark that has none; else all coordinates are rings, holes and lines included.
    A KMZ is its first KML. Files are read one to a row, so a folder may hold any number.
    """
    return kml_areas(spark.read.format("binaryFile").options(pathGlobFilter="*.km[lz]", recursiveFileLookup=True).load(folder), by, outer_only)


def kml_areas(files: DataFrame, by: str = "file", outer_only: bool = True) -> DataFrame:
    """As :func:`read_kml`, of files that are there already (``path``, ``content``)."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                stem = os.path.splitext(os.path.basename(path))[0].replace("%20", " ")
                for name, coordinates in placemarks(kml_text(path, bytes(content)), outer_only):
                    rows.append((stem if by == "file" or not name else name, coordinates, path))
            yield pd.DataFrame(rows, columns=["name", "coordinates", "file"])

    found = files.select("path", "content").mapInPandas(parsed, "name string, coordinates string, file string")
    return found.select("name", ring_of(F.col("coordinates")).alias("ring"), "file").where("size(ring) >= 3")


def kml_text(path: str, content: bytes) -> str:
    if path.lower().endswith(".kmz"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            inner = next((n for n in sorted(z.namelist()) if n.lower().endswith(".kml")), None)
            content = z.read(inner) if inner else b""
    return content.decode("utf-8-sig", "replace")


def placemarks(document: str, outer_only: bool) -> list[tuple[str, str]]:
    """Name and coordinates of each ring; namespaces' prefixes don't matter."""
    plain = re.sub(r"<(/?)\w+:", r"<\1", document)
    out = []
    for mark in _PLACEMARK.findall(plain) or [plain]:
        name = m[1].strip() if (m := _NAME.search(mark)) else ""
        rings = (_OUTER.findall(mark) or _ANY.findall(mark)) if outer_only else _ANY.findall(mark)
        out += [(name, r) for r in rings]
    return out


def kml_placemark(name: Column, ring: Column) -> Column:
    """A placemark of one area (A17); names are escaped."""
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<Placemark><name>"), safe, F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), coordinates_text(ring), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def coordinates_text(ring: Column, digits: int = 8) -> Column:
    """``lon,lat lon,lat …`` of the closed ring."""
    return F.array_join(F.transform(closed(ring), lambda p: F.format_string(f"%.{digits}f,%.{digits}f", p["x"], p["y"])), " ")


def kml_documents(areas: DataFrame) -> DataFrame:
    """``name`` and its KML document (``value``) for each name of ``areas`` (``name``, ``ring``)."""
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"
    marks = areas.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list(kml_placemark(F.col("name"), F.col("ring")))), "").alias("marks"))
    return marks.select("name", F.concat(F.lit(head), "marks", F.lit(tail)).alias("value"))


def kml_size(ring: Sequence[tuple[float, float]]) -> int:
    """Bytes of the document of one area of a short name, as :func:`kml_documents` writes it."""
    points = [*ring, ring[0]] if len(ring) else []
    return 330 + sum(len(f"{x:.8f},{y:.8f} ") for x, y in points)


def write_kml(areas: DataFrame, target: str) -> None:
    """A KML document for each area of ``name`` and ``ring``."""
    kml_documents(areas).select("value", "name").write.mode("overwrite").partitionBy("name").text(target)


def geojson(name: Column, ring: Column) -> Column:
    """An area as a GeoJSON feature (L3)."""
    points = F.transform(closed(ring), lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(name.alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")).alias("geometry")))


def from_geojson(c: Column) -> Column:
    """``name`` and ``ring`` (the outer one) of a polygon feature (L3)."""
    f = F.from_json(c, "struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>")
    ring = F.transform(F.get(f["geometry"]["coordinates"], F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return F.struct(f["properties"]["name"].alias("name"), ring.alias("ring"))


class GeoPackage(DataSource):
    """Features of GeoPackage files (A12): ``spark.read.format("geopackage").option("layer", …).load(path)``.

    Rows are ``fid``, ``wkb`` (binary) and ``attributes`` (a map of strings). Options: ``layer`` (else the first one), ``rows`` per
    task (10,000). Each task reads a stretch of feature ids; files must be where executors can open them.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return "fid long, wkb binary, attributes map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return GeoPackageReader(self.options)


class _Stretch(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class GeoPackageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.layer, self.step = options["path"], options.get("layer"), int(options.get("rows", "10000"))

    def _open(self) -> tuple[sqlite3.Connection, str, str, str]:
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        layers = db.execute("select table_name, column_name from gpkg_geometry_columns order by table_name").fetchall()
        table, geometry = next((x for x in layers if x[0] == self.layer), None) if self.layer else layers[0]
        key = next((r[1] for r in db.execute(f'pragma table_info("{table}")') if r[5]), "rowid")
        return db, table, geometry, key

    def partitions(self) -> list[InputPartition]:
        db, table, _, key = self._open()
        low, high = db.execute(f'select min("{key}"), max("{key}") from "{table}"').fetchone()
        return [_Stretch(a, a + self.step) for a in range(low, high + 1, self.step)] if low is not None else [_Stretch(0, 0)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        db, table, geometry, key = self._open()
        cursor = db.execute(f'select * from "{table}" where "{key}" >= ? and "{key}" < ?', (partition.low, partition.high))
        names = [d[0] for d in cursor.description]
        for row in cursor:
            values = dict(zip(names, row, strict=True))
            blob = values.pop(geometry)
            yield values.pop(key), wkb_of(blob), {k: str(v) for k, v in values.items() if v is not None}


def wkb_of(blob: bytes | None) -> bytes | None:
    """The geometry of a GeoPackage value, without its header."""
    if not blob or blob[:2] != b"GP":
        return blob
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def wkb_rings(wkb: bytes) -> list[list[tuple[float, float]]]:
    """The outer rings of a polygon or multipolygon in two dimensions; other kinds have none."""
    def geometry(at: int) -> tuple[list, int]:
        order = "<" if wkb[at] else ">"
        kind, n = struct.unpack_from(f"{order}II", wkb, at + 1)
        at += 9
        rings = []
        if kind == 3:
            for i in range(n):
                (count,) = struct.unpack_from(f"{order}I", wkb, at)
                flat = struct.unpack_from(f"{order}{2 * count}d", wkb, at + 4)
                at += 4 + 16 * count
                if not i:
                    rings.append(list(zip(flat[::2], flat[1::2], strict=True)))
        elif kind == 6:
            for _ in range(n):
                inner, at = geometry(at)
                rings += inner
        return rings, at

    return geometry(0)[0] if wkb else []
