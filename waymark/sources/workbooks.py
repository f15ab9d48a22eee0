"""Excel workbooks in and out (A11), without a spreadsheet package: a workbook is a ZIP of XML parts.

Workbooks are small: a sheet holds ``MOST_ROWS`` rows by the format's own limit, and more are refused. They are read by the
task that has the file, and written by the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's largest sheet, and its names.
MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(cell: str) -> int:
    n = 0
    for c in cell:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def workbook(sheets: Mapping[str, Sequence[Sequence[str]]]) -> bytes:
    """A workbook of text cells, a sheet for each name."""
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def part(name: str, body: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _XML + body, zipfile.ZIP_DEFLATED)

        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        part("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types">{defaults}<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>')
        part("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        part("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATED}"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="rId{i}" Type="{_RELATED}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        part("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{related}</Relationships>')
        for i, name in enumerate(names, 1):
            rows = []
            for r, row in enumerate(sheets[name], 1):
                cells = "".join(f'<c r="{_column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub(" ", value))}</t></is></c>' for c, value in enumerate(row, 1) if value)
                rows.append(f'<row r="{r}">{cells}</row>')
            part(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
    return out.getvalue()


def sheet_rows(content: bytes, sheet: str = "") -> Iterator[list[str]]:
    """The rows of a sheet as texts, the first sheet if there is none of that name; gaps are blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [(s.get("name"), targets[s.get(f"{{{_RELATED}}}id")]) for s in book.iter(f"{{{_MAIN}}}sheet")]
        target = next((t for n, t in found if n == sheet), found[0][1])
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{{{_MAIN}}}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        at = 0
        for row in ElementTree.fromstring(z.read(path)).iter(f"{{{_MAIN}}}row"):
            at += 1
            while at < int(row.get("r") or at):
                yield []
                at += 1
            out: list[str] = []
            for cell in row.iter(f"{{{_MAIN}}}c"):
                place = _number(cell.get("r") or "") or len(out) + 1
                out += [""] * (place - 1 - len(out))
                value = cell.find(f"{{{_MAIN}}}v")
                kind = cell.get("t")
                out.append(text(cell) if kind == "inlineStr" else "" if value is None else shared[int(value.text or 0)] if kind == "s" else value.text or "")
            yield out


def read_workbooks(files: DataFrame, columns: Sequence[str], sheet: str = "") -> DataFrame:
    """Rows of the workbooks in ``files`` (``path``, ``content``, as ``binaryFile`` gives them) under a fixed header, with ``path``. The
    first row of a sheet names its columns, without case; what it lacks is blank."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(bytes(content), sheet)
                at = {h.strip().lower(): i for i, h in reversed(list(enumerate(next(rows, []))))}
                places = [at.get(c.lower(), -1) for c in columns]
                yield pd.DataFrame([[path, *(r[p] if 0 <= p < len(r) else "" for p in places)] for r in rows], columns=["path", *columns])

    return files.select("path", "content").mapInPandas(work, ", ".join(["path string", *(f"`{c}` string" for c in columns)]))


def write_workbook(spark: SparkSession, sheets: Mapping[str, DataFrame], target: str) -> None:
    """A workbook with a sheet for each table, in any store that Spark writes to. Tables beyond a sheet's rows are refused."""
    filled = {}
    for name, df in sheets.items():
        texts = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
        rows = [list(r) for r in texts.limit(MOST_ROWS).collect()]
        if len(rows) == MOST_ROWS:
            raise ValueError(f"sheet {name}: more rows than a sheet holds")
        filled[name] = [df.columns, *rows]
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(workbook(filled))
    finally:
        stream.close()
