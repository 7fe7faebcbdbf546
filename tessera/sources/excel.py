"""XLSX sheets as a Spark data source: ``spark.read.format("xlsx").option("sheet", ...)``.

A workbook is one zip of XML, so each file is one partition; many files are read
side by side. Register with ``spark.dataSource.register(XlsxSource)``.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        found = {s.get("name"): s.get(_REL) for s in book.iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in found:
            raise KeyError(f"no such sheet: {sheet}")
        wanted = found[sheet] if sheet is not None else next(iter(found.values()))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for row in ElementTree.fromstring(z.read("xl/" + links[wanted].lstrip("/").removeprefix("xl/"))).iter(f"{_MAIN}row"):
            out: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(out)
                out += [None] * (at - len(out) + 1)
                v = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None:
                    out[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield out


class _Reader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.options, self.width = options, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = rows_of(partition.value, self.options.get("sheet"))
        for _ in range(int(self.options.get("startRow", 0)) + (self.options.get("header", "true") == "true")):
            next(rows, None)
        first = int(self.options.get("startCol", 0))
        for r in rows:
            r = r[first:]
            yield tuple((r + [None] * self.width)[: self.width])


class XlsxSource(DataSource):
    """Options path, sheet, header, startRow, startCol. All columns are strings; cast as needed."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        rows = rows_of(self.options["path"].split(",")[0], self.options.get("sheet"))
        for _ in range(int(self.options.get("startRow", 0))):
            next(rows, None)
        first = next(rows, [])[int(self.options.get("startCol", 0)) :]
        head = self.options.get("header", "true") == "true"
        names = [(n if head and n else f"col_{i}") for i, n in enumerate(first)]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), len(schema.fields))


def write_xlsx(path: str, sheets: dict[str, DataFrame], most: int = 1_048_575) -> None:
    """A workbook of small tables; more rows than a sheet holds are an error."""
    kinds = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kinds}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError("too many rows for a sheet")
            lines = []
            for r in [df.columns, *rows]:
                cells = "".join("<c/>" if v is None else f'<c t="n"><v>{v}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in r)
                lines.append(f"<row>{cells}</row>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
