"""Workbooks as other formats, and typed workbooks from tables.

Rows of books are (book, ordinal, sheet, row, cells): the place and name of the sheet, the number of the row, its cells as
texts. One book is one file, so its rows fit in a task."""

from __future__ import annotations

import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textx import delimited_cell
from ..operators.ranking import first_free_names
from . import documents

#: Columns and rows of one sheet, at most, that a repeat count may unfold to.
MOST_REPEATS = 16_384
_ODS = {
    "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0",
    "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0",
    "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0",
}
_ODS_TYPE = "application/vnd.oasis.opendocument.spreadsheet"


def gathered(rows: DataFrame) -> DataFrame:
    """(book, sheets): the sheets of each book in their order, each with its rows in theirs."""
    part = rows.groupBy("book", "ordinal", "sheet").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    part = part.select("book", F.struct("ordinal", "sheet", F.transform("rows", lambda r: r.cells).alias("rows")).alias("s"))
    return part.groupBy("book").agg(F.sort_array(F.collect_list("s")).alias("sheets"))


def delimited_text(sheets: Column, delimiter: str = ",", line_end: str = "\n", escape_formulas: bool = True) -> Column:
    """One sheet as its lines; several each under a line with the sheet's name, with an empty line between."""
    line = lambda cells: F.array_join(F.transform(cells, lambda c: delimited_cell(c, delimiter, escape_formulas, False)), delimiter)
    lines = lambda s: F.array_join(F.transform(s.rows, line), line_end)
    headed = F.transform(sheets, lambda s: F.concat(F.lit("### Sheet: "), s.sheet, F.lit("\n"), lines(s)))
    return F.when(F.size(sheets) > 1, F.array_join(headed, line_end * 2)).otherwise(F.array_join(F.transform(sheets, lines), ""))


def records(rows: list[list[str]]) -> list[dict]:
    """Rows under the header that the first one is; short ones are filled with empty texts."""
    if not rows:
        return []
    width = max(map(len, rows))
    names = first_free_names([rows[0][i] if i < len(rows[0]) and rows[0][i] else f"Unnamed: {i}" for i in range(width)])
    return [dict(zip(names, r + [""] * (width - len(r)), strict=True)) for r in rows[1:]]


def json_text(sheets: list[dict]) -> str:
    """One sheet as a list of records, several as an object of such lists by name."""
    if len(sheets) <= 1:
        return documents.write_json(records(sheets[0]["rows"]) if sheets else [])
    return documents.write_json({s["sheet"]: records(s["rows"]) for s in sheets})


def xml_text(sheets: list[dict]) -> str:
    """workbook, worksheet, rows and row elements; a cell's element is named by its header."""
    book = ET.Element("workbook")
    for s in sheets:
        body = ET.SubElement(ET.SubElement(book, "worksheet", name=s["sheet"]), "rows")
        head = [re.sub(r"[^a-zA-Z0-9_]", "_", h) if h else f"column_{i}" for i, h in enumerate(s["rows"][0] if s["rows"] else [], 1)]
        head = [f"_{h}" if h[0].isdigit() else h for h in head]
        for n, cells in enumerate(s["rows"][1:], 1):
            row = ET.SubElement(body, "row", id=str(n))
            for i, c in enumerate(cells):
                ET.SubElement(row, head[i] if i < len(head) else f"col_{i + 1}").text = c
    return ET.tostring(book, encoding="unicode")


def html_text(sheets: list[dict]) -> str:
    """A page with a headed table for each sheet, the first row as its header."""
    out = []
    for s in sheets:
        lines = ["".join(f"<{t}>{html.escape(c)}</{t}>" for c in cells) for t, cells in zip(["th"] + ["td"] * len(s["rows"]), s["rows"], strict=False)]
        out.append(f"<h3>{html.escape(s['sheet'])}</h3><table>" + "".join(f"<tr>{x}</tr>" for x in lines) + "</table>")
    return '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>' + "".join(out) + "</body></html>"


_FORMS = {"json": json_text, "xml": xml_text, "html": html_text}


def convert(rows: DataFrame, form: str) -> DataFrame:
    """(book, text): each book as csv, tsv, json, xml or html."""
    books = gathered(rows)
    if form in ("csv", "tsv"):
        return books.select("book", delimited_text(F.col("sheets"), "," if form == "csv" else "\t").alias("text"))
    write = _FORMS[form]
    return books.select("book", documents.map_text(F.to_json("sheets"), lambda t: write(json.loads(t))).alias("text"))


def detect(text: str | None):
    """A cell of a text table with the kind that it spells out: numbers that a spreadsheet would write the same, truth
    values; all else, leading zeros and long digit runs included, stays text."""
    if text is None or text == "":
        return None
    if text in ("TRUE", "FALSE"):
        return text == "TRUE"
    if re.fullmatch(r"-?(0|[1-9]\d{0,14})", text):
        return int(text)
    return float(text) if len(text) <= 16 and re.fullmatch(r"-?(0|[1-9]\d*)\.\d+", text) else text


def ods_bytes(sheets: dict[str, list[list]]) -> bytes:
    """An OpenDocument spreadsheet of numbers, truth values and texts, in the kinds that they have."""

    def cell(v) -> str:
        if v is None:
            return "<table:table-cell/>"
        if isinstance(v, bool):
            return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"><text:p>{str(v).upper()}</text:p></table:table-cell>'
        if isinstance(v, (int, float)):
            return f'<table:table-cell office:value-type="float" office:value="{v}"><text:p>{v}</text:p></table:table-cell>'
        lines = "".join(f"<text:p>{html.escape(x)}</text:p>" for x in str(v).split("\n"))
        return f'<table:table-cell office:value-type="string">{lines}</table:table-cell>'

    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in _ODS.items())
    tables = "".join(
        f'<table:table table:name="{html.escape(n)}">' + "".join("<table:table-row>" + "".join(map(cell, r)) + "</table:table-row>" for r in rows) + "</table:table>"
        for n, rows in sheets.items()
    )
    manifest = "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), _ODS_TYPE)
        z.writestr("META-INF/manifest.xml", f'<m:manifest xmlns:m="{manifest}"><m:file-entry m:full-path="/" m:media-type="{_ODS_TYPE}"/><m:file-entry m:full-path="content.xml" m:media-type="text/xml"/></m:manifest>')
        z.writestr("content.xml", f"<office:document-content {spaces}><office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>")
    return buffer.getvalue()


def ods_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of an OpenDocument spreadsheet; repeated cells and rows unfold unless they are empty at the end."""
    q = lambda space, name: f"{{{_ODS[space]}}}{name}"
    out = []
    for sheet in ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml")).iter(q("table", "table")):
        at = 0
        for row in sheet.iter(q("table", "table-row")):
            cells: list[str] = []
            for c in row.findall(q("table", "table-cell")):
                kind = c.get(q("office", "value-type"))
                text = "\n".join("".join(p.itertext()) for p in c.findall(q("text", "p")))
                value = c.get(q("office", "value"), "") if kind == "float" else c.get(q("office", "boolean-value"), "").upper() if kind == "boolean" else text
                cells += [value] * min(MOST_REPEATS, int(c.get(q("table", "number-columns-repeated"), 1)))
            while cells and not cells[-1]:
                cells.pop()
            times = int(row.get(q("table", "number-rows-repeated"), 1))
            if cells:
                out += [(sheet.get(q("table", "name")), at + k + 1, cells) for k in range(min(MOST_REPEATS, times))]
            at += times
    return out
