"""Text formats without a Spark source: encodings, TOML, JSON with exact numbers, XML trees, workbooks, subtitles, globs."""

from __future__ import annotations

import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_encoding(data: bytes) -> str:
    """A byte-order mark, NUL lanes of UTF-16, strict UTF-8, the best-scored East Asian encoding, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    sample = data[:4096]
    if sample.count(0) > len(sample) // 4:
        return "utf-16-le" if sample[1::2].count(0) >= sample[::2].count(0) else "utf-16-be"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best, score = "cp1252", 0.0
    for name in ("euc_kr", "shift_jis", "gbk", "big5"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if ord(c) > 127]
        common = sum("가" <= c <= "힣" or "぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in wide)
        rated = common / len(wide) if wide else 0.0
        if rated > score and rated > 0.6:
            best, score = name, rated
    return best


def decode(data: bytes) -> str:
    return data.decode(detect_encoding(data), errors="replace")


class LosslessError(ValueError):
    """Text that is not JSON, with its line and column."""


def parse_json(text: str):
    """JSON with exact whole numbers, the last of duplicate keys, no NaN or infinity."""

    def refuse(name: str):
        raise ValueError(f"{name} is not JSON")

    try:
        return json.loads(text.removeprefix("﻿"), parse_constant=refuse)
    except json.JSONDecodeError as e:
        raise LosslessError(f"{e.msg} at line {e.lineno}, column {e.colno}") from e


def write_json(value) -> str:
    """Two spaces a level; non-finite numbers are refused."""
    return json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False)


def column_union(rows: list[dict]) -> list[str]:
    """Keys in the order in which they are first seen."""
    return list(dict.fromkeys(k for r in rows for k in r))


def json_table(text: str) -> list[dict]:
    """Objects are rows, scalars a `Value` column, one object one row."""
    data = parse_json(text)
    if isinstance(data, dict):
        return [data]
    if not isinstance(data, list):
        raise ValueError("neither a list nor an object")
    if all(isinstance(r, dict) for r in data):
        names = column_union(data)
        return [{n: r.get(n) for n in names} for r in data]
    if any(isinstance(r, (dict, list)) for r in data):
        raise ValueError("a list of mixed values is no table")
    return [{"Value": r} for r in data]


def toml_json(text: str) -> str:
    """A TOML document as compact JSON; dates and times as text."""
    return json.dumps(tomllib.loads(text), default=str, ensure_ascii=False, separators=(",", ":"))


def jsonml(node: ET.Element) -> list:
    """[name, {attributes}, ...children]."""
    out: list = [node.tag, dict(node.attrib)]
    if node.text:
        out.append(node.text)
    for kid in node:
        out.append(jsonml(kid))
        if kid.tail:
            out.append(kid.tail)
    return out


def _safe_xml(text: str) -> ET.Element:
    if re.search(r"<!ENTITY", text, re.I):
        raise ValueError("entity declarations are refused")
    return ET.fromstring(text)


def xml_jsonml(text: str) -> str:
    return json.dumps({"$jsonml": jsonml(_safe_xml(text))}, ensure_ascii=False, separators=(",", ":"))


def xml_records(text: str) -> list[dict]:
    """The elements that repeat below the root, attributes and child texts as fields."""
    root = _safe_xml(text)
    return [{**kid.attrib, **{k.tag: (k.text or "") for k in kid}} for kid in root]


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of a workbook, shared and inline texts resolved, empty cells in between kept."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = rels[sheet.get(_REL)].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        for row in ET.fromstring(z.read(target)).iter(f"{{{_NS['m']}}}row"):
            cells: list[str] = []
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                v = c.find("m:v", _NS)
                if c.get("t") == "s":
                    cells.append(shared[int(v.text)])
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
                elif c.get("t") == "b":
                    cells.append("TRUE" if v is not None and v.text == "1" else "FALSE")
                else:
                    cells.append(v.text if v is not None and v.text else "")
            out.append((sheet.get("name"), int(row.get("r", len(out) + 1)), cells))
    return out


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of inline texts, numbers and truth values."""
    buffer = io.BytesIO()
    main, esc = _NS["m"], lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>')
        names = "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="x" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            cell = lambda v: "<c/>" if v is None else f'<c t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{esc(v)}</t></is></c>'
            body = "".join(f'<row r="{r}">' + "".join(map(cell, row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of all workbooks under a path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = xlsx_rows(bytes(content))
                yield pd.DataFrame({"path": p, "sheet": [r[0] for r in rows], "row": [r[1] for r in rows], "cells": [r[2] for r in rows]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, sheet string, row long, cells array<string>")


def map_text(col: Column, fn) -> Column:
    """A text function over a column, vectorised in batches; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fn(t))

    return F.pandas_udf(run, "string")(col)


def glob_regex(pattern: str) -> str:
    """`*` within a folder, `**` across folders, `?` one character."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def subtitle_cues(text: Column) -> Column:
    """(start, end, text) of the cues of a subtitle file, times in milliseconds."""
    time = r"(\d{1,3}):(\d\d):(\d\d)[,.](\d{3})"
    blocks = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{2,}")
    at = lambda b, i: F.regexp_extract(b, time + r"\s*-->\s*" + time, i).cast("long")
    ms = lambda b, i: ((at(b, i) * 60 + at(b, i + 1)) * 60 + at(b, i + 2)) * 1000 + at(b, i + 3)
    body = lambda b: F.regexp_extract(b, r"(?s)-->[^\n]*\n(.*)$", 1)
    cues = F.filter(blocks, lambda b: b.rlike(time + r"\s*-->\s*" + time))
    return F.transform(cues, lambda b: F.struct(ms(b, 1).alias("start"), ms(b, 5).alias("end"), F.trim(body(b)).alias("text")))
