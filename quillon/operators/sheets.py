"""Sheets: ranges of cells, selection of sheets, and the order of cells of mixed kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import placed


def parse_range(text: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column), from 0, of the first area of an A1 range; its corners in any order."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", re.split(r"[,;]", text.rpartition("!")[2])[0].strip())
    if not m or "0" in (m[2], m[4]):
        raise ValueError(f"{text!r} is no range")

    def column(letters: str) -> int:
        n = 0
        for c in letters.upper():
            n = n * 26 + ord(c) - 64
        return n - 1

    rows = sorted((int(m[2]) - 1, int(m[4] or m[2]) - 1))
    columns = sorted((column(m[1]), column(m[3] or m[1])))
    return rows[0], columns[0], rows[1], columns[1]


def project(df: DataFrame, ordinal: str, cells: str) -> DataFrame:
    """The rows and columns of df that a range names, rows in the order of a unique ordinal; what lies outside is left out."""
    top, left, bottom, right = parse_range(cells)
    kept = placed(df, [F.col(ordinal).asc()], "_place").where(F.col("_place").between(top + 1, bottom + 1))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns[left : right + 1]])


def select_sheets(book: DataFrame, mode: str, index: int = 0) -> DataFrame:
    """Rows with (ordinal, sheet): of one sheet by its index; of all, `merged`; or of all with the file that each sheet
    goes to, its place and name, `split`."""
    if mode == "index":
        return book.where(F.col("ordinal") == index)
    if mode == "merged":
        return book
    if mode == "split":
        return book.withColumn("file", F.concat((F.col("ordinal") + 1).cast("string"), F.lit("-"), F.regexp_replace("sheet", r"[\\\\/*?:\\[\\]]", "_")))
    raise ValueError(f"{mode!r} is no mode")


def ranked(cell: Column) -> Column:
    """A cell (kind, value) as a value with an order: numbers before texts before truth values, letter case ignored."""
    kind, value = cell.getField("kind"), cell.getField("value")
    rank = F.when(kind == "number", 0).when(kind == "text", 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.when(kind == "number", value.try_cast("double")).alias("number"), F.upper(value).alias("text"))
