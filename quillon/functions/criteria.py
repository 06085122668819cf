"""Spreadsheet criteria strings as predicates: `>5`, `<>`, `apple*`, `?ig`, a number, a boolean."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPERATOR = re.compile(r"^(<=|>=|<>|<|>|=)?(.*)$", re.S)
_NUMBER = re.compile(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def wildcard_regex(pattern: str) -> str:
    """`*` any run, `?` one character, `~` takes the next literally; the whole text, letter case ignored."""
    out, chars = [], iter(pattern)
    for c in chars:
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        else:
            literal = next(chars, "~") if c == "~" else c
            out.append(re.sub(r"([\\.\[\]{}()+^$|*?-])", r"\\\1", literal))
    return "(?is)^" + "".join(out) + "$"


def criterion(col: Column, wanted: str | float | bool, numeric: bool) -> Column:
    """Whether a cell meets a criterion. numeric says whether the column holds numbers or text; a blank is null or ''."""
    blank = col.isNull() if numeric else (col.isNull() | (col == ""))
    if isinstance(wanted, bool):
        return F.coalesce(col.cast("boolean") == F.lit(wanted), F.lit(False))
    if isinstance(wanted, (int, float)):
        return criterion(col, repr(wanted), numeric)
    op, rest = _OPERATOR.match(wanted).groups()
    if rest == "":
        return ~blank if op == "<>" else blank
    op = op or "="
    if _NUMBER.match(rest):
        value = F.lit(float(rest))
        number = col.cast("double") if numeric else F.when(col.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(col)).cast("double")
        tests = {"=": number == value, "<>": number.isNull() | (number != value), "<": number < value, ">": number > value, "<=": number <= value, ">=": number >= value}
        return F.coalesce(tests[op], F.lit(op == "<>"))
    if numeric:
        return F.lit(op == "<>")
    if op in ("=", "<>"):
        hit = F.coalesce(col.rlike(wildcard_regex(rest)), F.lit(False))
        return ~hit if op == "<>" else hit
    low, value = F.upper(col), F.lit(rest.upper())
    return F.coalesce({"<": low < value, ">": low > value, "<=": low <= value, ">=": low >= value}[op], F.lit(False))


def all_of(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
