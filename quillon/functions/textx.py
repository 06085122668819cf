"""Spreadsheet text functions, cell quoting and text normalisation as Column builders."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .criteria import wildcard_regex

# fixed value: the pattern of cells that a spreadsheet would run as a formula, numbers with a sign excepted
FORMULA = r"^(?:[=@\t\r]|[+-](?!(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?(?:[eE][+-]?\d+)?$|\.\d+(?:[eE][+-]?\d+)?$)[^\s\r\n][^\r\n]*$)"
# fixed values: a segment of a page's path that may be shown, one that could be an id, what stands for others, how many are shown
SHOWN_SEGMENT, ID_SEGMENT, MASKED_SEGMENT, SHOWN_SEGMENTS = r"^[a-z0-9-]{1,48}$", r"\d{6,}|^[0-9a-f-]{16,}$", ":x", 8


def proper(s: Column) -> Column:
    """First letter of each run of letters upper, the others lower."""
    return F.initcap(F.lower(s))


def trim(s: Column) -> Column:
    """Spaces only: none at the ends, one between words."""
    return F.regexp_replace(F.trim(s), " +", " ")


def left(s: Column, n: int = 1) -> Column:
    return F.substring(s, 1, n)


def right(s: Column, n: int = 1) -> Column:
    return F.substring(s, F.greatest(F.char_length(s) - n + 1, F.lit(1)), F.lit(n))


def mid(s: Column, start: int, n: int) -> Column:
    return F.substring(s, start, n)


def find(needle: str, s: Column, start: int = 1) -> Column:
    """Place of the first exact match; null if none."""
    return F.nullif(F.locate(needle, s, start), F.lit(0))


def search(pattern: str, s: Column) -> Column:
    """Place of the first match, letter case ignored, with wildcards; null if none."""
    body = wildcard_regex(pattern)[len("(?is)^") : -1].replace(".*", ".*?")
    before = F.regexp_extract(s, f"(?is)^(.*?){body}", 1)
    return F.when(s.rlike(f"(?is){body}"), F.char_length(before) + 1)


def substitute(s: Column, old: str, new: str, nth: int | None = None) -> Column:
    if nth is None:
        return F.replace(s, F.lit(old), F.lit(new))
    parts = F.split(s, "\\Q" + old + "\\E")
    head = F.array_join(F.slice(parts, 1, nth), old)
    tail = F.array_join(F.slice(parts, F.lit(nth + 1), F.greatest(F.size(parts) - nth, F.lit(0))), old)
    return F.when(F.size(parts) > nth, F.concat(head, F.lit(new), tail)).otherwise(s)


def replace_at(s: Column, start: int, n: int, new: str) -> Column:
    return F.overlay(s, F.lit(new), F.lit(start), F.lit(n))


def rept(s: Column, n: int, most: int = 32_767) -> Column:
    """Null where the text would be longer than a cell holds."""
    return F.when(F.char_length(s) * n <= most, F.repeat(s, n))


def textjoin(separator: str, skip_empty: bool, *cells: Column) -> Column:
    texts = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    return F.array_join(F.filter(texts, lambda t: t != "") if skip_empty else texts, separator)


def numbervalue(s: Column, decimal: str = ".", group: str = ",") -> Column:
    """A number in the given notation; null if the text is none."""
    plain = F.translate(F.regexp_replace(s, r"\s", ""), group, "")
    plain = F.translate(plain, decimal, ".") if decimal != "." else plain
    return F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain).cast("double")


def guard_formula(s: Column) -> Column:
    """An apostrophe before a cell that a spreadsheet would run."""
    return F.when(s.rlike(FORMULA), F.concat(F.lit("'"), s)).otherwise(s)


def delimited_cell(s: Column, delimiter: str = ",", escape_formulas: bool = True, single_column: bool = False) -> Column:
    """One cell of delimited text: the formula guard, then quotes where the text holds a quote, the delimiter, a line
    break, a byte-order mark or a space at either end. A null or empty cell is empty, `""` in a one-column table."""
    text = F.coalesce(s, F.lit(""))
    guarded = text.rlike(FORMULA) if escape_formulas else F.lit(False)
    body = F.when(guarded, F.concat(F.lit("'"), text)).otherwise(text)
    marks = "[\"\\r\\n﻿" + ("\\t" if delimiter == "\t" else "\\" + delimiter) + "]"
    quoted = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('""')), F.lit('"'))
    cell = F.when(guarded | body.rlike(marks + "|^ | $"), quoted).otherwise(body)
    # most cells stay as they are; one pattern finds all that might not
    odd = marks + r"|^[ =@\t+-]|[ \u0085\u2028\u2029]$"
    return F.when(text == "", F.lit('""' if single_column else "")).when(~text.rlike(odd), text).otherwise(cell)


def rfc4180_cell(s: Column) -> Column:
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def language_tag(s: Column) -> Column:
    """Canonical case of a language[-script][-region] tag; null if it is none."""
    pattern = r"^([a-zA-Z]{2,3})(?:-([a-zA-Z]{4}))?(?:-([a-zA-Z]{2}|\d{3}))?$"
    tag = F.replace(F.trim(s), F.lit("_"), F.lit("-"))
    part = lambda i: F.regexp_extract(tag, pattern, i)
    script = F.when(part(2) != "", F.concat(F.lit("-"), F.initcap(F.lower(part(2))))).otherwise("")
    region = F.when(part(3) != "", F.concat(F.lit("-"), F.upper(part(3)))).otherwise("")
    return F.when(tag.rlike(pattern), F.concat(F.lower(part(1)), script, region))


def natural_key(s: Column, width: int = 20) -> Column:
    """A sort key that compares runs of digits as numbers."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"\d+|\D+"), F.lit(0))
    pad = lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)
    return F.array_join(F.transform(parts, pad), "")


def slug(s: Column) -> Column:
    """Lower case, marks dropped, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^\p{L}\p{N}\p{M}\p{Pc} -]", ""), " ", "-")


def sheet_name(s: Column) -> Column:
    return F.substring(F.regexp_replace(s, r"[\\/*?:\[\]]", "_"), 1, 31)


def column_index(letters: Column) -> Column:
    """A to 0, Z to 25, AA to 26."""
    chars = F.split(F.upper(letters), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + (F.ascii(c) - 64)) - 1


def line_and_column(text: Column, offset: Column) -> Column:
    """(line, column) of a 0-based offset, both from 1."""
    before = F.substring(text, F.lit(1), offset)
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.char_length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def shortest_double(x: Column) -> Column:
    """A double as a script would print it: no `.0`, exponents from 1e21 on and below 1e-6."""
    text = x.cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", x), r"0+$", ""), r"\.$", "")
    big = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(exponent.startswith("-"), F.lit("")).otherwise(F.lit("+")), exponent)
    whole = F.when((F.abs(x) < 1e21) & (x == F.floor(x)), x.cast("decimal(38,0)").cast("string"))
    return (
        F.when(x == 0, F.lit("0"))
        .when((F.abs(x) >= 1e21) | (F.abs(x) < 1e-6), big)
        .otherwise(F.coalesce(whole, F.when(text.contains("E"), plain).otherwise(text)))
    )


def dollar(x: Column, digits: int = 2) -> Column:
    """An amount with its sign, grouped; a negative one in brackets."""
    text = F.concat(F.lit("$"), F.format_number(F.abs(F.round(x, digits)), max(digits, 0)))
    return F.when(F.round(x, digits) < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def slug_pair(slug: Column) -> Column:
    """(source, target) of a `source-to-target` name; nulls where it has no or several separators."""
    parts = F.split(slug, "-to-")
    part = lambda i: F.when(F.size(parts) == 2, F.get(parts, F.lit(i)))
    return F.struct(part(0).alias("source"), part(1).alias("target"))


def letters(n: Column) -> Column:
    """The counter a, b, ... z, aa, ab, ... of a number from 1 on, up to seven letters."""
    step = lambda s, _: F.when(s.n <= 0, s).otherwise(F.struct(F.floor((s.n - 1) / 26).cast("long").alias("n"), F.concat(F.chr(F.lit(97) + (s.n - 1) % 26), s.t).alias("t")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(n.cast("long").alias("n"), F.lit("").alias("t")), step, lambda s: s.t)


def ip_number(address: Column) -> Column:
    """The 32-bit number of a dotted address; null if it is none."""
    parts = F.split(address, r"\.")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"), number)


def on_allow_list(address: Column, entry: Column) -> Column:
    """Whether an address fits an entry: an address, a network with its prefix, or parts with a * for any number."""
    base, prefix = ip_number(F.substring_index(entry, "/", 1)), F.when(entry.contains("/"), F.substring_index(entry, "/", -1).try_cast("int")).otherwise(32)
    size = F.pow(F.lit(2.0), 32 - prefix).cast("long")
    network = F.when(prefix.between(0, 32), F.floor(ip_number(address) / size) == F.floor(base / size))
    pairs = F.arrays_zip(F.split(address, r"\.").alias("a"), F.split(entry, r"\.").alias("e"))
    wild = ip_number(address).isNotNull() & F.forall(pairs, lambda p: (p.e == "*") | F.coalesce(p.a == p.e, F.lit(False)))
    return F.coalesce(F.when(entry.contains("*"), wild).otherwise(network), F.lit(False))


def structure_items(html: Column) -> Column:
    """Headings with their level, list items, cells with their spans and pictures by the digest of their data, as texts
    `kind|...` in the order of a page; comments and scripts are no part of it."""
    page = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", ""), r"\s+", " "))
    every = lambda p: F.regexp_extract_all(page, F.lit(p), F.lit(0))
    span = lambda x, n: F.coalesce(F.regexp_extract(x, rf"(?is)^<[^>]*\b{n}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    heads = F.transform(every(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), lambda x: F.concat(F.lit("heading|"), F.substring(x, 3, 1), F.lit("|"), text(x)))
    items = F.transform(every(r"(?is)<li\b[^>]*>.*?(?=<li\b|</li>|</?[uo]l\b|\z)"), lambda x: F.concat(F.lit("item|"), text(x)))
    cells = F.transform(every(r"(?is)<t[dh]\b[^>]*>.*?(?=<t[dhr]\b|</t[dhr]>|</table|\z)"), lambda x: F.concat_ws("|", F.lit("cell"), text(x), span(x, "colspan"), span(x, "rowspan")))
    data = F.regexp_extract_all(page, F.lit(r"(?is)<img\b[^>]*\bsrc\s*=\s*[\"']data:[^,\"']*;base64,([^\"']*)"), F.lit(1))
    images = F.transform(data, lambda x: F.concat(F.lit("image|"), F.sha2(F.unbase64(x), 256)))
    return F.concat(heads, items, cells, images)


# fixed values: elements that a reader does not see, and those that part words
UNSEEN = ["script", "style", "head", "template", "title", "noframes", "noscript", "select", "textarea", "object", "iframe", "svg"]
BREAKING = (
    ["address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure"]
    + ["footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody"]
    + ["td", "tfoot", "th", "thead", "tr", "ul"]
)


def visible_words(html: Column, open_references: bool = True) -> Column:
    """The words of two letters or digits and more that a page shows; what hides is left out, tags part words only where
    they start a line. Browsers read some references without their semicolon (`&amp`), which open_references=False leaves
    as they stand."""
    page = F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(UNSEEN)})\b[^>]*>.*?(?:</\1\s*>|\z)", "")
    page = F.regexp_replace(F.regexp_replace(page, rf"(?i)</?(?:{'|'.join(BREAKING)})\b[^>]*>", " "), r"</?[a-zA-Z][^>]*>", "")
    return F.regexp_extract_all(decoded(page, open_references), F.lit("[A-Za-z0-9]{2,}"), F.lit(0))


# fixed value: a reference closed by its semicolon
CLOSED_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def closed_unescape(text: str) -> str:
    """Character references closed by a semicolon as what they stand for, all else as it is."""
    return CLOSED_REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def decoded(s: Column, open_references: bool = True) -> Column:
    """Character references, named and numbered, as what they stand for."""
    read = unescape if open_references else closed_unescape

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: read(t) if isinstance(t, str) else None)

    return F.when(s.contains("&"), F.pandas_udf(run, "string")(s)).otherwise(s)


def nfkc(s: Column) -> Column:
    """Compatibility forms composed; texts of ASCII alone are their own."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: normalize("NFKC", t) if isinstance(t, str) else None)

    return F.pandas_udf(run, "string")(s)


def scrub(s: Column) -> Column:
    """Links, addresses, quoted texts, names of files, long tokens with a digit and long numbers as placeholders; white
    space collapsed."""
    # fixed values: the patterns that decide what is masked
    steps = [
        (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s\"'`<>)\]]*|\b(?:blob|data):[^\s\"'`<>)\]]*", "[url]"),
        (r"[^\s@\"'`<>()]+@[^\s@\"'`<>()]+\.[A-Za-z]{2,}", "[email]"),
        (r"([\"'`])(?=[^\"'`\n]{0,199}[\s./\\])[^\"'`\n]{1,200}?\1", "$1[text]$1"),
        (rf"(?i)[^\s\"'`()<>,;:=\\/]+\.(?:{'|'.join(sorted(rules.FILE_FORMATS, key=len, reverse=True))})(?![A-Za-z0-9_$(])", "[file]"),
        (r"(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{20,}", "[token]"),
        (r"\d{9,}", "[n]"),
        (r"[\p{Cc}\s]+", " "),
    ]
    for pattern, mask in steps:
        s = F.regexp_replace(s, pattern, mask)
    return F.trim(s)


def page_path(url_path: Column) -> Column:
    """A rooted path without query or fragment, its first segments, those masked that could be an id or a name; null for
    others."""
    rooted = F.regexp_extract(url_path, r"^/(?!/)([^?#]*)", 1)
    shown = F.slice(F.array_remove(F.split(rooted, "/"), ""), 1, SHOWN_SEGMENTS)
    masked = F.transform(shown, lambda p: F.when(p.rlike(ID_SEGMENT) | ~p.rlike(SHOWN_SEGMENT), F.lit(MASKED_SEGMENT)).otherwise(p))
    return F.when(url_path.rlike(r"^/(?!/)"), F.concat(F.lit("/"), F.array_join(masked, "/")))


def browser_family(agent: Column) -> Column:
    # fixed values: tried in this order
    families = [
        ("edge", r"\bEdg(?:e|A|iOS)?/"),
        ("opera", r"\b(?:OPR|Opera)/"),
        ("firefox", r"\b(?:Firefox|FxiOS)/"),
        ("chrome", r"\b(?:Chrome|CriOS|Chromium)/"),
        ("safari", r"\bSafari/"),
    ]
    out = F.lit("other")
    for name, pattern in reversed(families):
        out = F.when(agent.rlike(pattern), name).otherwise(out)
    return out
