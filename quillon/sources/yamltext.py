"""YAML read and written as plain data: block and flow lists and maps, quoted and plain scalars, literal and folded blocks,
comments, anchors and aliases. Scalars follow the core schema of YAML 1.2. Not read, with an error: plain or quoted scalars
over several lines, explicit keys (`?`), tags other than those of the core schema, and several documents in one text."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents

#: What a text may name and unfold.
MOST_ALIASES = 100
MOST_DEPTH = 128
MOST_VALUES = 524_288
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`?-].*?|[?-][^\s].*?)\s*:(?=\s|$)""")
_TAGS = {"!!str": str, "!!int": int, "!!float": float}


class YamlError(ValueError):
    """Text that is not YAML, or not of the part that is read, with its line."""


class _Reader:
    def __init__(self, text: str) -> None:
        self.lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")
        self.at, self.named, self.aliases = 0, {}, 0

    def fail(self, what: str):
        raise YamlError(f"{what} at line {self.at + 1}")

    def peek(self) -> tuple[int, str] | None:
        """(indent, content) of the next line that has any."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.strip()
            if bare and not bare.startswith("#"):
                indent = len(line) - len(line.lstrip(" "))
                if line[indent] == "\t":
                    self.fail("a tab as indentation")
                return indent, line[indent:].rstrip()
            self.at += 1
        return None

    def node(self, depth: int):
        if depth > MOST_DEPTH:
            self.fail(f"more than {MOST_DEPTH} levels")
        indent, content = self.peek()
        if content == "-" or content.startswith("- "):
            return self.items(indent, depth)
        if _KEY.match(content):
            return self.fields(indent, depth)
        self.at += 1
        return self.value(content, indent, depth)

    def below(self, indent: int, depth: int, same: bool = False):
        """What stands under a key or dash: deeper lines, or under a key a list of its own indentation."""
        found = self.peek()
        if found and (found[0] > indent or same and found[0] == indent and (found[1] == "-" or found[1].startswith("- "))):
            return self.node(depth + 1)
        return None

    def items(self, indent: int, depth: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].lstrip()
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.below(indent, depth))
            elif rest.startswith("- ") or _KEY.match(rest):
                self.lines[self.at] = " " * (indent + len(found[1]) - len(rest)) + rest
                out.append(self.node(depth + 1))
            else:
                self.at += 1
                out.append(self.value(rest, indent, depth))
        if found and found[0] > indent:
            self.fail("unexpected indentation")
        return out

    def fields(self, indent: int, depth: int) -> dict:
        out: dict = {}
        while (found := self.peek()) and found[0] == indent:
            m = _KEY.match(found[1])
            if not m:
                break
            key, rest = m[1], found[1][m.end() :].strip()
            key = self.quoted(key)[0] if key[0] in "\"'" else key
            if key in out:
                self.fail(f"key {key!r} twice")
            self.at += 1
            out[key] = self.value(rest, indent, depth, same=True)
        if found and found[0] > indent:
            self.fail("unexpected indentation")
        return out

    def value(self, rest: str, indent: int, depth: int, same: bool = False):
        name, tag = None, None
        while m := re.match(r"(&\S+|!!?\w*)(?:\s+|$)", rest):
            name, tag = (m[1][1:], tag) if m[1][0] == "&" else (name, m[1])
            rest = rest[m.end() :]
        if tag and tag not in (*_TAGS, "!!map", "!!seq", "!!null", "!!bool"):
            self.fail(f"tag {tag}")
        if not rest or rest.startswith("#"):
            out = self.below(indent, depth, same)
        elif rest[0] in "|>":
            out = self.block(rest, indent)
        else:
            while rest[0] in "[{" and not self.closed(rest) and self.at < len(self.lines):
                rest += " " + self.lines[self.at].strip()
                self.at += 1
            out, end = self.flow(rest, 0, depth, "")
            tail = rest[end:].strip()
            if tail and not tail.startswith("#"):
                self.fail(f"unexpected {tail[:20]!r}")
        if tag in _TAGS and not isinstance(out, (list, dict)):
            out = "" if tag == "!!str" and out is None else _TAGS[tag](rest if tag == "!!str" and not isinstance(out, str) else out)
        if name:
            self.named[name] = out
        return out

    def closed(self, text: str) -> bool:
        bare = re.sub(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', "", text)
        return sum(map(bare.count, "[{")) <= sum(map(bare.count, "]}"))

    def block(self, head: str, indent: int) -> str:
        """A literal or folded block scalar."""
        m = re.fullmatch(r"([|>])([+-]?)(\d?)([+-]?)(?:\s+#.*)?", head)
        if not m:
            self.fail("a block's head")
        own, taken = int(m[3]) + max(indent, 0) if m[3] else None, []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                deep = len(line) - len(line.lstrip(" "))
                own = deep if own is None and deep > indent else own
                if own is None or deep < own:
                    break
            taken.append(line[own or 0 :] if line.strip() else "")
            self.at += 1
        kept = len(taken)
        while kept and not taken[kept - 1]:
            kept -= 1
        body, blank = taken[:kept], len(taken) - kept
        text = "\n".join(body)
        if m[1] == ">":
            text = re.sub(r"(?<=[^\n ])\n(?=[^\n ])", " ", text)
            text = re.sub(r"(?<=[^\n])\n(\n+)(?=[^\n ])", r"\1", text)
        chomp = m[2] or m[4]
        return text + ("" if chomp == "-" or not body and chomp != "+" else "\n" * (1 + blank if chomp == "+" else 1))

    def quoted(self, text: str) -> tuple[str, int]:
        m = re.match(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\']|\'\')*)\'', text)
        if not m:
            self.fail("an open quote")
        if m[2] is not None:
            return m[2].replace("''", "'"), m.end()
        named = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}
        one = lambda e: chr(int(e[1][1:], 16)) if len(e[1]) > 1 else named.get(e[1], e[1])
        return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, m[1]), m.end()

    def flow(self, text: str, at: int, depth: int, inside: str):
        """(value, end) of a flow list or map, a quoted or plain scalar, or an alias."""
        if depth > MOST_DEPTH:
            self.fail(f"more than {MOST_DEPTH} levels")
        skip = lambda i: i + len(text[i:]) - len(text[i:].lstrip())
        at = skip(at)
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            out, close = ([], "]") if c == "[" else ({}, "}")
            at = skip(at + 1)
            while text[at : at + 1] != close:
                if at >= len(text):
                    self.fail(f"no {close}")
                value, at = self.flow(text, at, depth + 1, c)
                at = skip(at)
                pair = text[at : at + 1] == ":"
                if pair:
                    key, (value, at) = value, self.flow(text, at + 1, depth + 1, c)
                    at = skip(at)
                if c == "{":
                    out[_text(key if pair else value)] = value if pair else None
                else:
                    out.append({_text(key): value} if pair else value)
                if text[at : at + 1] == ",":
                    at = skip(at + 1)
                elif text[at : at + 1] != close:
                    self.fail(f"no , or {close}")
            return out, at + 1
        if c in ("'", '"') and c:
            value, n = self.quoted(text[at:])
            return value, at + n
        m = re.compile(r"(?:(?!:(?:\s|$|[,\[\]{}]))[^,\[\]{}\n])*?(?=\s*(?:$|[,\[\]{}]|:(?:\s|$|[,\[\]{}])|\s#))" if inside else r".*?(?=\s*$|\s+#)").match(text, at)
        if not m:
            self.fail("a scalar")
        if m[0].startswith("*"):
            self.aliases += 1
            if self.aliases > MOST_ALIASES:
                self.fail(f"more than {MOST_ALIASES} aliases")
            if m[0][1:] not in self.named:
                self.fail(f"no anchor {m[0][1:]}")
            return self.named[m[0][1:]], m.end()
        return scalar(m[0]), m.end()


def scalar(text: str):
    """A plain scalar by the core schema."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text[0] in "tT"
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"0o[0-7]+|0x[0-9a-fA-F]+", text):
        return int(text, 0)
    if re.fullmatch(r"[-+]?(\.\d+|\d+(\.\d*)?)([eE][-+]?\d+)?", text):
        return float(text)
    if m := re.fullmatch(r"([-+]?)\.(inf|Inf|INF)", text):
        return -math.inf if m[1] == "-" else math.inf
    return math.nan if text in (".nan", ".NaN", ".NAN") else text


def _text(key) -> str:
    return key if isinstance(key, str) else "" if key is None else json.dumps(key)


def parse(text: str, most: int = MOST_VALUES):
    """The data of one document; an alias counts with all that it unfolds to."""
    lines = [line.rstrip() for line in text.split("\n")]
    if sum(line == "---" for line in lines) > 1:
        raise YamlError("several documents")
    reader = _Reader("\n".join("" if line.rstrip() in ("---", "...") or line.startswith("%YAML") else line for line in text.split("\n")))
    if reader.peek() is None:
        return None
    out = reader.node(0)
    if reader.peek() is not None:
        reader.fail("unexpected content")
    left, todo = most, [out]
    while todo:
        x = todo.pop()
        left -= 1
        if left < 0:
            raise YamlError(f"more than {most} values")
        todo += x if isinstance(x, list) else x.values() if isinstance(x, dict) else ()
    return out


def _plain(value) -> str:
    if not isinstance(value, str):
        return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else json.dumps(value)
    safe = re.fullmatch(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`][^\n\r\t:#]*", value) and not value.endswith(" ") and isinstance(scalar(value), str) and value not in ("---", "...")
    return value if safe else json.dumps(value, ensure_ascii=False)


def write(value, indent: int = 0) -> str:
    """Block YAML, two spaces a level, with a line end after the last line; texts that would read as something else are quoted."""
    pad = " " * indent
    if isinstance(value, dict) and value:
        nested = lambda v: isinstance(v, (dict, list)) and v
        return "".join(f"{pad}{_plain(str(k))}:" + ("\n" + write(v, indent + 2) if nested(v) else f" {write(v).rstrip()}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}- {write(v, indent + 2).lstrip(' ')}" if isinstance(v, (dict, list)) and v else f"{pad}- {write(v)}" for v in value)
    return pad + ("{}" if value == {} and isinstance(value, dict) else "[]" if isinstance(value, list) else _plain(value)) + "\n"


def yaml_json(text: str) -> str:
    """A document as compact JSON; infinities and NaN are refused."""
    return json.dumps(parse(text), ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def json_yaml(text: str) -> str:
    return write(json.loads(text))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of all YAML files under a path, each read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", documents.map_text(F.col("value"), yaml_json).alias("json"))
