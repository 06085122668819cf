"""YAML, workbooks and value limits on literal cases."""

import json
import math

import pytest

from quillon.sources import documents, workbooks, yamltext


@pytest.mark.parametrize(
    "text, want",
    [
        ("", None),
        ("# only a comment\n", None),
        ("a: 1\nb:\n- x\n- y: 2\n  z: 3\n", {"a": 1, "b": ["x", {"y": 2, "z": 3}]}),
        ("- - 1\n  - 2\n-\n  k: v\n-\n", [[1, 2], {"k": "v"}, None]),
        ("---\na: {b: [1, 2.5, 'x, y'], c: }\n", {"a": {"b": [1, 2.5, "x, y"], "c": None}}),
        ('a: "line\\nbreak \\u00e9"\n', {"a": "line\nbreak é"}),
        ("a: |-\n  one\n\n  two\nb: >\n  folded\n  text\n\n  next\n", {"a": "one\n\ntwo", "b": "folded text\nnext\n"}),
        ("a: &x [1]\nb: *x\n", {"a": [1], "b": [1]}),
        ("u: http://a.b/c#d # no\nt: 12:30\nn: yes\no: 0o17\n", {"u": "http://a.b/c#d", "t": "12:30", "n": "yes", "o": 15}),
        ("a: !!str 1\n", {"a": "1"}),
        ("a: [1,\n  2]\n", {"a": [1, 2]}),
        ("big: 12345678901234567890\n", {"big": 12345678901234567890}),
    ],
)
def test_yaml_reads(text, want):
    assert yamltext.parse(text) == want


@pytest.mark.parametrize("text", ["a: 1\na: 2\n", "a: [1\n", "a: *x\n", "a: 1\n  b: 2\n", "\ta: 1\n", "a: 'x\n", "--- \na: 1\n---\nb: 2\n", "a: &x [*x]\n"])
def test_yaml_refuses(text):
    with pytest.raises(yamltext.YamlError):
        yamltext.parse(text)


def test_yaml_limits():
    bomb = "a0: &a0 [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"a{i}: &a{i} [" + ", ".join([f"*a{i - 1}"] * 9) + "]\n" for i in range(1, 8))
    with pytest.raises(yamltext.YamlError):
        yamltext.parse(bomb)
    with pytest.raises(yamltext.YamlError):
        yamltext.parse("a: " + "[" * 200 + "]" * 200)
    assert math.isinf(yamltext.parse("a: .inf")["a"])


@pytest.mark.parametrize("value", [None, [], {}, "x", {"a": [{"b": [], "c": {}}, [1, [2, "3"]], "- x", "", " pad ", "null", "a: b", "#", "two\nlines", True, 1.5, -0.0, 1e300]}, {"k: y": {"-": "?"}, "": "~", "1": "0x10"}])
def test_yaml_round_trip(value):
    assert yamltext.parse(yamltext.write(value)) == value


def test_detected_kinds():
    cells = ["1", "007", "-2.50", "1e5", "12345678901234567890", "TRUE", "true", "", None, "x"]
    assert [workbooks.detect(c) for c in cells] == [1, "007", -2.5, "1e5", "12345678901234567890", True, "true", None, None, "x"]


def test_workbooks_keep_kinds():
    rows = [[1, "a & <b>", None, True], [2.5, "two\nlines", "x", False]]
    want = [("s & t", 1, ["1", "a & <b>", "", "TRUE"]), ("s & t", 2, ["2.5", "two\nlines", "x", "FALSE"])]
    assert workbooks.ods_rows(workbooks.ods_bytes({"s & t": rows, "none": []})) == want
    assert documents.xlsx_rows(documents.xlsx_bytes({"s & t": rows})) == want


def test_sheets_as_text():
    one = [{"sheet": "a", "rows": [["x", "x"], ["1"], ["2", "3", "4"]]}]
    assert json.loads(workbooks.json_text(one)) == [{"x": "1", "x_1": "", "Unnamed: 2": ""}, {"x": "2", "x_1": "3", "Unnamed: 2": "4"}]
    assert json.loads(workbooks.json_text(one + [{"sheet": "b", "rows": []}]))["b"] == []
    assert "<col_3>4</col_3>" in workbooks.xml_text(one)
    assert workbooks.html_text([{"sheet": "<s>", "rows": []}]).count("&lt;s&gt;") == 1
    assert workbooks.json_text([]) == "[]"
