"""Literal cases of the spreadsheet functions, sources and series statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import datesx, distributions, finance, mathx, textx
from quillon.functions.criteria import criterion
from quillon.operators import intervals, ranking, series
from quillon.sources import delimited, documents


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: F.round(F.lit(2.675), 2), 2.68), (lambda: F.round(F.lit(-1.5), 0), -2.0), (lambda: mathx.away_from_zero(F.lit(3.14159), 3), 3.142), (lambda: mathx.toward_zero(F.lit(-3.99)), -3.0),
        (lambda: mathx.toward_zero(F.lit(7.89), 1), 7.8), (lambda: mathx.mod(F.lit(-10), F.lit(3)), 2), (lambda: mathx.mod(F.lit(5), F.lit(0)), None), (lambda: mathx.ceiling(F.lit(2.1), 0.5), 2.5),
        (lambda: mathx.floor(F.lit(2.9), 0.5), 2.5), (lambda: mathx.fact(F.lit(6)), 720.0), (lambda: mathx.gcd(F.lit(12), F.lit(18)), 6), (lambda: mathx.lcm(F.lit(4), F.lit(6)), 12),
        (lambda: mathx.mround(F.lit(10), 3.0), 9.0), (lambda: mathx.quotient(F.lit(7), F.lit(2)), 3.0), (lambda: mathx.even(F.lit(3)), 4.0), (lambda: mathx.odd(F.lit(2)), 3.0),
        (lambda: mathx.combin(F.lit(5), F.lit(2)), 10.0), (lambda: mathx.safe_sqrt(F.lit(-1.0)), None), (lambda: textx.proper(F.lit("hello world")), "Hello World"), (lambda: textx.trim(F.lit("  Date  x ")), "Date x"),
        (lambda: textx.mid(F.lit("hello world"), 7, 3), "wor"), (lambda: textx.find("l", F.lit("hello world")), 3), (lambda: textx.find("L", F.lit("hello world")), None), (lambda: textx.search("h*o", F.lit("hello world")), 1),
        (lambda: textx.substitute(F.lit("hello world"), "l", "L", 2), "helLo world"), (lambda: textx.replace_at(F.lit("hello world"), 1, 5, "bye"), "bye world"), (lambda: textx.numbervalue(F.lit("1.234,5"), ",", "."), 1234.5),
        (lambda: textx.textjoin(",", True, F.lit("a"), F.lit(""), F.lit("b")), "a,b"), (lambda: textx.column_index(F.lit("AA")), 26), (lambda: textx.language_tag(F.lit("zh_hant-tw")), "zh-Hant-TW"),
        (lambda: textx.delimited_cell(F.lit("=SUM(A1:A2)")), "\"'=SUM(A1:A2)\""), (lambda: textx.delimited_cell(F.lit("-5")), "-5"), (lambda: datesx.date_of(F.lit(2020), F.lit(14), F.lit(35)).cast("string"), "2021-03-07"),
        (lambda: datesx.networkdays(F.lit("2020-01-01").cast("date"), F.lit("2020-02-01").cast("date")), 23), (lambda: datesx.weeknum(F.lit("2020-03-03").cast("date")), 10),
        (lambda: F.round(finance.pmt(F.lit(0.05 / 12), F.lit(60), F.lit(10000)), 6), -188.712336), (lambda: F.round(finance.npv(F.lit(0.1), [F.lit(100), F.lit(200), F.lit(300)]), 6), 481.592787),
        (lambda: F.round(finance.nper(F.lit(0.01), F.lit(-100), F.lit(1000)), 6), 10.588644), (lambda: finance.db(F.lit(10000.0), F.lit(1000.0), F.lit(5), F.lit(1)), 3690.0),
        (lambda: finance.db(F.lit(10000.0), F.lit(1000.0), F.lit(5), F.lit(2)), 2328.39), (lambda: finance.ddb(F.lit(100.0), F.lit(50.0), F.lit(2), F.lit(2)), 0.0), (lambda: finance.mirr(F.array(*[F.lit(float(x)) for x in (-1000, 300, 400, 500, 200)]), F.lit(0.1), F.lit(0.12)), 0.139033),
        (lambda: textx.letters(F.lit(703)), "aaa"), (lambda: textx.dollar(F.lit(-1234.567)), "($1,234.57)"), (lambda: textx.nfkc(F.lit("ﬁ①")), "fi1"), (lambda: textx.scrub(F.lit("see my.report.pdf now")), "see [file] now"), (lambda: textx.ip_number(F.lit("256.1.1.1")), None), (lambda: mathx.factdouble(F.lit(7)), 105.0),
        (lambda: datesx.workday(F.lit("2020-03-01").cast("date"), -2).cast("string"), "2020-02-27"), (lambda: F.round(distributions.poisson_pmf(F.lit(25), F.lit(20.0)), 9), 0.044587649), (lambda: F.round(distributions.binom_pmf(F.lit(3), F.lit(30), F.lit(0.3)), 9), 0.007203272),
        (lambda: F.round(finance.irr(F.array(*[F.lit(float(x)) for x in (-1000, 300, 400, 500, 200)])), 6), 0.153221), (lambda: F.round(finance.rate(F.lit(60.0), F.lit(-200.0), F.lit(10000.0)), 6), 0.006183),
    ],
)
def test_scalar(spark, make, want):
    got = one(spark, make())
    assert got == want if not isinstance(want, float) else got == pytest.approx(want, abs=2e-6)


def test_criteria(spark):
    df = spark.createDataFrame([("10",), ("20",), ("x",), ("abc",), (None,), ("-3",), ("4.5",), ("",)], "d string")
    count = lambda c: df.where(criterion(F.col("d"), c, False)).count()
    assert [count(c) for c in ("20", "", "<>", "?", "a*", ">4", "<>x")] == [1, 2, 6, 1, 1, 3, 7]


def test_distributions():
    assert distributions.norm_cdf_np(np.array([1.96]), 0.0, 1.0)[0] == pytest.approx(0.9750021048517795)
    assert distributions.t_cdf_np(np.array([2.0, -2.0]), np.array([10.0, 10.0])) == pytest.approx([0.9633059826146299, 0.0366940173853701])
    assert distributions.chisq_cdf_np(np.array([3.84145882069412]), np.array([1.0]))[0] == pytest.approx(0.95)
    assert distributions.f_cdf_np(np.array([3.0]), np.array([4.0]), np.array([9.0]))[0] == pytest.approx(0.9208, abs=1e-3)
    assert distributions.beta_i(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248)
    assert distributions.gamma_p(np.array([2.0]), np.array([1.0]))[0] == pytest.approx(1 - 2 / math.e)


def test_headers_and_ragged_rows():
    assert ranking.first_free_names(["a", "a", "a_1", "b", "a"]) == ["a", "a_2", "a_1", "b", "a_3"]
    names, rows, ragged = delimited.table_of(delimited.records("a,b\n1,2\n3,4,5\n\n6\n", ","))
    assert (names, rows, ragged) == (["a", "b", "Unnamed: 2"], [["1", "2", ""], ["3", "4", "5"], ["6", "", ""]], 2)
    assert delimited.detect_delimiter("name;price\nKim;4,20\nLee;5,00") == ";"
    assert delimited.detect_delimiter("x|y\n1|2", "\t") == "|"
    assert delimited.guess_line_break('a,"x\ny"\r\nb\r\n') == "\r\n"


def test_delimited_files(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_bytes("﻿a,a,c\r\n1,\"x,\"\"y\"\"\",3,4\r\n\r\n5\r\n".encode())
    got = delimited.read_delimited(spark, path)
    assert got.columns == ["a", "a_1", "c", "Unnamed: 3"]
    assert sorted(map(tuple, got.collect())) == [("1", 'x,"y"', "3", "4"), ("5", "", "", "")]
    (tmp_path / "q.csv").write_text('h1,h2\n"c\nd",e\n')
    whole = delimited.read_whole(spark, str(tmp_path / "q.csv")).orderBy("ordinal").collect()
    assert [r["cells"] for r in whole] == [["h1", "h2"], ["c\nd", "e"]]


def test_documents():
    assert documents.parse_json('{"a":1,"a":12345678901234567890}') == {"a": 12345678901234567890}
    with pytest.raises(documents.LosslessError, match="line 2, column"):
        documents.parse_json('{"a":\n x}')
    with pytest.raises(ValueError):
        documents.parse_json("[NaN]")
    assert documents.json_table('[{"a":1},{"b":2,"a":null}]') == [{"a": 1, "b": None}, {"a": None, "b": 2}]
    assert documents.json_table("[1,2]") == [{"Value": 1}, {"Value": 2}] and documents.json_table('{"items":[]}') == [{"items": []}]
    assert documents.xml_records('<c><r id="1"><n>x</n></r><r id="2"/></c>') == [{"id": "1", "n": "x"}, {"id": "2"}]
    with pytest.raises(ValueError):
        documents.xml_records('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')
    assert documents.toml_json('a = 1\nd = 2020-01-02\n[t]\nx = [true]') == '{"a":1,"d":"2020-01-02","t":{"x":[true]}}'
    book = documents.xlsx_bytes({"s&1": [["a", 1, None, 2.5], ["<b>"]]})
    assert documents.xlsx_rows(book) == [("s&1", 1, ["a", "1", "", "2.5"]), ("s&1", 2, ["<b>"])]
    assert [documents.detect_encoding(x) for x in (b"\xef\xbb\xbfa", "aé".encode(), "ab".encode("utf-16-le"), "안녕하세요".encode("euc_kr"), b"caf\xe9")] == ["utf-8-sig", "utf-8", "utf-16-le", "euc_kr", "cp1252"]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 5, 9), ("a", 11, 12), ("b", 3, 3)], "k string, x long, y long")
    assert sorted(map(tuple, intervals.merge(df, ["k"], "x", "y").collect())) == [("a", 0, 9, 2), ("a", 11, 12, 1), ("b", 3, 3, 1)]
    assert one(spark, intervals.page_selection(F.lit("3-5, 1, -2, 9-"), F.lit(10))) == [1, 2, 3, 4, 5, 9, 10]


def test_billing_month(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    end = lambda a, n: one(spark, F.date_format(datesx.billing_end(ts(a), ts(n)), "yyyy-MM-dd HH:mm"))
    assert end("2026-12-05 09:30:00", "2026-11-20 00:00:00") == "2026-12-05 09:30"
    assert end("2026-12-05 09:30:00", "2026-12-05 09:30:00") == "2027-01-05 09:30"
    assert end("2024-01-31 00:00:00", "2024-02-10 00:00:00") == "2024-02-29 00:00"


def test_series():
    points = [(100.0, 30.0), (200.0, 33.0), (400.0, 36.0), (800.0, 39.0)]
    assert series.bd_rate(points, [(r * 0.8, q) for r, q in points]) == pytest.approx(-20.0)
    assert series.bd_psnr(points, [(r, q + 1) for r, q in points]) == pytest.approx(1.0)
    assert [series.sign_test_rank(n, 0.95) for n in (5, 6, 10, 20)] == [0, 1, 2, 6]


def test_teds():
    from quillon.operators.treescore import teds

    a = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert teds(a, a) == 1.0
    assert teds(a, a.replace("c", "d")) == pytest.approx(1 - 1 / 6)
    assert teds(a, a.replace("<td>b</td>", "")) == pytest.approx(1 - 1 / 6)
    assert teds(a, "<table></table>") == pytest.approx(1 / 6)
    assert teds(a, a.replace("<td>a", '<td colspan="2">a')) == pytest.approx(1 - 1 / 6)


def _brute_levels(nodes, edges):
    level, left = {}, dict.fromkeys(nodes, 0)
    for _, b in edges:
        left[b] += 1
    now = [n for n in nodes if not left[n]]
    depth = 0
    while now:
        level |= dict.fromkeys(now, depth)
        for a, b in [e for e in edges if e[0] in set(now)]:
            left[b] -= 1
        now, depth = [n for n in nodes if not left[n] and n not in level], depth + 1
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("small", [True, False])
def test_graphs_of_any_depth(spark, monkeypatch, small):
    from quillon.operators import dag

    size, rungs = (1000, 40) if small else (12, 6)
    if not small:
        monkeypatch.setattr(dag, "SMALL", 3)
    chain = [(i, i + 1) for i in range(size)]
    ladder = [(a, b) for k in range(rungs) for a, b in ((-4 * k, -4 * k - 1), (-4 * k, -4 * k - 2), (-4 * k - 1, -4 * k - 4), (-4 * k - 2, -4 * k - 4))]
    loop = [(5000, 5001), (5001, 5000), (5001, 5002)]
    edges = chain + ladder + loop
    nodes = sorted({n for e in edges for n in e})
    e, n = spark.createDataFrame(edges, "src long, dst long").repartition(2), spark.createDataFrame([(x,) for x in nodes], "node long")
    assert {r["node"]: r["level"] for r in dag.levels(spark, n, e).collect()} == _brute_levels(nodes, edges)
    start = spark.createDataFrame([(3,), (5002,), (-4 * rungs + 4,)], "node long")
    want = {*range(3, size + 1), 5002, *(-4 * rungs + 4 - k for k in (0, 1, 2, 4))}
    assert sorted(r["node"] for r in dag.reachable(spark, e, start).collect()) == sorted(want)


def test_records_of_several_lines_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿a,b\r\n\"1\r\n2\",3\r\na,b\r\n\r\n".encode())
    (tmp_path / "b.csv").write_text('b,a,c\n"x ""y"", z",1,"\n\n"\n,"",w\U0010fffdm\U0010fffc\n')
    got = delimited.read_delimited(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ",")
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(tuple, got.collect())) == sorted([("1\r\n2", "3", ""), ("a", "b", ""), ("1", 'x "y", z', "\n\n"), ("", "", "w\U0010fffdm\U0010fffc")])
    (tmp_path / "c.csv").write_bytes(b"p;q\r1;2\r3;4\r")
    assert sorted(map(tuple, delimited.read_delimited(spark, str(tmp_path / "c.csv")).collect())) == [("1", "2"), ("3", "4")]


def test_quoted_breaks_over_many_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(7)
    rows = [[str(i), rng.choice(["plain", 'say "hi"', "line\nbreak", "a,b", "\n" * 5 + '"' * 4, "x" * 300])] for i in range(3000)]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "v"], *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = delimited.read_delimited(spark, str(tmp_path / "t.csv"), ",")
        assert delimited.text_records(spark, str(tmp_path / "t.csv")).select("block").distinct().count() > 3
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_very_wide_and_very_long_records(spark, tmp_path):
    cells = [f"c{i}" for i in range(100_000)]
    line = ",".join(f'"{c}"' for c in cells)
    df = spark.createDataFrame([(line,), ('"' + 'x""' * 47_000 + '"',)], "v string").select(delimited.parse_cells(F.col("v"), ",").alias("c"))
    wide, long = sorted((r["c"] for r in df.collect()), key=len, reverse=True)
    assert wide == cells and long == ['x"' * 47_000]
