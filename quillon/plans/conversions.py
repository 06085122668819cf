"""Conversions between whole formats: normalised values, YAML, workbooks to other formats and back, windows of rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.normal import normalised, value_count
from ..operators import sheets
from ..operators.ranking import placed
from ..session import scratch, table
from ..sources import documents, workbooks, yamltext
from .registry import Registry

registry = Registry()
add = registry.add


def _normalised(s, d):
    e = table(s, d, "events")
    one = F.struct("event_id", "ts", F.to_date("ts").alias("day"), F.array(F.struct("value", F.create_map("user_id", "event_type").alias("by"))).alias("parts"))
    e = e.select("event_id", one.alias("v"))
    kind = e.schema["v"].dataType
    return e.select("event_id", F.to_json(normalised(F.col("v"), kind).dropFields("parts")).alias("j"), F.to_json(normalised(F.col("v"), kind).parts[0].by).alias("m"), value_count(F.col("v"), kind).alias("n"))


_ISO = "%Y-%m-%dT%H:%M:%S.%gZ"
add(
    "a10_value_normalisation",
    _normalised,
    f"""SELECT event_id, '{{"event_id":' || event_id || ',"ts":"' || strftime(ts, '{_ISO}') || '","day":"' || strftime(ts, '%Y-%m-%dT00:00:00.000Z') || '"}}' AS j,
         '{{"' || user_id || '":"' || event_type || '"}}' AS m, 9::BIGINT AS n FROM events""",
)


def _yaml_scan(s, d):
    """Files of one list each, an entry a nation, with comments, flow values, quotes, blocks, an anchor and an alias."""
    path = scratch(s, "yaml")
    entry = F.concat(
        F.lit("# an entry\n- name: "), "n_name", F.lit(" # its name\n  key: "), "n_nationkey", F.lit("\n  'more of it': {region: "), "n_regionkey",
        F.lit(", tags: [a, \"b: c\", 'it''s']}\n  note: |\n    first #1\n      second\n  base: &b"), "n_nationkey", F.lit("\n  - 0x1F\n  - ~\n  again: *b"), "n_nationkey",
    )
    table(s, d, "nation").select(entry.alias("value")).repartition(3).write.text(path)
    rows = yamltext.read_yaml(s, path)
    kind = "array<struct<name: string, key: int, `more of it`: struct<region: int, tags: array<string>>, note: string, again: array<int>>>"
    r = rows.select(F.explode(F.from_json("json", kind)).alias("r"))
    return r.select("r.name", "r.key", F.col("r.`more of it`.region").alias("region"), F.array_join("r.`more of it`.tags", "|").alias("tags"), "r.note", F.element_at("r.again", 1).alias("hex"))


add(
    "a24_yaml_scan",
    _yaml_scan,
    """SELECT n_name AS name, n_nationkey AS key, n_regionkey AS region, 'a|b: c|it''s' AS tags, 'first #1' || chr(10) || '  second' || chr(10) AS note, 31 AS hex FROM nation""",
)
add(
    "a24_yaml_sink",
    lambda s, d: table(s, d, "nation").select("n_nationkey", documents.map_text(F.to_json(F.struct(F.struct("n_name", F.array("n_regionkey", F.lit(7)).alias("list")).alias("nation"), F.lit("yes: no").alias("odd"), F.lit("007").alias("digits"))), yamltext.json_yaml).alias("text")),
    """SELECT n_nationkey, 'nation:' || chr(10) || '  n_name: ' || n_name || chr(10) || '  list:' || chr(10) || '    - ' || n_regionkey || chr(10) || '    - 7' || chr(10)
         || 'odd: "yes: no"' || chr(10) || 'digits: "007"' || chr(10) AS text FROM nation""",
)


def _books(s, d):
    """Rows of the workbooks of all regions, written and read as files: a sheet of nations, and one of a total."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_nationkey")
        names = [["key", "a, name"], *[[int(k), n] for k, n in zip(pdf["n_nationkey"], pdf["n_name"], strict=True)]]
        return pd.DataFrame({"book": [int(pdf["n_regionkey"].iloc[0])], "data": [documents.xlsx_bytes({"names": names, "total": [["n", "<odd>"], [len(pdf), True]]})]})

    def rows(batches):
        for pdf in batches:
            for book, data in zip(pdf["book"], pdf["data"], strict=True):
                found = documents.xlsx_rows(bytes(data))
                places = {n: i for i, n in enumerate(dict.fromkeys(f[0] for f in found))}
                yield pd.DataFrame({"book": book, "ordinal": [places[f[0]] for f in found], "sheet": [f[0] for f in found], "row": [f[1] for f in found], "cells": [f[2] for f in found]})

    books = table(s, d, "nation").groupBy("n_regionkey").applyInPandas(pack, "book int, data binary")
    return books.mapInPandas(rows, "book int, ordinal int, sheet string, row long, cells array<string>")


_LINES = "SELECT n_regionkey AS book, string_agg({0}, {1} ORDER BY n_nationkey) AS t, count(*) AS n FROM nation GROUP BY n_regionkey"
for _form, _mark, _head in (("csv", ",", '"a, name"'), ("tsv", "\t", "a, name")):
    add(
        f"a29_workbook_{_form}",
        lambda s, d, form=_form: workbooks.convert(_books(s, d), form),
        f"""WITH x AS ({_LINES.format(f"n_nationkey || '{_mark}' || n_name", "chr(10)")}), l AS (SELECT chr(10) AS e)
            SELECT book, '### Sheet: names' || e || 'key{_mark}{_head}' || e || t || e || e || '### Sheet: total' || e || 'n{_mark}<odd>' || e || n || '{_mark}TRUE' AS text FROM x, l""",
    )
    add(
        f"a29_first_sheet_{_form}",
        lambda s, d, form=_form: workbooks.convert(sheets.select_sheets(_books(s, d), "index", 0), form),
        f"""SELECT book, 'key{_mark}{_head}' || chr(10) || t AS text FROM ({_LINES.format(f"n_nationkey || '{_mark}' || n_name", "chr(10)")})""",
    )
add(
    "a29_workbook_json",
    lambda s, d: workbooks.convert(_books(s, d), "json"),
    """WITH x AS ("""
    + _LINES.format("""'    {' || chr(10) || '      "key": "' || n_nationkey || '",' || chr(10) || '      "a, name": "' || n_name || '"' || chr(10) || '    }'""", "',' || chr(10)")
    + """), l AS (SELECT chr(10) AS e)
       SELECT book, '{' || e || '  "names": [' || e || t || e || '  ],' || e || '  "total": [' || e || '    {' || e || '      "n": "' || n || '",' || e || '      "<odd>": "TRUE"' || e || '    }' || e || '  ]' || e || '}' AS text FROM x, l""",
)
add(
    "a29_workbook_xml",
    lambda s, d: workbooks.convert(_books(s, d), "xml"),
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
       x AS (SELECT n_regionkey AS book, string_agg('<row id="' || i || '"><key>' || n_nationkey || '</key><a__name>' || n_name || '</a__name></row>', '' ORDER BY i) AS t, count(*) AS n FROM r GROUP BY n_regionkey)
       SELECT book, '<workbook><worksheet name="names"><rows>' || t || '</rows></worksheet><worksheet name="total"><rows><row id="1"><n>' || n || '</n><_odd_>TRUE</_odd_></row></rows></worksheet></workbook>' AS text FROM x""",
)
add(
    "a29_workbook_html",
    lambda s, d: workbooks.convert(_books(s, d), "html"),
    f"""WITH x AS ({_LINES.format("'<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>'", "''")})
        SELECT book, '<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><h3>names</h3><table><tr><th>key</th><th>a, name</th></tr>' || t
          || '</table><h3>total</h3><table><tr><th>n</th><th>&lt;odd&gt;</th></tr><tr><td>' || n || '</td><td>TRUE</td></tr></table></body></html>' AS text FROM x""",
)


def _typed(write, read):
    """Texts of customers, put into workbooks in the kinds that they spell out, a book for each nation, and read back."""

    def run(s, d):
        def trip(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = [[workbooks.detect(c) for c in r] for r in pdf[["key", "phone", "balance", "rich"]].itertuples(index=False)]
            back = read(write({"customers": cells}))
            return pd.DataFrame([[b[2][0], b[2][1], b[2][2], b[2][3], ",".join(type(c).__name__ for c in r)] for b, r in zip(back, cells, strict=True)], columns=["key", "phone", "balance", "rich", "kinds"])

        c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("00"), F.col("c_custkey").cast("string")).alias("phone"), F.concat(F.col("c_custkey").cast("string"), F.lit(".5")).alias("balance"), F.upper((F.col("c_custkey") % 2 == 0).cast("string")).alias("rich"), "c_nationkey")
        return c.groupBy("c_nationkey").applyInPandas(trip, "key string, phone string, balance string, rich string, kinds string")

    return run


_TYPED = "SELECT c_custkey::VARCHAR AS key, '00' || c_custkey AS phone, c_custkey || '.5' AS balance, upper((c_custkey % 2 = 0)::VARCHAR) AS rich, 'int,str,float,bool' AS kinds FROM customer"
add("a31_xlsx_sink", _typed(documents.xlsx_bytes, documents.xlsx_rows), _TYPED)
add("a31_ods_sink", _typed(workbooks.ods_bytes, workbooks.ods_rows), _TYPED)


def _row_windows(s, d):
    rows = placed(table(s, d, "customer").select("c_custkey"), [F.col("c_custkey").asc()], "place")
    rows = rows.withColumn("window", F.expr("(place - 1) div 32"))
    return rows.groupBy("window").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda k: k.cast("string")), "\n").alias("text"))


add(
    "f08_row_windows",
    _row_windows,
    """WITH x AS (SELECT c_custkey AS k, (row_number() OVER (ORDER BY c_custkey) - 1) // 32 AS "window" FROM customer)
       SELECT "window", count(*) AS n, string_agg(k::VARCHAR, chr(10) ORDER BY k) AS text FROM x GROUP BY "window" """,
)
