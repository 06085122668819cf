"""Scans and sinks: delimited text, JSON, Parquet, XML, TOML, workbooks, encodings, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.textx import slug
from ..session import scratch, table
from ..sources import delimited, documents
from ..streaming import state
from .registry import Registry


def _prepare() -> None:
    """Columns that several queries use."""
    global _XML
    _XML = F.concat(F.lit('<row id="'), "n_nationkey", F.lit('"><name>'), "n_name", F.lit("</name><r>"), "n_regionkey", F.lit("</r></row>"))


registry = Registry(_prepare)
add = registry.add


def _people(s, d):
    """Customers with quotes, delimiters and line breaks in their cells."""
    odd = F.when(F.col("c_custkey") % 3 == 0, F.lit('two\nlines "q"')).otherwise("")
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit('"'), "c_name", F.lit('", "x"')).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("-a")).otherwise("plain").alias("note"), odd.alias("memo"))


_PEOPLE = """SELECT c_custkey::VARCHAR AS key, '"' || c_name || '", "x"' AS name, CASE WHEN c_custkey % 2 = 0 THEN '-a' ELSE 'plain' END AS note,
  CASE WHEN c_custkey % 3 = 0 THEN 'two' || chr(10) || 'lines "q"' ELSE '' END AS memo FROM customer"""


def _scan(s, d):
    path = scratch(s, "csv")
    people = _people(s, d).repartition(3, "key")
    delimited.write_delimited(people.where("key % 2 = 0"), path + "/a", escape_formulas=False, names=["key", "name", "note", "memo"])
    swapped = ["memo", "note", "name", "key"]
    delimited.write_delimited(people.where("key % 2 = 1").select(*swapped), path + "/b", escape_formulas=False, names=swapped)
    return delimited.read_delimited(s, [path + "/a", path + "/b"])


add("a01_delimited_scan", _scan, _PEOPLE)


def _detect(s, d):
    out = None
    for name, mark in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("bar", "|")):
        path = scratch(s, "marks")
        delimited.write_delimited(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), path, mark, names=["k", "n_name"])
        found = delimited.read_delimited(s, path).select(F.lit(name).alias("delimiter"), "k", "n_name")
        out = found if out is None else out.unionByName(found)
    return out


add("a02_delimiter_detection", _detect, "SELECT unnest(['comma', 'semicolon', 'tab', 'bar']) AS delimiter, n_nationkey::VARCHAR AS k, n_name FROM nation")
# CRLF, LF and CR in turn, with breaks of another kind inside quotes, which don't count
_MIXED = """CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN text ELSE replace(text, chr(10), chr(13)) END || '"' || repeat(chr(10), 99) || '"'"""
_TIMES = "(length(b) - length(replace(b, {0}, '')))"


def _breaks(s, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    return table(s, d, "documents").select("doc_id", delimited.line_break_of(F.concat(text, F.lit('"' + "\n" * 99 + '"'))).alias("break"))


add(
    "a03_line_breaks",
    _breaks,
    f"""WITH t AS (SELECT doc_id, {_MIXED} AS t FROM documents), q AS (SELECT doc_id, array_to_string(string_split(substr(t, 1, 1048576), '"')[1:-1:2], '') AS b FROM t),
        c AS (SELECT doc_id, {_TIMES.format("chr(13) || chr(10)")} // 2 AS crlf, {_TIMES.format("chr(10)")} AS lf, {_TIMES.format("chr(13)")} AS cr FROM q)
        SELECT doc_id, CASE WHEN greatest(crlf, lf - crlf, cr - crlf) = 0 THEN 'none' WHEN crlf >= greatest(lf - crlf, cr - crlf) THEN 'crlf' WHEN lf - crlf >= cr - crlf THEN 'lf' ELSE 'cr' END AS "break" FROM c""",
)


def _file_round_trip(s, d):
    """A table under a header of repeated names, one too few, and a record that equals the header."""
    path = scratch(s, "csv")
    people = _people(s, d).select("key", "note", "name").unionByName(s.createDataFrame([("key", "note", "note")], "key string, note string, name string"))
    lines = delimited.format_lines(people.coalesce(1).withColumn("more", F.lit("z")), escape_formulas=False)
    s.createDataFrame([("key,note,note",)], "value string").unionByName(lines).coalesce(1).write.text(path)
    return delimited.read_delimited(s, path)


add("a04_header_and_width", _file_round_trip, f"""SELECT key, note, name AS note_1, 'z' AS "Unnamed: 3" FROM ({_PEOPLE}) UNION ALL SELECT 'key', 'note', 'note', 'z'""")


def _ragged(s, d):
    x = table(s, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("c"))
    width = x.agg(F.max(F.size("c")).alias("w"))
    return x.join(width, how="cross").select("conv_id", "turn", F.size("c").cast("long").alias("own"), F.size(F.concat("c", F.array_repeat(F.lit(""), F.col("w") - F.size("c")))).cast("long").alias("even"))  # width is one row


add(
    "a05_ragged_widening",
    _ragged,
    "WITH x AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS own FROM conversations) SELECT conv_id, turn, own, max(own) OVER () AS even FROM x",
)
add(
    "a06_sheet_rows",
    lambda s, d: table(s, d, "nation").select("n_nationkey", delimited.parse_cells(F.concat_ws(",", "n_name", F.lit('"a,b"'), "n_regionkey"), ",").alias("cells")),
    "SELECT n_nationkey, [n_name, 'a,b', n_regionkey::VARCHAR] AS cells FROM nation",
)


def _encodings(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    data = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-16LE"))

    def run(x: pd.Series) -> pd.Series:
        return x.map(documents.decode)

    return t.select("doc_id", F.md5(F.pandas_udf(run, "string")(data)).alias("text_md5"))


add("a07_encoding_detection", _encodings, "SELECT doc_id, md5(text) AS text_md5 FROM documents")
add(
    "a08_json_scan",
    lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(F.parse_json(F.concat(F.lit('{"big":12345678901234567890,"e":'), "props", F.lit("}"))), "$.big", "decimal(38,0)").cast("string").alias("big"), F.variant_get(F.parse_json("props"), "$.k", "int").alias("k")),
    "SELECT event_id, '12345678901234567890' AS big, CAST(json_extract(props, '$.k') AS INT) AS k FROM events",
)
add(
    "a09_json_sink",
    lambda s, d: table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"}).alias("line")),
    """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS line FROM nation""",
)
add(
    "a11_jsonl_to_delimited",
    lambda s, d: delimited.jsonl_to_delimited(table(s, d, "events").select(F.to_json(F.struct("event_id", "event_type", "user_id")).alias("j")), "j", ["event_type", "absent", "event_id"]),
    "SELECT event_type || ',,' || event_id AS value FROM events",
)
add(
    "a12_json_array_table",
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("j")).select("n_regionkey", F.inline(F.from_json("j", "array<struct<n_nationkey:int,n_name:string,extra:string>>"))),
    "SELECT n_regionkey, n_nationkey, n_name, NULL::VARCHAR AS extra FROM nation",
)


def _parquet(codec, **options):
    def run(s, d):
        path = scratch(s, "parquet")
        nested = table(s, d, "part").select("p_partkey", F.struct("p_name", F.array("p_brand", "p_type").alias("tags")).alias("n"), F.create_map(F.lit("size"), "p_size").alias("m"))
        nested.write.options(compression=codec, **options).parquet(path)
        return s.read.parquet(path).select("p_partkey", "n.p_name", F.element_at("n.tags", 2).alias("p_type"), F.element_at("m", F.lit("size")).alias("p_size"))

    return run


_PART = "SELECT p_partkey, p_name, p_type, p_size FROM part"
for _codec in ("none", "snappy", "gzip", "zstd", "lz4_raw"):
    add(f"a17_parquet_{_codec}", _parquet(_codec), _PART)
add("a21_parquet_pages", _parquet("zstd", **{"parquet.block.size": str(128 << 20), "parquet.page.size": str(1 << 20), "parquet.dictionary.page.size": str(1 << 20)}), _PART)


def _csv_parquet(s, d):
    a, b = scratch(s, "lines"), scratch(s, "strings")
    delimited.write_delimited(_people(s, d), a, escape_formulas=False, names=["key", "name", "note", "memo"])
    delimited.read_delimited(s, a).write.parquet(b)
    return s.read.parquet(b)


add("a18_delimited_to_parquet", _csv_parquet, _PEOPLE)
add(
    "a19_parquet_to_delimited",
    lambda s, d: delimited.format_lines(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "\t"),
    "SELECT o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority AS value FROM orders",
)
add(
    "a20_parquet_to_json",
    lambda s, d: table(s, d, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("line")),
    """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS line FROM supplier""",
)
def _sink(s, d):
    path = scratch(s, "sink")
    delimited.write_delimited(_people(s, d).drop("memo"), path)
    return s.read.option("lineSep", "\r\n").text(path)


add(
    "a22_delimited_sink",
    _sink,
    """SELECT c_custkey || ',"' || replace('"' || c_name || '", "x"', '"', '""') || '",' || CASE WHEN c_custkey % 2 = 0 THEN '"''-a"' ELSE 'plain' END AS value FROM customer""",
)
add(
    "a23_toml",
    lambda s, d: table(s, d, "nation").select(documents.map_text(F.concat(F.lit('name = "'), "n_name", F.lit('"\n[meta]\nkey = '), "n_nationkey", F.lit("\ntags = [1, 2]\n")), documents.toml_json).alias("j")).select(F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.meta.key").cast("int").alias("key"), F.get_json_object("j", "$.meta.tags[1]").alias("tag")),
    "SELECT n_name AS name, n_nationkey AS key, '2' AS tag FROM nation",
)
add(
    "a25_xml_records",
    lambda s, d: table(s, d, "nation").select(F.from_xml(_XML, "_id INT, name STRING, r INT").alias("x")).select(F.col("x._id").alias("id"), "x.name", "x.r"),
    "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS r FROM nation",
)
add(
    "a26_jsonml",
    lambda s, d: table(s, d, "nation").select(documents.map_text(_XML, documents.xml_jsonml).alias("j")),
    """SELECT '{"$jsonml":["row",{"id":"' || n_nationkey || '"},["name",{},"' || n_name || '"],["r",{},"' || n_regionkey || '"]]}' AS j FROM nation""",
)
add(
    "a27_xml_paths",
    lambda s, d: table(s, d, "nation").select(F.xpath_string(_XML, F.lit("row/name")).alias("name"), F.xpath_int(_XML, F.lit("row/@id")).alias("id"), F.xpath_int(_XML, F.lit("count(row/*)")).alias("kids")),
    "SELECT n_name AS name, n_nationkey AS id, 2 AS kids FROM nation",
)


def _workbooks(s, d):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets = {"names": [[k, n] for k, n in zip(pdf["n_nationkey"].tolist(), pdf["n_name"], strict=True)], "size": [[len(pdf)]]}
        return pd.DataFrame({"region": [pdf["n_regionkey"].iloc[0]], "book": [documents.xlsx_bytes(sheets)]})

    def rows(batches):
        for pdf in batches:
            for region, book in zip(pdf["region"], pdf["book"], strict=True):
                found = documents.xlsx_rows(bytes(book))
                yield pd.DataFrame({"region": region, "sheet": [f[0] for f in found], "cells": ["|".join(f[2]) for f in found]})

    books = table(s, d, "nation").groupBy("n_regionkey").applyInPandas(pack, "region int, book binary")
    return books.mapInPandas(rows, "region int, sheet string, cells string")


add(
    "a28_workbooks",
    _workbooks,
    """SELECT n_regionkey AS region, 'names' AS sheet, n_nationkey || '|' || n_name AS cells FROM nation
       UNION ALL SELECT n_regionkey, 'size', count(*)::VARCHAR FROM nation GROUP BY n_regionkey""",
)
add(
    "a34_slugs",
    lambda s, d: table(s, d, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" & (v1.0)"))).alias("slug")),
    "SELECT p_partkey, replace(regexp_replace(lower(p_name || ' & (v1.0)'), '[^a-z0-9_ -]', '', 'g'), ' ', '-') AS slug FROM part",
)


def _subtitles(s, d):
    cue = F.concat(F.col("turn") + 1, F.lit("\n00:00:0"), F.col("turn") % 10, F.lit(",500 --> 00:01:00,000\n"), "role")
    files = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x.c), "\n\n").alias("srt"))
    return files.select("conv_id", F.inline(documents.subtitle_cues(F.col("srt"))))


add('a35_subtitles', _subtitles, """SELECT conv_id, (turn % 10) * 1000 + 500 AS start, 60000::BIGINT AS "end", role AS text FROM conversations""")
add(
    "a36_entry_globs",
    lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("data/"), F.col("p_size") % 3, F.lit("/"), "p_brand", F.lit(".csv")).alias("path")).select("p_partkey", F.col("path").rlike(documents.glob_regex("data/*/Brand#1?.csv")).alias("one"), F.col("path").rlike(documents.glob_regex("**/*.csv")).alias("deep"), F.col("path").rlike(documents.glob_regex("*.csv")).alias("flat")),
    "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#1.') AS one, true AS deep, false AS flat FROM part",
)
add(
    "a39_source_limits",
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("items")).withColumn("refused", (F.col("bytes") > 130_000) | (F.col("items") > 60)),
    "SELECT source, sum(strlen(text))::BIGINT AS bytes, count(*) AS items, sum(strlen(text)) > 130000 OR count(*) > 60 AS refused FROM documents GROUP BY source",
)
add(
    "a40_grid_limits",
    lambda s, d: table(s, d, "lineitem").agg(F.count("*").alias("rows")).select("rows", F.lit(11).alias("columns"), (F.col("rows") * 11).alias("cells"), (F.col("rows") > 1_048_576).alias("over")),
    "SELECT count(*) AS rows, 11 AS columns, count(*) * 11 AS cells, count(*) > 1048576 AS over FROM lineitem",
)
add(
    "a41_converter",
    lambda s, d: delimited.format_lines(table(s, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("j")).select(F.from_json("j", "r_regionkey string, r_name string").alias("r")).select("r.*"), "\t"),
    "SELECT r_regionkey || chr(9) || r_name AS value FROM region",
)


def _stream(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))


def _daily_stream(s, d):
    out = state.run_once(state.daily_counts(_stream(s, d)), "quillon_daily", scratch(s, "stream"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "total")


add("i02_stream_daily_counts", _daily_stream, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")


def _burn_stream(s, d):
    out = state.run_once(state.burn_windows(_stream(s, d)), "quillon_burn", scratch(s, "stream"))
    return out.select(F.col("w.start").alias("start"), "bad", "total")


add(
    "i05_stream_burn_windows",
    _burn_stream,
    """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, (event_type = 'error')::INT AS bad FROM events), x AS (SELECT h - to_hours(k::INT) AS start, bad FROM e, range(6) r(k))
       SELECT start, sum(bad)::BIGINT AS bad, count(*) AS total FROM x GROUP BY start""",
)


def _dedupe_stream(s, d):
    return state.run_once(state.first_only(_stream(s, d).select("event_id", "ts", "user_id"), ["event_id"], "40 days"), "quillon_dedupe", scratch(s, "stream"), "append").select("event_id", "user_id")


add("i11_stream_dedupe", _dedupe_stream, "SELECT event_id, user_id FROM events")


def _delimited_stream(s, d):
    folder = scratch(s, "tsv")
    delimited.write_delimited(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), folder, "\t")
    lines = s.readStream.option("lineSep", "\r\n").text(folder).select(delimited.parse_cells(F.col("value"), "\t").alias("c"))
    return state.run_once(lines.select(F.concat_ws(",", "c").alias("value")), "quillon_tsv", scratch(s, "stream"), "append")


add("i01_stream_delimited", _delimited_stream, "SELECT o_orderkey || ',' || o_orderstatus AS value FROM orders")
