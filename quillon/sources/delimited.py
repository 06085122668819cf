"""Delimited text read and written the spreadsheet way.

Every cell is a string. Headers are made unique by the first free suffix; a table is as wide as its widest record, extra
columns are `Unnamed: <index>`, short records are filled with empty cells; blank lines are skipped. Records are parsed in
parallel, by lines, and lines of one quoted cell are put together again."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.textx import delimited_cell
from ..operators.ranking import first_free_names
from ..session import staged

DELIMITERS = [",", ";", "\t", "|"]
#: Integers: digits with or without a minus need neither quotes nor a guard.
INTEGERS = ["byte", "short", "integer", "long"]
SAMPLE_RECORDS = 50
SAMPLE_CHARS = 1 << 20
#: Different headers, at most, of the files of one table.
MOST_HEADERS = 1000
BOM = "\ufeff"


def records(text: str, delimiter: str) -> list[list[str]]:
    """Records of a text; blank lines are none."""
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and r != [""]]


def detect_delimiter(sample: str, own: str = ",") -> str:
    """The own delimiter if it gives a consistent table of two or more columns, else the one that gives the widest."""

    def width(d: str) -> int:
        sizes = {len(r) for r in records(sample, d)[:SAMPLE_RECORDS]}
        return sizes.pop() if len(sizes) == 1 else 0

    if width(own) >= 2:
        return own
    best = max(DELIMITERS, key=lambda d: (width(d), -DELIMITERS.index(d)))
    return best if width(best) >= 2 else own


def guess_line_break(sample: str) -> str:
    """CRLF, LF or CR, whichever is most frequent outside quotes in the first megabyte."""
    bare = "".join(sample[:SAMPLE_CHARS].split('"')[::2])
    crlf = bare.count("\r\n")
    counts = {"\r\n": crlf, "\n": bare.count("\n") - crlf, "\r": bare.count("\r") - crlf}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else "\n"


def line_break_of(text: Column) -> Column:
    """The same of a column, as a name: crlf, lf, cr, or none where the text has no break outside quotes."""
    pieces = F.split(F.substring(text, 1, SAMPLE_CHARS), '"', -1)
    bare = F.array_join(F.filter(pieces, lambda _, i: i % 2 == 0), "")
    times = lambda s: F.char_length(bare) - F.char_length(F.replace(bare, F.lit(s), F.lit("")))
    crlf = (times("\r\n") / 2).cast("int")
    ranked = F.array(F.struct(crlf.alias("n"), F.lit(3).alias("o"), F.lit("crlf").alias("k")), F.struct((times("\n") - crlf).alias("n"), F.lit(2).alias("o"), F.lit("lf").alias("k")), F.struct((times("\r") - crlf).alias("n"), F.lit(1).alias("o"), F.lit("cr").alias("k")))
    best = F.array_max(ranked)
    return F.when(best.n > 0, best.k).otherwise(F.lit("none"))


def table_of(rows: list[list[str]]) -> tuple[list[str], list[list[str]], int]:
    """(names, rows, ragged): the table of parsed records, its first one the header, evened out."""
    if not rows:
        return [], [], 0
    width = max(map(len, rows))
    head = rows[0] + [f"Unnamed: {i}" for i in range(len(rows[0]), width)]
    ragged = sum(len(r) != len(rows[0]) for r in rows[1:])
    return first_free_names(head), [r + [""] * (width - len(r)) for r in rows[1:]], ragged


def text_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", line_break: str = "\n") -> DataFrame:
    """(file, block, line, record): the records of delimited files, blank ones left out, in the order of block and line
    within a file. Lines are read in parallel; a line belongs to the record before it if an odd number of quotes stands
    between them in the file, which is counted by split first. Only the lines of records that have several are exchanged."""
    read = spark.read.option("lineSep", line_break).option("encoding", encoding) if line_break != "\n" or encoding != "UTF-8" else spark.read.option("lineSep", "\n")
    lines = read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    odd = (F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    lines = lines.withColumn("odd", odd)
    end = lambda c: F.regexp_replace(c, "\r$", "")
    if lines.where("odd = 1").isEmpty():
        records = lines.select("file", "block", "line", end(F.col("value")).alias("record"))
    else:
        splits = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.select("file", "block", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)).alias("inside"))
        order = Window.partitionBy("file", "block").orderBy("line")
        lines = lines.join(splits, ["file", "block"]).withColumn("after", (F.sum("odd").over(order) + F.col("inside")) % 2)
        lines = staged(lines.withColumn("before", (F.col("after") + F.col("odd")) % 2), "lines")
        whole = lines.where("before = 0 AND after = 0").select("file", "block", "line", F.col("value").alias("record"))
        # a line that opens a record is the key of all up to the one that closes it, in its split or a later one
        part = lines.where("before = 1 OR after = 1").withColumn("opens", F.when(F.col("before") == 0, F.struct("block", "line")))
        run = Window.partitionBy("file").orderBy("block", "line").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("key", F.last("opens", ignorenulls=True).over(run))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x.value), line_break)
        part = part.groupBy("file", "key").agg(joined.alias("record")).select("file", "key.block", "key.line", "record")
        records = whole.unionByName(part).withColumn("record", end(F.col("record")))
    return records.where(F.col("record") != "")


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str | None = None, encoding: str = "UTF-8", line_break: str | None = None) -> DataFrame:
    """A table of strings. Every file's first record is its header, by which its columns are bound; the table's columns are
    those of all headers, in the order of the files' names. A first pass finds headers and widths, a second one reads."""
    sample = [r[0] for r in spark.read.option("encoding", encoding).text(path).limit(SAMPLE_RECORDS).collect()]
    if line_break is None:
        # the default reader ends lines at any break, so a file of CR alone shows in lines that hold none
        line_break = "\r" if guess_line_break(_head(spark, path, encoding)) == "\r" else "\n"
    sample = [x for x in sample if x]
    if not sample:
        return spark.createDataFrame([], "value string").drop("value")
    delimiter = delimiter or detect_delimiter("\n".join(sample).removeprefix(BOM))
    rows = text_records(spark, path, encoding, line_break)
    rows = rows.select("file", "block", "line", parse_cells(F.col("record"), delimiter).alias("c"))
    files = rows.groupBy("file").agg(F.min(F.struct("block", "line", "c")).alias("head"), F.max(F.size("c")).alias("width"))
    # a header for each file; files of one header and width are read alike
    heads = files.groupBy("head.c", "width").agg(F.min("file").alias("first")).orderBy("first").limit(MOST_HEADERS + 1).collect()
    if len(heads) > MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different headers")
    names = [table_of([[x.removeprefix(BOM) if i == 0 else x for i, x in enumerate(h["c"])], [""] * h["width"]])[0] for h in heads]
    columns = list(dict.fromkeys(n for x in names for n in x))
    body = rows.join(files.select("file", F.col("head.block").alias("hb"), F.col("head.line").alias("hl"), F.col("head.c").alias("hc"), "width"), "file")
    body = body.where((F.col("block") != F.col("hb")) | (F.col("line") != F.col("hl")))
    which = F.lit(0)
    for k, h in enumerate(heads[1:], 1):
        which = F.when((F.col("hc") == F.array(*map(F.lit, h["c"]))) & (F.col("width") == h["width"]), k).otherwise(which)
    body = body.withColumn("which", which) if len(heads) > 1 else body

    def cell(name: str) -> Column:
        found = F.lit("")
        for k, x in enumerate(names):
            if name in x:
                value = F.coalesce(F.get("c", F.lit(x.index(name))), F.lit(""))
                found = value if len(names) == 1 else F.when(F.col("which") == k, value).otherwise(found)
        return found

    return body.select(*[cell(n).alias(n) for n in columns])


def _head(spark: SparkSession, path: str | list[str], encoding: str) -> str:
    """The first bytes of one file, decoded."""
    first = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").where("length > 0").limit(1)
    name = [r[0] for r in first.collect()]
    if not name:
        return ""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(name[0])
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SAMPLE_CHARS))).decode(encoding, errors="replace")
    finally:
        stream.close()


#: Two characters of the private plane stand for delimiters between cells and for themselves, while a record is cut.
MARK, CUT = "\U0010fffd", "\U0010fffc"


def parse_cells(record: Column, delimiter: str) -> Column:
    """The cells of one record: quoted ones may hold delimiters, line breaks and doubled quotes. The text is cut at quotes,
    every second piece lies between quotes, and the delimiters of the others end cells: one pass each of literal searches,
    linear in the record and without a pattern that could go deep. A record without quotes is cut at its delimiters."""
    safe = F.replace(F.replace(record, F.lit(MARK), F.lit(MARK + "m")), F.lit(CUT), F.lit(MARK + "c"))
    pieces = F.transform(F.split(safe, '"', -1), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(delimiter), F.lit(CUT))).otherwise(p))
    cells = F.split(F.array_join(pieces, '"'), CUT, -1)
    plain = lambda c: F.replace(F.replace(c, F.lit(MARK + "c"), F.lit(CUT)), F.lit(MARK + "m"), F.lit(MARK))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))
    bare = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.char_length(c) > 1), inner(c)).otherwise(c)
    quoted = F.transform(cells, lambda c: plain(bare(c)))
    return F.when(~record.contains('"'), F.split(record, re.escape(delimiter), -1)).otherwise(quoted)


def read_whole(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, ordinal, cells) of files with quoted line breaks: each file is one record of the scan and is parsed whole."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = records(bytes(content).decode("utf-8-sig"), delimiter)
                yield pd.DataFrame({"path": p, "ordinal": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, ordinal long, cells array<string>")


def format_lines(df: DataFrame, delimiter: str = ",", escape_formulas: bool = True) -> DataFrame:
    """(value): the lines of a delimited file of df."""
    lone = len(df.columns) == 1
    # cast once, below the patterns that look at each cell
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = [F.coalesce(F.col(f"c{i}"), F.lit('""' if lone else "")) if f.dataType.typeName() in INTEGERS and delimiter in DELIMITERS else delimited_cell(F.col(f"c{i}"), delimiter, escape_formulas, lone) for i, f in enumerate(df.schema.fields)]
    return texts.select(F.concat_ws(delimiter, *cells).alias("value"))


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", escape_formulas: bool = True, names: list[str] | None = None) -> None:
    """Formatted lines as text files, with CRLF after each record. With names, each file begins with them as its header."""
    lines = format_lines(df, delimiter, escape_formulas)
    if names is not None:
        head = format_lines(df.sparkSession.createDataFrame([names], ", ".join(f"c{i} string" for i in range(len(names)))), delimiter, False).collect()[0][0]
        # the ids of a partition's rows count from 0 in their lower bits, so its first row is known
        first = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(head + "\r\n"), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.option("lineSep", "\r\n").text(path)


def jsonl_to_delimited(df: DataFrame, text: str, names: list[str], delimiter: str = ",") -> DataFrame:
    """(value): flat JSON records bound to columns by name; absent keys are empty cells."""
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = df.select(F.from_json(text, schema).alias("r")).select(*[F.col(f"r.`{n}`").alias(n) for n in names])
    return format_lines(parsed, delimiter)
