import base64
import hashlib
import io
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.llm.queries import QUERIES
from quillon.llm.zipwarc import BadPackage, Package, PackageWriter, digest, directory, index_key, make_record, parse_record

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("wide", [False, True])
def test_package_round_trip(wide):
    f = io.BytesIO()
    w = PackageWriter(f, wide)
    blocks = [b"", b"\r\n\r\n", b"x" * 100_000, "é☃".encode(), b"PK\x05\x06" * 5]
    for i, b in enumerate(blocks):
        w.add("response", f"urn:page:{i}", [("A", "b\r\nc")], b, {"page": i}, f"key{i}")
    w.close()
    assert zipfile.ZipFile(f).testzip() is None
    package = Package(f, len(f.getvalue()))
    lines = list(package.index())
    assert [package.record(x["offset"], x["length"])[1] for x in lines] == blocks
    assert package.record(lines[2]["offset"], lines[2]["length"])[0]["a"] == "b c"


def test_directories_of_another_writer():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"data")
        z.writestr("deflated", b"d" * 100, zipfile.ZIP_DEFLATED)
    found = {m.name: m for m in directory(f, len(f.getvalue()))}
    assert found["big"].size == 4 and found["deflated"].method == 8


@pytest.mark.parametrize("data", [b"", b"PK", b"x" * 100, b"PK\x05\x06" + b"\x00" * 10])
def test_damage_is_refused(data):
    with pytest.raises(BadPackage):
        directory(io.BytesIO(data), len(data))


def test_damaged_record():
    with pytest.raises(BadPackage):
        parse_record(b"no record")
    import gzip

    whole = gzip.decompress(make_record("response", "n", [], b"payload"))
    with pytest.raises(BadPackage):
        parse_record(whole[:-3])


def brute(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None and (top[digest(h)] is None or i > top[digest(h)]):
            top[digest(h)] = i
    out = []
    for i, _, h in rows:
        first = top[digest(h)]
        again = i != first and len((h or "").encode()) >= least
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first if again else None))
    return out


ROWS = [(1, "u", "same"), (2, "u", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é☃" * 5000), (6, "u", "lone"), (6, "u", "other"), (7, "u", "x" * 3_000_000)]


def test_query_against_brute_force(spark, tables):
    d = tables("pages", ROWS, PAGES)
    out = QUERIES["op8_zip_warc"](spark, d).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, brute(ROWS)))


def test_null_ids_repeats_and_payloads(spark, tables):
    rows = [*ROWS, (None, "u", "same"), (9, "u", "same")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1))
    payload = F.coalesce(F.encode("html", "UTF-8"), F.to_binary(F.lit(""), F.lit("hex")))
    out = warc.read_packages(spark, *warc.write_packages(pages, "page_id", payload, F.col("url"))).collect()
    assert len(out) == len(rows)
    assert sum(r["type"] == "response" and r["page_id"] == 9 for r in out) == 2
    assert {r["refers_to"] for r in out if r["page_id"] in (None, 1, 2)} == {9}
    assert sorted(bytes(r["payload"]) for r in out if r["type"] == "response") == sorted([b"same", b"same", b"", "é☃".encode() * 5000, b"lone", b"other", b"x" * 3_000_000])


def test_short_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.to_binary(F.lit(""), F.lit("hex")))
    out = warc.read_packages(spark, *warc.write_packages(pages, "page_id", payload, F.col("url"), least=5)).collect()
    assert {r["type"] for r in out} == {"response"}


def test_records_are_whole_and_name_their_urls(spark):
    rows = [("a b>", "http://www.Example.org:80/x?q=1#f", "same"), ("é", None, "same"), ("None", "https://u@example.org:8080", "same"), (None, "http://n.org/a", "lone")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder, manifest = warc.write_packages(pages, "page_id", F.encode("html", "UTF-8"), F.col("url"))
    out = {r["page_id"]: r for r in warc.read_packages(spark, folder, manifest, "string").collect()}
    assert {k: (r["type"], r["refers_to"]) for k, r in out.items()} == {"a b>": ("revisit", "é"), "é": ("response", None), "None": ("revisit", "é"), None: ("response", None)}
    assert {k: r["url"] for k, r in out.items()} == {"a b>": rows[0][1], "é": "urn:page:%C3%A9", "None": rows[2][1], None: rows[3][1]}
    store, at = warc._store(folder)
    for name in [r["name"] for r in manifest.collect()]:
        with store.open_input_file(f"{at}/{name}") as f:
            package = Package(f, f.size())
            lines = list(package.index())
            assert [index_key(x["url"]) for x in lines] == sorted(index_key(x["url"]) for x in lines)
            for line in lines:
                headers, block = package.record(line["offset"], line["length"])
                head, _, body = block.partition(b"\r\n\r\n")
                assert head.startswith(b"HTTP/1.1 200 OK\r\n") and headers["content-type"].startswith("application/http")
                assert headers["warc-block-digest"] == f"sha1:{digest(block)}" and headers["warc-target-uri"] == line["url"]
                if line["type"] == "response":
                    assert headers["warc-payload-digest"] == f"sha1:{digest(body)}" and f"Content-Length: {len(body)}".encode() in head
                else:
                    assert not body and headers["warc-refers-to"] == "<urn:page:%C3%A9>" and headers["warc-refers-to-target-uri"] == "urn:page:%C3%A9"


def test_index_keys():
    assert index_key("http://www.Example.org:80/x?q=1#f") == "org,example)/x?q=1"
    assert index_key("https://u@a.example.org:8080") == "org,example,a:8080)/"
    assert index_key("urn:page:7") == "urn:page:7"
