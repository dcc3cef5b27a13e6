from __future__ import annotations

import glob
import gzip
import hashlib
import re

import __spark_entry__ as entry
from oracle import compare, connect
from wiretally.llm import warc

SF = "/root/testdata/sf0.001"


def parse(data: bytes):
    """Records of a WARC file as (headers, block), by its lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        block = data[start : start + size]
        assert data[start + size : start + size + 4] == b"\r\n\r\n"
        at = start + size + 4
        yield headers, block


def test_against_sql(spark):
    got = entry.queries()["op6_warc_derivatives"](spark, SF).toArrow()
    assert compare(got, connect(SF).execute(entry.oracle_sql()["op6_warc_derivatives"]).to_arrow_table()) is None


def test_files_hold_whole_linked_records(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    responses = warc.responses(pages)
    records = warc.derive(responses)
    path = str(tmp_path / "out")
    warc.write(records, path)
    found = [r for f in glob.glob(f"{path}/*.gz") for r in parse(gzip.open(f).read())]
    assert len(found) == 2 * pages.count()
    known = {r.record_id: r for r in responses.collect()}
    for headers, block in found:
        source = known[headers["WARC-Refers-To"][1:-1]]
        assert headers["WARC-Target-URI"] == source.target_uri
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        if headers["WARC-Type"] == "conversion":
            assert not re.search(rb"<(p|div|script|a)\b", block)
        else:
            assert b"source-header: Content-Type: text/html" in block
    assert len({h["WARC-Record-ID"] for h, _ in found}) == len(found)


def test_odd_rows(spark):
    html = "<html lang=de><head><title> A &amp;\n B </title></head><body><p>x &lt;b&gt; <script>var a='<p>';</script>y<br>z<!-- c --></p><a href='/l'>l</a></body>"
    rows = [(1, "http://a", html, "x"), (2, None, None, "x"), (3, "", "", "x"), (None, "u", "a" * 300_000, "x"), (1, "http://a", html, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 10
    first = [r for r in got if r.page_id == 1]
    assert {r.block for r in first if r.record_type == "conversion"} == {"x <b> y\nz\nl"}
    assert {(r.title, r.language, r.n_links) for r in first} == {("A & B", "de", 1)}
    assert all(r.block == "" for r in got if r.page_id in (2, 3) and r.record_type == "conversion")
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []
