from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

import __spark_entry__ as entry
from wiretally.llm import secrets

SF = "/root/testdata/sf0.01"


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op3_secret_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    assert any(r.n_assign for r in got)
    for r in got:
        base = brute_base(texts[r.doc_id] or "")
        joined = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert set(joined) <= set(r.spans.split(","))


def test_base_rules():
    for text in (
        "token=ab secret: 'abcdef'", "secret=token: abcdefgh", "API_KEY = \"a.b-c=d\" x", "toKen=abcdef paſsword=abcdef",
        "AKIAAKIA" + "A" * 12, "xAKIA" + "B" * 15, "f" * 23 + "g" + "0" * 24, "passwd" + " " * 3 + "=" + "x" * 6, "token:\tabcdefg",
    ):
        assert secrets.findings(text) == brute_base(text), text


def test_layers_map_back():
    plain = "password=hunter2hunter2"
    once = base64.b64encode(plain.encode()).decode()
    squeezed = base64.b64encode(gzip.compress(plain.encode(), mtime=0)).decode()
    deflated = base64.b64encode(zlib.compress(plain.encode() * 3)).decode()
    twice = base64.b64encode(once.encode()).decode()
    for inner in (once, squeezed, deflated, twice, base64.b64encode(urllib.parse.quote(squeezed).encode()).decode()):
        text = f"é before {inner} after"
        base, spans, layers, cuts = secrets.scan_text(text)
        start = text.index(inner)
        assert spans and layers >= 1 and not cuts and not base
        for s, kind, e in spans:
            assert kind == 0 and start <= s and e <= start + len(inner) and text[s:e].rstrip("=") == inner.rstrip("=")
        assert plain not in secrets.redact_text(text) and inner not in secrets.redact_text(text)
    for text in ("x p%61ssword%3Dabc%64efgh y", r"x password=abcdefgh y", "x &#112;assword&#x3d;abcdefgh y", r"x \x70assword=abcdefgh y"):
        _, spans, _, _ = secrets.scan_text(text)
        assert [(text[s:e], k) for s, k, e in spans] == [(text[2:-2], 0)], text


def test_cycles_end_and_large_layers_are_cut(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1000)
    text = base64.b64encode(zlib.compress(b"token=abcdefgh " * 1000)).decode()
    _, spans, _, cuts = secrets.scan_text(text)
    assert spans and cuts == 1
    assert secrets.inflate(b"x\x9cgarbage") == (b"x\x9cgarbage", False)
    assert secrets.scan_text("%25" * 2000)[2] >= 1
    deep = "token=abcdefgh"
    for _ in range(12):
        deep = urllib.parse.quote(deep.replace("=", "%3d", 1) if "=" in deep else deep)
    assert secrets.scan_text(deep)[1]


def test_odd_rows(spark):
    rows = [(1, None, 0, "a"), (2, "", 0, "a"), (None, "token=abcdef", 12, "a"), (3, "z" * 1_000_000 + " secret: 123456", 0, "a"), (3, "ok", 2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {(r.doc_id, r.n_assign): r.spans for r in secrets.scan(docs).collect()}
    assert got == {(1, 0): "", (2, 0): "", (None, 1): "assign:0:12", (3, 1): "assign:1000001:1000015", (3, 0): ""}
    assert secrets.scan(docs.limit(0)).collect() == []
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    by = {(r.doc_id, r.n_chars): r.text for r in clean.collect()}
    assert by[None, 16] == "[assign removed]" and by[1, None] is None and by[3, 2] == "ok"


def test_damaged_wrapped_and_joined_layers():
    key = "AKIA" + "Q" * 20
    b64 = lambda data: base64.b64encode(data).decode()
    members = gzip.compress(b"nothing here, just words. " * 4) + gzip.compress(f"and {key} there".encode())
    wrapped = base64.encodebytes(gzip.compress(f"{key} and {'some other words ' * 30}".encode() + bytes(range(40, 120)) * 3)).decode()
    late = "plain words. " * 500 + key
    for body in (b64(members), b64(b"caf\xe9 " + key.encode() + b" and more text"), wrapped, b64(late.encode())):
        text = f"before {body} after"
        base, spans, layers, _ = secrets.scan_text(text)
        assert layers >= 1 and any(kind == 1 for _, kind, _ in spans) and not any(k == 1 for _, k, _ in base)
    assert "\n" in wrapped.strip()
