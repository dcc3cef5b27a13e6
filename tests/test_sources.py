"""Odd and broken inputs of the log sources."""

from __future__ import annotations

import gzip
import json

from wiretally.sources import logs, reference

HEADER = ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#path\tconn"]
FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "unknown_field", "local_orig", "tunnel_parents"]


def tsv(rows):
    return "\n".join([*HEADER, "#fields\t" + "\t".join(FIELDS), *["\t".join(r) for r in rows], "#close\tnow"]) + "\n"


ROW = ["1700000000.25", "C1", "10.0.0.1", "1234", "8.8.8.8", "53", "udp", "x", "T", "a,b"]


def test_tsv_and_gzip(spark, tmp_path):
    (tmp_path / "conn.log").write_text(tsv([ROW]))
    with gzip.open(tmp_path / "conn.01.log.gz", "wt") as handle:
        handle.write(tsv([ROW[:1] + ["C2"] + ROW[2:8] + ["-", "(empty)"]]))
    got = {r.uid: r for r in logs.read_zeek_tsv(spark, str(tmp_path), "conn").collect()}
    assert set(got) == {"C1", "C2"}
    assert (got["C1"].src_port, got["C1"].local_orig, got["C1"].tunnel_parents) == (1234, True, ["a", "b"])
    assert got["C2"].local_orig is None and got["C2"].tunnel_parents is None and got["C2"].orig_bytes is None


def test_truncated_and_text(spark, tmp_path):
    (tmp_path / "conn.log").write_text(tsv([ROW]).rsplit("\n", 2)[0] + "\n1700000001.0\tC9")
    (tmp_path / "text.log").write_text("just some text\n")
    assert [r.uid for r in logs.read_zeek_tsv(spark, str(tmp_path), "conn").collect()] == ["C1"]
    quality = {r.file.rsplit("/", 1)[1]: r for r in logs.file_quality(spark, str(tmp_path)).collect()}
    assert quality["conn.log"].cut_off and quality["conn.log"].corrupt
    assert quality["text.log"].corrupt


def test_many_bad_lines(spark, tmp_path):
    good = json.dumps({"ts": 1.5, "uid": "C", "id.orig_h": "1.1.1.1", "id.resp_h": "2.2.2.2"})
    (tmp_path / "few.log").write_text("\n".join(["{bad"] * 25 + [good]))
    (tmp_path / "many.log").write_text("\n".join(["{bad"] * 26 + [good]))
    quality = {r.file.rsplit("/", 1)[1]: r.corrupt for r in logs.file_quality(spark, str(tmp_path)).collect()}
    assert quality == {"few.log": False, "many.log": True}


def test_json_times(spark, tmp_path):
    base = {"uid": "C", "id.orig_h": "1.1.1.1", "id.resp_h": "2.2.2.2"}
    times = [1700000000.5, "1700000000.5", "2023-11-14T22:13:20.500000Z", "never"]
    lines = [json.dumps({**base, "ts": t, "answers": ["a", "b"]}) for t in times] + ["", "# c", "{oops"]
    (tmp_path / "dns.log").write_text("\n".join(lines))
    rows = logs.read_zeek_json(spark, str(tmp_path), "dns").collect()
    assert len(rows) == 3
    assert len({r.ts for r in rows}) == 1 and rows[0].answers == ["a", "b"]


def test_discovery(spark, tmp_path):
    day = tmp_path / "2024-01-02"
    day.mkdir()
    for name in ("conn.13:00:00-14:00:00.log", "http.log", "conn_summary.log", "notes.txt", "open_ssl.log"):
        (day / name).write_text("x")
    got = {(r.log_type, str(r.day), r.hour) for r in logs.discover_logs(spark, str(tmp_path)).collect()}
    assert got == {("conn", "2024-01-02", 13), ("http", "2024-01-02", 0), ("open_ssl", "2024-01-02", 0)}


def test_blacklist_and_assets(spark, tmp_path):
    key = "A" * 32
    (tmp_path / "ja3.json").write_text(json.dumps({"_note": {"family": "n"}, key: {"family": "f", "threat": "t"}}, indent=1))
    assert [tuple(r) for r in reference.read_ja3_blacklist(spark, str(tmp_path / "ja3.json")).select("hash", "family").collect()] == [("a" * 32, "f")]
    (tmp_path / "assets.json").write_text(json.dumps({"assets": {"10.0.0.1": {"name": "plc", "criticality": "critical"}}}))
    assert reference.read_assets(spark, str(tmp_path / "assets.json")).first().criticality == "critical"


def test_labeled_domains(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"domain": "a.com", "ground_truth": "dga"}, {"domain": "b.com", "ground_truth": "benign"}]))
    assert {r.domain: r.label01 for r in reference.read_labeled_domains(spark, str(tmp_path / "d.json")).collect()} == {"a.com": 1, "b.com": 0}


def test_addresses(spark):
    import ipaddress

    from wiretally.functions.net import with_addresses

    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "::", "fe80::1", "2001:db8::ff00:42:8329", "::ffff:10.0.0.1", "1:2:3:4:5:6:7", "1::2::3", ":1::2", "a:0:0:b:0:0:0:c", "x", ""]
    frame = spark.createDataFrame([(t, t) for t in texts], "given string, ip string")
    for row in with_addresses(frame, {"key": "ip"}, canonical=True).collect():
        try:
            address = ipaddress.ip_address(row.given)
        except ValueError:
            assert row.key is None
            continue
        mapped = address if address.version == 4 else address.ipv4_mapped
        whole = int(address) if address.version == 6 else (0xFFFF << 32) + int(address)
        assert row.key == format(whole, "032x")
        assert row.ip == str(mapped or address)
