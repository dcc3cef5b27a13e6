from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect, rows_of
from wiretally.llm import url_filter as u

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    got = entry.queries()["op2_url_filter"](spark, SF)
    assert not any(word in got._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))
    assert compare(got.toArrow(), connect(SF).execute(entry.oracle_sql()["op2_url_filter"]).to_arrow_table()) is None


def link(*hosts):
    return "".join(f"<a href='http://{h}/x'>" for h in hosts)


def pages():
    rows = [("http://good.org/a", link("linked.net", "LINKED.net", "good.org")), ("http://linked.net/", link("far.net"))]
    rows += [("http://bad.com/de/x", ""), ("https://spam.net/", link("bad.com")), ("ftp://spammer.net?x", link("spam.net"))]
    rows += [("http://example.org/es/1", None), ("http://a.example.org/en/12", ""), ("http://a.example.org/en/21", "")]
    rows += [("http://EXAMPLE.org/es", ""), ("http://x.com/fr/", link("//y.net/z", "rel")), ("http://x.com/de/", ""), ("http://y.net#/de/", "")]
    rows += [(None, link("z.net")), ("no scheme", ""), ("", None), ("http://org", ""), ("http://notorg/", ""), ("http://a.org?/es/", "")]
    rows += [(f"http://p{n}.net/", link("hub.net")) for n in range(30)] + [("http://hub.net/", link("bad.com"))] * 2
    return [(n, url, html, "clash", "x") for n, (url, html) in enumerate(rows)] + [(None, "http://a.org/", "q" * 200_000, "c", "x")]


@pytest.fixture(scope="module")
def verdicts(spark):
    return u.judge(spark.createDataFrame(pages(), "page_id long, url string, html string, host string, rule string"))


def test_rules_and_ranks(verdicts):
    by = {pages()[r.page_id][1] or "": r for r in verdicts.collect() if r.page_id is not None}
    assert (by["http://good.org/a"].rule, by["http://good.org/a"].verdict) == ("org/", "allow")
    assert (by["http://example.org/es/1"].rule, by["http://example.org/es/1"].verdict) == ("example.org/es/", "block")
    assert by["http://a.example.org/en/12"].rule == "example.org/en/1" and by["http://a.example.org/en/21"].rule == "org/"
    assert (by["http://EXAMPLE.org/es"].host, by["http://EXAMPLE.org/es"].verdict) == ("example.org", "allow")
    assert by["http://org"].rule is None and by["http://a.org?/es/"].rule is None and by["http://notorg/"].rule is None
    for url in ("", "no scheme"):
        assert (by[url].host, by[url].path, by[url].rule, by[url].verdict) == ("", "", None, "allow")
    assert by["http://linked.net/"].verdict == "allow"
    for url in ("https://spam.net/", "ftp://spammer.net?x", "http://hub.net/", "http://p3.net/"):
        assert (by[url].rule, by[url].verdict) == (None, "block"), url
    assert len(by) and verdicts.count() == len(pages())


def test_fixture_against_sql(spark, verdicts, tmp_path):
    import duckdb

    spark.createDataFrame(pages(), "page_id long, url string, html string, host string, rule string").write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM read_parquet('{tmp_path}/p/*.parquet')")
    want = con.execute(u.oracle()).to_arrow_table()
    assert rows_of(verdicts.toArrow())[2] == rows_of(want)[2]


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
