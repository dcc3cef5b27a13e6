from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from wiretally.llm import line_dedup as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(docs, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(doc)
    last = {k: max((x for x in h if x is not None), default=None) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()], key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    got = entry.queries()["op13_line_dedup"](spark, folder).toArrow()
    assert compare(got, connect(folder).execute(entry.oracle_sql()["op13_line_dedup"]).to_arrow_table()) is None


def test_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = d.drop_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert rows_of(got) == brute(docs)
    assert any(n for *_, n in brute(docs))


def test_odd_rows(spark):
    common, upper, short = "a common line that many of these documents share", "ÉCOLE ET ÉTÉ, UNE LIGNE COMMUNE DE CES TEXTES ICI", "too short to count"
    docs = [(n, f"{n}\n  {common.upper() if n % 2 else common}\t\n{short}\n{common}") for n in range(9)]
    docs += [(n, f"{upper}\n{upper.lower()}") for n in range(20, 26)]
    docs += [(None, common), (None, common + "\n\n"), (None, None), (40, ""), (41, "\n\n\n"), (42, None), (43, common + "\r")]
    docs += [(8, f"{common}\nsecond row of an id"), (8, f"{common}\nsecond row of an id"), (3, common)]
    docs += [(50, f"{upper}é\n" * 20_000), *((n, f"{upper}é") for n in range(51, 56)), (60, "y" * 2_000_000)]
    docs += [(n, "four documents only hold this line, which is not enough") for n in range(70, 74)] * 2
    docs += [(None, "held by rows without an id alone, however many of them")] * 9
    df = spark.createDataFrame([(*r, b"x", "clash") for r in docs], "doc_id long, text string, row binary, lines string").repartition(6)
    assert rows_of(d.drop_lines(df)) == brute(docs)
    assert d.drop_lines(df.limit(0)).collect() == []
    digests = {(r.doc_id, r.kept_sha256) for r in d.with_digest(d.drop_lines(df)).collect()}
    assert digests == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t, _, _ in brute(docs)}


def test_parameters(spark):
    docs = [(n, "ab\nabc\n" + "z" * n) for n in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(d.drop_lines(df, least_chars=3, least_docs=2)) == brute(docs, 3, 2)


def test_no_python_in_the_plan(spark):
    plan = d.drop_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
