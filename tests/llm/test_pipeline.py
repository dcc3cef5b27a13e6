"""The pipeline against its stages done by hand, in plain Python, on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import __spark_entry__ as entry
from test_decontaminate import brute
from test_golay_dedup import brute_similar
from test_packing import check
from test_quality import expected
from wiretally.llm import secrets

SF = "/root/testdata/sf0.001"


def by_hand(docs, labels, items):
    """(doc_id, text) that reach the last stage, from the definitions of the stages."""
    judged = expected(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs if judged[r.doc_id][2]]
    assert 0 < len(rows) < len(docs)
    groups = brute_similar(rows)
    once = [(d, t) for d, t in rows if groups[d] == d]
    assert len(once) < len(rows)
    clean = [(d, t) for d, t in once if all(brute(t, i) < 0.8 for i in items)]
    assert len(clean) < len(once)
    return {d: secrets.redact_text(t) for d, t in clean}


def test_run_equals_stages_by_hand(spark):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "labels", "benchmark")}
    want = by_hand(tables["documents"], tables["labels"], [r.text or "" for r in tables["benchmark"]])
    got = entry.queries()["pipeline"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(want)
    assert check(got, {d: (t,) for d, t in want.items()}) < 0.05


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame(
        [(10**9, None, None, None, None), (10**9 + 1, "", "xx", "", 0), (None, "the and of", "en", "s", 10), (10**9 + 2, "token=abcdefgh " * 3, "en", "s", 45)] * 2,
        docs.schema,
    )
    rows = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, rows.limit(0), SF).collect() == []
    pieces = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect():
        pieces[r.doc_id] += 1
    assert None in pieces and 10**9 in pieces


def test_shape_of_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
