"""The pipeline's stage of near copies on rows whose ids are null or not unique."""

from __future__ import annotations

import corpus_pipeline


def test_rows_are_judged_by_their_texts(spark):
    long = " ".join(f"word{n}" for n in range(100))
    rows = [(None, "a b", "x"), (None, "q", "x"), (None, None, "x"), (7, "é É", "x"), (7, "z " * 50, "x"), (7, "z " * 50, "x"), (1, "A  b", "x"), (None, long, None), (9, long + " end", "x"), (7, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(0, "q"), (0, ""), (7, "é É"), (7, "z " * 50), (1, "A  b"), (7, long)])
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), "").collect() == []
